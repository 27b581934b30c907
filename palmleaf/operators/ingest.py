"""Filters, de-duplication and merges of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.functions.text import count, english, one_line, strip_punct

MARKER = "### Assistant:"


def split_record(text: Column, marker: str = MARKER) -> Column:
    """struct(left, right), null unless the marker stands exactly once."""
    parts = F.split(text, "\\Q" + marker + "\\E")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("left"), parts[1].alias("right")))


def parallel_pairs(records: DataFrame, text: str = "text", least_script: int = 5, script: str = "[ऀ-ॿ]", valid: Column | None = None) -> DataFrame:
    """Cleaned pairs (source, english) of marked records, with both sides filled."""
    cut = split_record(F.col(text))
    out = records.withColumn("__cut", cut).where("__cut IS NOT NULL")
    out = out.withColumns({"source": one_line(F.col("__cut.right")), "english": english(F.col("__cut.left"))}).drop("__cut")
    keep = (F.col("source") != "") & (F.col("english") != "") & (count(F.col("source"), script) >= least_script)
    return out.where(keep if valid is None else keep & valid)


def first_rows(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each key in an order; one aggregate, no sort of all rows."""
    rest = [c for c in rows.columns if c not in by]
    kept = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return kept.select(*by, *[F.col(f"r.{c}").alias(c) for c in rest])


def new_rules(found: DataFrame, known: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rules that are not known yet, each once, the first one."""
    return first_rows(found, by, order).join(known.select(*by).distinct(), by, "left_anti")


def sandhi_filter(rows: DataFrame, surface: str, split: str, most: int = 60) -> DataFrame:
    a, b = F.col(surface), F.col(split)
    return rows.where((a != "") & (b != "") & (a != b) & (F.length(a) <= most))


def dual_index(pairs: DataFrame, key: str, value: str, order: str, variant: str = "corpus") -> DataFrame:
    """key -> value under the key and its punctuation-free form; later ones win."""
    plain = strip_punct(F.col(key), variant)
    both = F.array(
        F.struct((F.col(order) * 2).alias("o"), F.col(key).alias("k")), F.struct((F.col(order) * 2 + 1).alias("o"), plain.alias("k"))
    )
    rows = pairs.select(F.inline(both), F.col(value).alias("v")).where("k <> ''")
    return rows.groupBy("k").agg(F.max_by("v", "o").alias("v"))


def merge(old: DataFrame, new: DataFrame, by: str, value: str) -> DataFrame:
    """Full merge of two keyed tables; values of ``new`` win."""
    a, b = old.select(by, F.col(value).alias("__old")), new.select(by, F.col(value).alias("__new"))
    return a.join(b, by, "full").select(by, F.coalesce("__new", "__old").alias(value))


def added_keys(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    return new.select(by).distinct().join(old.select(by), by, "left_anti").agg(F.count("*").alias("n_added"))


def keyword(rows: DataFrame, word: str, source: str, other: str) -> DataFrame:
    """Rows whose source matches a pattern, or whose other column does in any case."""
    hit = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    return rows.where(hit(source, word) | hit(other, f"(?i){word}"))


def head(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def first_records(rows: DataFrame, order: str, n: int, keep: Column) -> DataFrame:
    """Rows with an index below ``n`` that pass."""
    return rows.where((F.col(order) < n) & keep)


def first_valid(rows: DataFrame, order: str, n: int, keep: Column) -> DataFrame:
    """The first ``n`` rows that pass."""
    return rows.where(keep).orderBy(order).limit(n)


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded order that no partitioning changes."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def zip_rows(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """Rows of both sides paired by position within ``by``; the shorter side ends it."""
    w = Window.partitionBy(by).orderBy(order)
    a = left.withColumn("pos", F.row_number().over(w))
    b = right.withColumn("pos", F.row_number().over(w))
    rename = {c: f"{c}_r" for c in right.columns if c != by}
    return a.join(b.withColumnsRenamed(rename), [by, "pos"])
