"""Fuzzy alignment of lines with a verse corpus, and text repair."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions import compiled
from palmleaf.functions.text import corpus_key, padas, rewrite, strip
from palmleaf.functions.udfs import nfc
from palmleaf.operators import lexicon
from palmleaf.operators.quality import calibrated, validity
from palmleaf.plans.session import stored
from palmleaf.sources import literals

#: Candidates of a block that is sent to all tasks.
BROADCAST_ROWS = 20_000
#: ``similar.Entries.closest`` in Java.
CLOSEST = Path(__file__).with_name("Closest.java")


def candidates(corpus: DataFrame) -> DataFrame:
    """Whole lines and their padas (ord, cand, cand_key), in the order of trying."""
    whole = corpus.select("ord", F.lit(-1).alias("sub"), F.col("line").alias("cand"))
    parts = corpus.select("ord", F.posexplode(padas(F.col("line"))).alias("sub", "cand"))
    keyed = whole.unionByName(parts).withColumn("cand_key", corpus_key(F.col("cand"))).where("cand_key <> ''")
    return keyed.select((F.col("ord").cast("bigint") * 1024 + F.col("sub") + 1).alias("cand_ord"), "cand", "cand_key")


def _closest(block: DataFrame, least: float) -> Callable[[Column], Column]:
    """A function of a key: struct(r, o, cand) of its closest candidate, null if no length fits."""
    rows = block.select("cand_key", "cand_ord", "cand").orderBy("cand_ord")._jdf.collectAsList()
    return compiled.function(block.sparkSession, CLOSEST, "r double, o bigint, cand string", rows, least, 0.8, 0.85, 0.94)


def align(
    lines: DataFrame,
    corpus: DataFrame,
    line: str = "line",
    min_similarity: float = 0.68,
    exact: DataFrame | None = None,
) -> DataFrame:
    """``lines`` with ``aligned`` and ``align_score``.

    Every distinct line meets only candidates of a similar length, a block of them at
    a time, and only those are compared in full that may be its best.
    Best score, then first candidate.  ``exact`` (key_line) catches the rest by key.
    """
    keyed = lines.select(corpus_key(F.col(line)).alias("target"))
    spark = lines.sparkSession
    # short rows with long work: a fixed number of tasks
    sized = keyed.where(F.length("target") >= 5).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # of equal candidates the first counts
    cand = stored(candidates(corpus).groupBy("cand_key").agg(F.min("cand_ord").alias("cand_ord"), F.min_by("cand", "cand_ord").alias("cand")), "align")
    found = None
    for k in range(blocks := max(1, -(-cand.count() // BROADCAST_ROWS))):
        block = cand.where(F.pmod(F.xxhash64("cand_key"), F.lit(blocks)) == k)
        one = sized.select("target", _closest(block, min_similarity)(F.col("target")).alias("b"))
        found = one if found is None else found.unionByName(one)
    best = stored(found.groupBy("target").agg(F.max("b").alias("b")), "align")
    # one join, and no text twice in its rows
    out = lines.withColumn("target", corpus_key(F.col(line))).join(best, "target", "left")
    hit = F.coalesce(F.col("b.r") >= min_similarity, F.lit(False))
    if exact is None:
        match, score = F.when(hit, F.col("b.cand")).otherwise(F.col(line)), F.coalesce("b.r", F.lit(0.0))
    else:
        first = exact.withColumn("k", corpus_key(F.col("key_line"))).where("k <> ''").groupBy("k").agg(F.min_by("key_line", "ord").alias("key_line"))
        out = out.join(first, F.col("target") == F.col("k"), "left")
        other = (F.length("target") >= 5) & F.col("key_line").isNotNull()
        match = F.when(hit, F.col("b.cand")).when(other, F.col("key_line")).otherwise(F.col(line))
        score = F.when(hit, F.col("b.r")).when(other, 1.0).otherwise(F.coalesce("b.r", F.lit(0.0)))
    return out.select(*[F.col(f"`{c}`") for c in lines.columns], match.alias("aligned"), F.when(F.col(line).isNotNull(), score).alias("align_score"))


def repair(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    raw_confidence: str = "raw_confidence",
    align_corpus: bool = False,
    vocab: DataFrame | None = None,
    corpus: DataFrame | None = None,
) -> DataFrame:
    """Rewritten, aligned or snapped text of each document with calibrated
    confidence, mean validity and the number of aligned lines."""
    spark = docs.sparkSession
    vocab = lexicon.default_vocabulary(spark) if vocab is None else vocab
    corpus = literals.verse_frame(spark) if corpus is None else corpus
    rows = docs.select(F.col(doc_id).alias("id"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    rows = rows.withColumn("line", strip(F.col("line"))).where("line <> ''")
    fixed = rows.withColumn("line", nfc(rewrite(nfc(F.col("line")))))
    if align_corpus:
        fixed = align(fixed, corpus, min_similarity=0.70).withColumn("hit", F.col("align_score") >= 0.70)
        fixed = fixed.withColumn("line", F.when(F.col("hit"), F.col("aligned")).otherwise(F.col("line"))).drop("aligned", "align_score")
    else:
        fixed = fixed.withColumn("hit", F.lit(False))
    words = fixed.where("NOT hit").select("id", "at", F.posexplode(F.filter(F.split("line", r"\s+"), lambda x: x != "")).alias("w_at", "word"))
    snapped = (
        lexicon.snap(words, vocab)
        .groupBy("id", "at")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_at", "snapped"))), lambda x: x["snapped"]), " ").alias("snap"))
    )
    whole = fixed.join(snapped, ["id", "at"], "left").withColumn("line", F.when(F.col("hit"), F.col("line")).otherwise(F.coalesce("snap", "line")))
    whole = whole.withColumn("valid", validity(F.col("line")))
    found = whole.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("corrected"),
        (F.sum("valid") / F.greatest(F.count("*"), F.lit(1))).alias("lexical_validity"),
        F.sum(F.col("hit").cast("bigint")).alias("corpus_aligned_lines"),
    )
    raw = F.col(raw_confidence)
    out = docs.join(found, F.col(doc_id) == F.col("id"), "left").drop("id")
    return out.withColumns(
        {
            "calibrated_confidence": F.when(F.col("corrected").isNull(), 0.0).otherwise(
                calibrated(raw, F.col("lexical_validity"), F.col("corpus_aligned_lines") > 0)
            ),
            "corrected": F.coalesce("corrected", F.lit("")),
            "lexical_validity": F.coalesce("lexical_validity", F.lit(0.0)),
            "corpus_aligned_lines": F.coalesce("corpus_aligned_lines", F.lit(0)),
        }
    )


def line_key(text: Column) -> Column:
    return corpus_key(text)
