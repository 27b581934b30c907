"""Sequence scans: label decoding, encoding, numbering, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palmleaf.plans.session import stored


def encode(text: Column, ids: dict[str, int]) -> Column:
    """Ids of a text's characters; unknown characters are left out."""
    table = F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))])
    found = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.try_element_at(table, c))
    return F.filter(found, lambda x: x.isNotNull())


def pad(ids: Column, size: int = 64, blank: int = 0) -> Column:
    cut = F.slice(ids, 1, size)
    return F.concat(cut, F.array_repeat(F.lit(blank), F.lit(size) - F.size(cut)))


def collapse(ids: Column, blank: int = 0) -> Column:
    """Greedy decoding: repeats go first, then blanks."""
    kept = F.filter(ids, lambda x, k: (x != blank) & ((k == 0) | (x != F.get(ids, k - 1))))
    return kept


def decode(ids: Column, ids_of: dict[str, int]) -> Column:
    table = F.create_map(*[x for k, v in ids_of.items() for x in (F.lit(v), F.lit(k))])
    return F.array_join(F.transform(collapse(ids), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(""))), "")


def path_confidence(ids: Column, probs: Column, blank: int = 0) -> Column:
    """Mean probability of the steps that are not blank; 0.0 without one."""
    said = F.filter(F.arrays_zip(ids.alias("i"), probs.alias("p")), lambda x: x["i"] != blank)
    total = F.aggregate(said, F.lit(0.0), lambda a, x: a + x["p"])
    return F.when(F.size(said) > 0, total / F.size(said)).otherwise(0.0)


def positional_split(rows: DataFrame, order: str, share: float = 0.85) -> DataFrame:
    """``position`` by ``order`` and ``split``: the first ``int(n * share)`` rows train.

    Positions come from a range sort: rows are numbered within ranges, and the
    ranges' counts, a row a partition, give each its first number.  The sorted rows
    are stored, as bounds of a second sampling could differ.
    """
    ranged = rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    numbered = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = (
        ranged.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(everything).alias("__total"))
    )
    placed = numbered.join(F.broadcast(starts), "__part")
    position = F.col("__start") + F.col("__at")
    return placed.select(
        *rows.columns, position.alias("position"), F.when(position <= F.floor(F.col("__total") * share), "train").otherwise("val").alias("split")
    )
