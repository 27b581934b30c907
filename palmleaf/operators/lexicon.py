"""Lexicon membership and snapping of words to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions.text import edge_split, tokens_of_script
from palmleaf.sources import literals

# Endings that recognisers lose, in the order of trying.
SUFFIXES = ("ः", "ाः", "म्", "ं", "े", "ौ")
TRAILING = ("ः", "ं", "्")
VISARGA = "ः"
IKARA = ("ि", "([क-ह])([क-ह])ि", "$1ि$2")


def vocabulary(texts: DataFrame, column: str = "line") -> DataFrame:
    """Distinct words of a corpus."""
    return texts.select(F.explode(tokens_of_script(F.col(column))).alias("word")).distinct()


def default_vocabulary(spark: SparkSession) -> DataFrame:
    return vocabulary(literals.verse_frame(spark))


def mutations(
    core: Column,
    suffixes=SUFFIXES,
    trailing=TRAILING,
    confusions=literals.CONFUSIONS,
    visarga: str = VISARGA,
    ikara=IKARA,
) -> Column:
    """Ordered array of the words that ``core`` may stand for."""
    none = F.array().cast("array<string>")
    n = F.length(core)
    added = F.array(*[F.concat(core, F.lit(s)) for s in suffixes]) if suffixes else none
    short = none
    if trailing:
        ends = core.endswith(trailing[0])
        for t in trailing[1:]:
            ends = ends | core.endswith(t)
        short = F.when((n >= 3) & ends, F.array(F.substring(core, F.lit(1), n - 1))).otherwise(none)

    def swapped(src: str, to: str) -> Column:
        size = len(src)
        places = F.filter(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.substring(core, p, F.lit(size)) == src
        )
        made = F.transform(
            places, lambda p: F.concat(F.substring(core, F.lit(1), p - 1), F.lit(to), F.substring(core, p + size, n))
        )
        return F.flatten(F.transform(made, lambda c: F.array(c, F.concat(c, F.lit(visarga)))))

    tried = [added, short, *[F.when(core.contains(s), swapped(s, t)).otherwise(none) for s, t in confusions]]
    if ikara:
        moved = F.regexp_replace(core, ikara[1], ikara[2])
        tried.append(F.when(core.contains(ikara[0]), F.array(moved, F.concat(moved, F.lit(visarga)))).otherwise(none))
    return F.concat(*tried)


def snap(words: DataFrame, vocab: DataFrame, word: str = "word", **tables) -> DataFrame:
    """``words`` with ``snapped``: the first mutation that the lexicon holds.

    Distinct words are tried once, only those outside the lexicon are mutated, and
    the candidates meet the lexicon in one equi-join.
    """
    distinct = words.select(F.col(word).alias("w")).distinct()
    parts = edge_split(F.col("w"))
    split = distinct.select("w", parts["prefix"].alias("prefix"), parts["core"].alias("core"), parts["suffix"].alias("suffix"))
    known = vocab.select(F.col("word").alias("v"))
    open_ = (
        split.where("core <> ''")
        .join(known, F.col("w") == F.col("v"), "left_anti")
        .join(known, F.col("core") == F.col("v"), "left_anti")
    )
    tried = open_.select("w", "prefix", "suffix", F.posexplode(mutations(F.col("core"), **tables)).alias("pos", "cand"))
    hits = tried.join(known, F.col("cand") == F.col("v"))
    first = hits.groupBy("w").agg(F.min_by(F.concat("prefix", "cand", "suffix"), "pos").alias("snapped"))
    return words.join(first, F.col(word) == F.col("w"), "left").withColumn("snapped", F.coalesce("snapped", F.col(word))).drop("w")
