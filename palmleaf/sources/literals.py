"""The fixed tables of the engine, from the text files of ``palmleaf/data``."""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession


@lru_cache
def lines(name: str) -> tuple[str, ...]:
    """Lines of a data file, without the comment at its head."""
    text = resources.files("palmleaf.data").joinpath(name).read_text("utf-8")
    return tuple(x for x in text.split("\n")[1:] if x)


@lru_cache
def rules() -> tuple[tuple[str, str, bool], ...]:
    """(pattern, replacement, multiline) in their order."""
    found = (x.split("\t") for x in lines("rewrite_rules.tsv"))
    return tuple((p, r, flags == "m") for p, r, flags in found)


def verses() -> tuple[str, ...]:
    return lines("verses.txt")


@lru_cache
def dictionary() -> tuple[tuple[str, str], ...]:
    return tuple(tuple(x.split("\t")) for x in lines("dictionary.tsv"))


@lru_cache
def classes() -> tuple[tuple[int, str, str, str], ...]:
    return tuple((int(a), b, c, d) for a, b, c, d in (x.split("\t") for x in lines("classes.tsv")))


@lru_cache
def glyph_ids() -> dict[str, int]:
    """Glyph to id: 0 is the blank, ids from 1 in first-seen order, a space last."""
    out: dict[str, int] = {}
    for glyph in (*lines("glyphs.txt"), " "):
        out.setdefault(glyph, len(out) + 1)
    return out


# Pairs of glyphs that recognisers confuse, in the order of trying.
CONFUSIONS = (
    ("ष", "प"), ("प", "ष"), ("व", "ब"), ("ब", "व"), ("श", "स"), ("स", "श"), ("ध", "घ"), ("घ", "ध"),
    ("भ", "म"), ("म", "भ"), ("रव", "ख"), ("ि", "ी"), ("ी", "ि"), ("ु", "ू"), ("ू", "ु"),
)


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A literal table with its order in ``ord``."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"ord int, {schema}")


def dictionary_frame(spark: SparkSession) -> DataFrame:
    return frame(spark, dictionary(), "key string, english string")


def verse_frame(spark: SparkSession) -> DataFrame:
    return frame(spark, [(v,) for v in verses()], "line string")
