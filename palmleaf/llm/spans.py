"""Pattern spans in whole texts with SQL functions only.

Matches are fenced by a marker that cannot occur in the escaped text, the text is
split at the marker, and every second part is a match.  Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every \x01 of a text is followed by \x02 once escaped; \x01\x03 is the fence.
MARK, ESCAPED, FENCE = "\x01", "\x01\x02", "\x01\x03"
#: Parts whose lengths are summed one by one; longer lists are summed in blocks.
BLOCK = 256


def escape(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(ESCAPED))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPED), F.lit(MARK))


def parts(text: Column, pattern: str) -> Column:
    """Text between matches at even places, matches at odd ones; still escaped."""
    return F.split(F.regexp_replace(escape(text), F.lit(pattern), F.lit(FENCE + "$0" + FENCE)), FENCE)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """``body`` of one evaluated value: what a lambda names is not computed again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _befores(lens: Column) -> Column:
    """The sum of all lengths before each block."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int"))
    sums = F.transform(numbers, lambda b: _sum(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK))))
    return let(sums, lambda s: F.transform(s, lambda x, b: _sum(F.slice(s, F.lit(1), b))))


def located(pieces: Column, kind: str) -> Column:
    """Array of (kind, start, end, value) of the matches among ``pieces``.

    Starts are prefix sums: sums of whole blocks, then of the parts within one.
    """

    def of(bound: Column) -> Column:
        text = F.transform(bound, unescape)
        return let(text, lambda t: let(F.transform(t, lambda p: F.length(p).cast("bigint")), lambda lens: let(_befores(lens), lambda before: found(t, lens, before))))

    def found(text: Column, lens: Column, before: Column) -> Column:
        def one(k: Column) -> Column:
            at = 2 * k - 1  # 0-based place of the match
            b = F.floor(at / BLOCK).cast("int")
            start = F.get(before, b) + _sum(F.slice(lens, b * BLOCK + 1, at - b * BLOCK))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.get(lens, at)).alias("end"), F.get(text, at).alias("value"))

        return F.transform(F.sequence(F.lit(1), F.floor(F.size(text) / 2).cast("int")), one)

    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return F.when(F.size(pieces) > 1, of(pieces)).otherwise(empty)
