"""Recognition and translation metrics: CER, WER, BLEU, chrF, strategy means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.functions.text import fields, strip


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _edges(ref: Column, hyp: Column, rate: Column) -> Column:
    return F.when((ref == "") & (hyp == ""), 0.0).when((ref == "") | (hyp == ""), 1.0).otherwise(rate)


def cer(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's characters; may exceed 1."""
    r, h = strip(F.coalesce(ref, F.lit(""))), strip(F.coalesce(hyp, F.lit("")))
    return _let(
        F.struct(r.alias("r"), h.alias("h")),
        lambda x: _edges(x["r"], x["h"], F.levenshtein(x["r"], x["h"]) / F.greatest(F.length(x["r"]), F.lit(1))),
    )


def wer(ref: Column, hyp: Column) -> Column:
    """Word edit distance over the reference's words: each distinct word of a pair
    is written as one character, so the JVM's edit distance compares words."""
    r, h = strip(F.coalesce(ref, F.lit(""))), strip(F.coalesce(hyp, F.lit("")))

    def rate(x: Column) -> Column:
        words = F.array_distinct(F.concat(x["r"], x["h"]))
        # letters from U+4E00 on: some 20,900 distinct words a pair
        spell = lambda a: F.array_join(F.transform(a, lambda w: F.decode(F.unhex(F.hex(F.array_position(words, w) + 0x4DFF)), "UTF-16BE")), "")
        return F.levenshtein(spell(x["r"]), spell(x["h"])) / F.greatest(F.size(x["r"]), F.lit(1))

    return _edges(r, h, _let(F.struct(fields(r).alias("r"), fields(h).alias("h")), rate))


def sample(ref: Column, hyp: Column) -> Column:
    """struct(cer, wer, accuracy)."""
    error = cer(ref, hyp)
    return F.struct(error.alias("cer"), wer(ref, hyp).alias("wer"), F.greatest(F.lit(0.0), 1 - error).alias("accuracy"))


def _ngrams(units: Column, n: int, glue: str) -> Column:
    size = F.size(units) - n + 1
    return F.when(
        size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: F.array_join(F.slice(units, k, n), glue))
    ).otherwise(F.array().cast("array<string>"))


def _matches(pairs: DataFrame, by: list[str], units, orders: int, glue: str) -> DataFrame:
    """by, order, hyp, ref and clipped n-gram counts: one shuffle on the n-grams."""
    sides = []
    for side, sign in (("ref", 0), ("hyp", 1)):
        grams = F.array(*[F.struct(F.lit(n).alias("order"), _ngrams(units(F.col(side)), n, glue).alias("g")) for n in range(1, orders + 1)])
        flat = pairs.select(*by, "pair_id", F.explode(grams).alias("o")).select(*by, "pair_id", F.col("o.order").alias("order"), F.explode("o.g").alias("gram"))
        sides.append(flat.withColumns({"h": F.lit(sign), "r": F.lit(1 - sign)}))
    both = sides[0].unionByName(sides[1]).groupBy(*by, "pair_id", "order", "gram").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    return both.groupBy(*by, "order").agg(F.sum("h").alias("hyp"), F.sum("r").alias("ref"), F.sum(F.least("h", "r")).alias("both"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda c: c != "")


def chrf(pairs: DataFrame, by: list[str] | None = None, orders: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF (0-100) of ``pairs`` (pair_id, ref, hyp): precision and recall are
    averaged, in order, over the orders that both sides have."""
    by = by or []
    counts = _matches(pairs, by, _chars, orders, "").where("hyp > 0 AND ref > 0")
    at = lambda n, c: F.coalesce(F.max(F.when(F.col("order") == n, F.col("both") / F.col(c))), F.lit(0.0))
    mean = lambda c: reduce(lambda x, y: x + y, [at(n, c) for n in range(1, orders + 1)]) / F.count("*")
    rates = counts.groupBy(*by).agg(mean("hyp").alias("p"), mean("ref").alias("r"))
    b2 = beta * beta
    return rates.select(*by, F.when(F.col("p") + F.col("r") > 0, 100 * (1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r"))).otherwise(0.0).alias("chrf"))


#: The tokeniser that separates symbols from words.
_13A = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))


def tokenized(text: Column) -> Column:
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, to in _13A:
        out = F.regexp_replace(out, pattern, to)
    return fields(out)


def bleu(pairs: DataFrame, by: list[str] | None = None, tokens=tokenized, orders: int = 4) -> DataFrame:
    """Corpus BLEU (0-100) of ``pairs`` (pair_id, ref, hyp), with exponential
    smoothing of empty orders and the brevity penalty."""
    by = by or []
    counts = _matches(pairs, by, tokens, orders, " ").where("hyp > 0")
    grouped = counts.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("order", "hyp", "both", "ref"))).alias("o")  # one row an order
    )

    def smooth(acc: Column, x: Column) -> Column:
        zero = x["both"] == 0
        k = F.when(zero, acc["k"] * 2).otherwise(acc["k"])
        return F.struct(
            (acc["log"] + F.log(F.when(zero, 100.0 / (k * x["hyp"])).otherwise(100.0 * x["both"] / x["hyp"]))).alias("log"), k.alias("k")
        )

    first = F.get("o", F.lit(0))
    logs = F.aggregate("o", F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("k")), smooth)
    penalty = F.when(first["hyp"] < first["ref"], F.exp(1 - first["ref"] / first["hyp"])).otherwise(1.0)
    some = F.exists("o", lambda x: x["both"] > 0) & (F.size("o") == orders)
    return grouped.select(*by, F.when(some, penalty * F.exp(logs["log"] / orders)).otherwise(0.0).alias("bleu"))


def strategy_means(metrics: DataFrame, columns: list[str]) -> DataFrame:
    return metrics.groupBy("strategy").agg(*[(F.sum(c) / F.greatest(F.count(c), F.lit(1))).alias(c) for c in columns])


def improvement(base: Column, new: Column) -> Column:
    """Relative drop from base to new; 0 where the base is 0."""
    return F.when(base > 0, (base - new) / base).otherwise(0.0)
