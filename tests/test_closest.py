"""The Java search for the closest candidate against difflib, and the alignment at size."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from palmleaf.functions import compiled
from palmleaf.operators import align

LEAST = 0.68


def _closest(spark, keys, texts):
    rows = spark.createDataFrame([(k, at, f"line {k}") for at, k in enumerate(keys)], "cand_key string, cand_ord long, cand string")
    found = align._closest(rows, LEAST)
    asked = spark.createDataFrame(list(enumerate(texts)), "at int, text string").repartition(4)
    return {r.at: r.b and (-r.b.o, r.b.r, r.b.cand) for r in asked.select("at", found(F.col("text")).alias("b")).collect()}


def _difflib(keys, text):
    n, want = len(text), None
    for at, key in enumerate(keys):
        small, large = min(n, len(key)), max(n, len(key))
        if not (2.0 * small / (n + len(key)) >= LEAST and small / large >= 0.8):
            continue
        r = difflib.SequenceMatcher(None, text, key).ratio()
        if n >= 8 and small / large >= 0.85 and (text in key or key in text):
            r = max(r, 0.94)
        if want is None or r > want[1]:
            want = (at, r, f"line {key}")
    return want


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij धर्मक", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ.,😀𝒜"])
def test_closest_is_difflibs_best(spark, alphabet):
    """Equal ratios, the first of equal candidates, code points beyond 16 bits, lengths
    around 200, where difflib leaves out frequent characters, and long texts."""
    rng = random.Random(41)
    text = lambda least, most: "".join(rng.choice(alphabet) for _ in range(rng.randrange(least, most)))
    keys = [text(1, 90) for _ in range(50)] + [text(190, 215) for _ in range(20)] + [text(90, 900) for _ in range(20)]
    keys = list(dict.fromkeys([*keys, "ab" * 120 + "xyz", "abc" * 70, "a" * 199, "a" * 200]))
    texts = ["".join(c for c in k if rng.random() > 0.1) + "x" * rng.randrange(5) for k in keys[::2]]
    texts += [text(1, 400) for _ in range(40)] + [k[: len(k) * 9 // 10] for k in keys[::9]] + keys[::7] + ["", "q", "a" * 210, "z" * 200, "漢字" * 40]
    assert _closest(spark, keys, texts) == {at: _difflib(keys, t) for at, t in enumerate(texts)}


def test_no_candidate_and_null(spark):
    assert _closest(spark, [], ["abcdefgh"]) == {0: None}
    assert _closest(spark, ["abcdefgh"], [None, "abcdefgh", "x" * 50000]) == {0: None, 1: (0, 1.0, "line abcdefgh"), 2: None}


def test_blocks_of_candidates_agree(spark, monkeypatch):
    """The best over blocks, the first of equal ones."""
    rng = random.Random(42)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 60)))
    corpus = spark.createDataFrame([(k, line()) for k in range(60)], "ord int, line string")
    lines = spark.createDataFrame([(k, line()) for k in range(50)], "id int, line string")
    whole = sorted(map(tuple, align.align(lines, corpus).collect()))
    monkeypatch.setattr(align, "BROADCAST_ROWS", 7)
    assert sorted(map(tuple, align.align(lines, corpus).collect())) == whole


def test_many_unlike_lines_end_in_time(spark):
    """200 candidates against 6,000 lines that are like none of them; in Python one line
    takes more than 10 ms."""
    rng = random.Random(43)
    words = ["th", "er", "in", "on", "ti", "re", "at", "ed", "nd", "ou", "ing", "tion"]
    line = lambda: "".join(rng.choice(words) for _ in range(rng.randrange(30, 100)))
    keys, texts = [line() for _ in range(200)], [line() for _ in range(6000)]
    _closest(spark, keys, texts[:10])
    began = time.time()
    assert len(_closest(spark, keys, texts)) == 6000
    took = time.time() - began
    assert took < 12, took
