"""Near-duplicates that sketches miss, against brute force over all pairs."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F
from test_html_and_pipeline import _brute

from palmleaf.llm import neardup
from palmleaf.plans.session import CLEANUP, stored


def _noise(rng, n):
    return [f"u{rng.randrange(10**6)}" for _ in range(n)]


def _edited(rng, words, places):
    out = words[:]
    for k in places:
        out[k] = f"e{rng.randrange(10**6)}"
    return out


def _check(spark, texts, pairs):
    """Classes equal brute force's; returns planted pairs found."""
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    want = _brute(dict(enumerate(texts)))
    assert all(want[a] == want[b] for a, b in pairs)
    assert got == want, f"{found} of {len(pairs)} planted pairs found"


def test_copies_among_unlike_texts_of_one_length(spark):
    """Near copies, edited outside a passage that many unlike texts share."""
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(70)]
    texts, pairs = [], []
    for k in range(150):
        base = passage + _noise(rng, 30)
        texts.append(base)
        if k % 3 == 0:
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(_edited(rng, base, rng.sample(range(70, 100), 9)))
    _check(spark, texts, pairs)


def test_copies_with_scattered_edits(spark):
    """Edits spread so that few or no 5-word k-mers are left, and short texts."""
    rng = random.Random(22)
    texts, pairs = [], []

    def plant(n, places):
        base = _noise(rng, n)
        pairs.append((len(texts), len(texts) + 1))
        texts.extend([base, _edited(rng, base, places)])

    for _ in range(20):
        plant(100, rng.sample(range(100), 19))
        plant(400, range(2, 400, 5))
        plant(100, range(3, 100, 7))
        plant(10, [5])
        plant(20, rng.sample(range(20), 3))
        plant(5, [2])
    common = [f"c{k}" for k in range(60)]  # a small vocabulary
    for _ in range(20):
        base = [rng.choice(common) for _ in range(40)]
        pairs.append((len(texts), len(texts) + 1))
        texts.extend([base, _edited(rng, base, range(4, 40, 5))])
    _check(spark, texts, pairs)


def test_recall_by_edit_rate(spark):
    """Pairs at every rate of word edits that the similarity allows; the sketches alone
    find nine in ten at least."""
    rng = random.Random(23)
    texts, pairs = [], {}
    for rate in (0.02, 0.05, 0.1, 0.15, 0.18, 0.2):
        for _ in range(40):
            n = rng.choice((30, 60, 120, 200, 500))
            base = _noise(rng, n)
            pairs.setdefault(rate, []).append((len(texts), len(texts) + 1))
            texts.extend([base, _edited(rng, base, rng.sample(range(n), int(rate * n)))])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    recall = {rate: sum(got[a] == got[b] for a, b in found) / len(found) for rate, found in pairs.items()}
    assert min(recall.values()) >= 0.97, recall
    assert len(set(got.values())) >= len(texts) // 2


def test_prefix_filter_in_passes(spark, monkeypatch):
    """Texts of large buckets meet in passes of bounded size, none of which loses a pair."""
    made = []
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "PASS_ROWS", 300)
    monkeypatch.setattr(neardup, "PASS_SHARE", 0.0)
    monkeypatch.setattr(neardup, "TURNS", 0)
    words = neardup._words
    monkeypatch.setattr(neardup, "_words", lambda rare, part, parts: (made.append((part, parts)), words(rare, part, parts))[1])
    rng = random.Random(24)
    passage = [f"p{k}" for k in range(70)]
    texts, pairs = [], []
    for k in range(60):
        base = passage + _noise(rng, 30)
        texts.append(base)
        if k % 2 == 0:
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(_edited(rng, base, rng.sample(range(70, 100), 9)))
    _check(spark, texts, pairs)
    assert made and made[0][1] > 1 and [k for k, _ in made] == list(range(made[0][1]))


def test_stored_tables_leave_no_shuffle_files(spark):
    """Shuffle files go with the write that made them, not with a garbage collection."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for f in Path(str(d)).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(CLEANUP, "false")
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 7
    assert spark.conf.get(CLEANUP, "false") == setting
