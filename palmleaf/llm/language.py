"""Multilingual mixture inference of document languages.

A language is a distribution over hashed byte n-grams.  N-grams with similar
profiles across the languages form classes (a fixed-size codebook), so a whole
document, however long, becomes one count vector over classes.  For each
document expectation-maximisation estimates the language proportions; the set of
languages grows one by one while the likelihood gained exceeds a penalty of
``PENALTY * log(n)`` (a Bayesian information criterion).  The prediction is the
language with the largest proportion.

Fitting counts the n-grams of all labelled texts, each whole, where they are read; only
the sums, a fixed number for each language, reach the driver.  The classifier knows the
``MOST_LANGUAGES`` languages with the most labelled texts, its one documented bound.
Prediction reads whole texts.

Defined results: kept columns named like an operator's own are left out; a null text, or one without a letter, is ``und`` with score 0;
without any labelled row everything is ``und``; ties go to the language that
sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.common import fields, kept, texts_of, tune, unclashed, with_text

BITS = 16
MOST_LANGUAGES = 200
#: Counts that are summed together, and languages that a task counts at once.
PART, AT_ONCE = 1 << 12, 32
CLASSES = 192
ROUNDS = 12
PENALTY = 2.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _lower_table() -> np.ndarray:
    """Bytes to symbols: letters lower-cased, other ASCII one blank."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    for b in range(97, 123):
        table[b] = table[b - 32] = b
    return table


_FOLD = _lower_table()


def grams(raw: bytes) -> np.ndarray:
    """Hashes of the byte trigrams of a text, blanks included."""
    b = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    h = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # n-gram hash -> class
    emit: np.ndarray  # (class, language) probabilities


def fit(rows: list[tuple[str, np.ndarray]]) -> Model:
    """Train on the n-gram counts of languages, a row each."""
    if not rows:
        return Model([], np.zeros(1 << BITS, np.uint8), np.zeros((1, 0)))
    languages = [lang for lang, _ in rows]
    counts = np.stack([c for _, c in rows]).astype(float)
    given = (counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * (1 << BITS))
    weight = counts.sum(axis=0) + 1e-3
    profile = np.log(given / given.mean(axis=0)).T  # (n-gram, language)
    # a small weighted k-means, started from evenly spaced profiles
    order = np.lexsort(profile.T)
    centres = profile[order[np.linspace(0, len(order) - 1, CLASSES).astype(int)]]
    seen = np.flatnonzero(weight >= 1)
    if len(seen):
        centres[: min(len(seen), CLASSES // 2)] = profile[seen[np.argsort(-weight[seen])][: CLASSES // 2]]
    nearest = np.zeros(len(profile), np.int64)
    for _ in range(ROUNDS):
        for at in range(0, len(profile), 8192):
            gap = ((profile[at : at + 8192, None] - centres[None]) ** 2).sum(axis=2)
            nearest[at : at + 8192] = gap.argmin(axis=1)
        total = np.bincount(nearest, weight, CLASSES)
        for k in range(profile.shape[1]):
            moved = np.bincount(nearest, weight * profile[:, k], CLASSES)
            centres[:, k] = np.where(total > 0, moved / np.maximum(total, 1e-12), centres[:, k])
    emit = np.stack([np.bincount(nearest, given[k], CLASSES) for k in range(len(languages))], axis=1)
    return Model(languages, nearest.astype(np.uint8 if CLASSES <= 256 else np.uint16), np.maximum(emit, 1e-12))


def _em(hist: np.ndarray, emit: np.ndarray, allowed: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of all documents at once."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.maximum(hist.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        share = share * ((hist / np.maximum(share @ emit.T, 1e-300)) @ emit) / n
    return share, (hist * np.log(np.maximum(share @ emit.T, 1e-300))).sum(axis=1)


def mixtures(hist: np.ndarray, emit: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each document under the penalised likelihood."""
    docs, langs = len(hist), emit.shape[1]
    single = hist @ np.log(emit)
    allowed = np.zeros((docs, langs))
    allowed[np.arange(docs), single.argmax(axis=1)] = 1
    like, share = single.max(axis=1), allowed.copy()
    cost = penalty * np.log(np.maximum(hist.sum(axis=1), 2))
    open_ = np.ones(docs, bool)
    for _ in range(langs - 1):
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        # the language that explains most beyond the present mixture goes in next
        mixed = np.maximum(share[rows] @ emit.T, 1e-300)
        gain = (hist[rows] / mixed) @ emit
        gain[allowed[rows] > 0] = -1
        more = allowed[rows].copy()
        more[np.arange(len(rows)), gain.argmax(axis=1)] = 1
        new, better = _em(hist[rows], emit, more)
        take = better - like[rows] > cost[rows]
        won = rows[take]
        allowed[won], share[won], like[won] = more[take], new[take], better[take]
        open_[:] = False
        open_[won] = True
    return share


def predict(model: Model, texts: list[bytes | None], penalty: float = PENALTY) -> tuple[list[str], list[float], list[list[float]]]:
    names, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if not model.languages:
        return names, scores, shares
    rows = [k for k, raw in enumerate(texts) if raw and _LETTER.search(raw.decode("utf-8", "replace"))]
    if rows:
        hist = np.stack([np.bincount(model.classes[grams(texts[k])], minlength=len(model.emit)) for k in rows]).astype(float)
        for k, share in zip(rows, mixtures(hist, model.emit, penalty), strict=True):
            names[k] = model.languages[int(share.argmax())]
            scores[k] = float(min(1.0, share.max()))
            shares[k] = share.tolist()
    return names, scores, shares


def _counted(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in sums.items():
        parts = [k for k in range(0, len(counts), PART) if counts[k : k + PART].any()]
        arrays = [pa.array([lang] * len(parts)), pa.array([k // PART for k in parts], pa.int32()), pa.array([counts[k : k + PART].tobytes() for k in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "part", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-gram counts by language, in parts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(raw))
        for lang, found in by.items():
            sums[lang] = sums.get(lang, 0) + np.bincount(np.concatenate(found), minlength=1 << BITS)
        if len(sums) > AT_ONCE:
            yield from _counted(sums)
            sums.clear()
    yield from _counted(sums)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[lang, part] = sums.get((lang, part), 0) + np.frombuffer(raw, np.int64)
    for (lang, part), counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["lang", "part", "counts"])


def training_rows(docs: DataFrame, most: int = MOST_LANGUAGES, lang_col: str = "lang", text_col: str = "text") -> list[tuple[str, np.ndarray]]:
    """(language, n-gram counts) of all labelled texts; ``most`` languages at most,
    those with the most texts."""
    tune(docs.sparkSession)
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("raw")).where("lang IS NOT NULL AND raw IS NOT NULL")
    known = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most + 1).collect()
    if len(known) > most:
        labelled = labelled.where(F.col("lang").isin([r.lang for r in known[:most]]))
    schema = "lang string, part int, counts binary"
    sums = labelled.mapInArrow(_count, schema).repartition("lang", "part").mapInArrow(_total, schema)
    out = {r.lang: np.zeros(1 << BITS, np.int64) for r in known[:most]}
    for r in sums.toLocalIterator():
        out[r.lang][r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, np.int64)
    return sorted(out.items())


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``keep`` columns, lang_pred, score (its proportion) and proportions, in the
    order of ``model.languages``."""
    keep = unclashed(keep, "lang_pred", "score", "proportions")
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    rows, at = with_text(docs, keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, shares = predict(shared.value, texts_of(batch, at), penalty)
            yield pa.RecordBatch.from_arrays(
                [*kept(batch, len(keep)), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.list_(pa.float64()))],
                names=[*keep, "lang_pred", "score", "proportions"],
            )

    return rows.mapInArrow(run, ", ".join([*fields(docs, keep), "lang_pred string, score double, proportions array<double>"]))
