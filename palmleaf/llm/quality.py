"""Quality rules as a bitmask ledger.

Every rule is evaluated once on a whole text.  The ledger keeps the measurements
and one bit for each failed rule; versioned policies are masks over these bits,
so applying or comparing policies never reads a text again, and ablations come
from bitwise aggregation over the few distinct masks.

Defined results: kept columns named like an operator's own are left out; a null text is an empty one; a text without words fails
``few_words`` and no rule that needs a ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.common import fields, kept, texts_of, tune, unclashed, with_text

#: Rule -> bit.  A bit is never given to another rule: old ledgers stay readable.
RULES = {
    "few_words": 0,
    "repeated_words": 1,
    "many_symbols": 2,
    "repeated_lines": 3,
    "odd_word_length": 4,
    "few_letters": 5,
}
BASE = (1 << RULES["few_words"]) | (1 << RULES["repeated_words"])
#: Version -> mask of the rules that drop a document.
POLICIES = {
    "v1": BASE,
    "v2": BASE | 1 << RULES["many_symbols"] | 1 << RULES["repeated_lines"],
    "v3": (1 << len(RULES)) - 1,
}
CURRENT = "v3"
_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\t\n\x0b\x0c\r "
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")
SPAN = 5
#: Odd multipliers that mix the hashes of the words of one window.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _repeated(words: list[bytes]) -> int:
    """Words inside any five-word window that occurs twice or more."""
    n = len(words) - SPAN + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * _MIX[0]
    window = np.zeros(n, np.uint64)
    for k in range(SPAN):
        window = (window ^ (window >> np.uint64(31))) * _MIX[k] + h[k : k + n]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + SPAN, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(raw: bytes | None) -> tuple[int, ...]:
    """The measurements of one text in the order of ``_FIELDS``."""
    if not raw:
        return (0,) * len(_FIELDS)
    words = raw.split()  # bytes split on exactly space and \t-\r
    solid = raw.translate(None, _SPACES)
    codes = np.frombuffer(solid, np.uint8)
    chars = int(((codes & 0xC0) != 0x80).sum())
    symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    letters = int(((codes >= 0xC0) | (((codes | 32) >= 97) & ((codes | 32) <= 122) & (codes < 128))).sum())
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines), letters


def _ledger(at_text: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x) for x in texts_of(batch, at_text)]
            found = np.array(rows, np.int64).reshape(len(rows), len(_FIELDS))
            yield pa.RecordBatch.from_arrays(
                [*kept(batch, len(keep)), *(pa.array(found[:, k]) for k in range(len(_FIELDS)))], names=[*keep, *_FIELDS]
            )

    return run


def _mask():
    c = F.col
    failed = {
        "few_words": c("n_words") < 10,
        "repeated_words": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "many_symbols": (c("n_symbols") > 2) & (100 * c("n_symbols") > 25 * c("n_words")),
        "repeated_lines": (c("n_dup_lines") > 2) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "odd_word_length": (c("n_words") > 0)
        & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        "few_letters": (c("n_words") > 0) & (100 * c("n_letters") < 50 * c("word_chars")),
    }
    bits = [F.when(failed[rule], F.lit(1 << bit)).otherwise(F.lit(0)) for rule, bit in RULES.items()]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def ledger(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, the measurements and ``failed`` (bit k: rule k failed)."""
    keep = unclashed(keep, *_FIELDS, "failed")
    tune(docs.sparkSession)
    rows, at = with_text(docs, keep, text_col)
    schema = ", ".join([*fields(docs, keep), *(f"{x} bigint" for x in _FIELDS)])
    return rows.mapInArrow(_ledger(at, keep), schema).withColumn("failed", _mask())


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy version."""
    return book.withColumns(
        {
            "base_failed": F.col("failed").bitwiseAND(F.lit(BASE)) != 0,
            "kept": F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0,
        }
    )


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it drops, and
    that stay if it is left out.  One count for each distinct mask is shuffled."""
    spark, policy = book.sparkSession, POLICIES[version]
    masks = book.groupBy("failed").agg(F.count("*").alias("n"))
    rules = [(name, 1 << bit) for name, bit in RULES.items() if policy >> bit & 1]
    per = masks.select("n", "failed", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in rules])).alias("r"))
    hit = F.col("failed").bitwiseAND(F.lit(policy))
    return per.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
