"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by single spaces.  Every window
of ``width`` consecutive words of a benchmark item (a shorter item is one
window) becomes one pattern of the automaton; each document is scanned once, and
the matches are mapped back to word numbers and to character offsets of the
original text.

The pattern set is the stated query set of the operator.  Windows are made where the
benchmark is read, and measured before they are shipped: up to ``block_bytes`` they are
one automaton and one scan.  A larger set is dealt by hash into blocks of that size;
the documents, numbered in the shared folder, are then scanned in one job a block, and
the hits of a document are merged by its number.  So the driver and each worker hold
one block and one automaton at a time.

Defined results: kept columns named like an operator's own are left out; a null or wordless text has no words, no hits and is clean; a
null or wordless item has no window; repeated items with the same id count once;
items with a null id can mark words but have no id to report.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.common import fields, kept, stored, texts_of, tune, unclashed, with_text

WIDTH = 10
#: Bytes of pattern text in one automaton block.
BLOCK_BYTES = 16 << 20

#: A-Z to lower case; every other ASCII byte that is no digit or letter to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


def _spaced(words: list[bytes]) -> str:
    # one character a byte: the automaton then walks bytes, not code points
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows(raw: bytes | None, width: int = WIDTH) -> set[str]:
    """The patterns of an item."""
    words = words_of(raw)
    return {_spaced(words[at : at + width]) for at in range(max(1, len(words) - width + 1) if words else 0)}


def patterns(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(pattern, item_id) of all windows, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p.encode("latin-1"), item) for item, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in windows(raw, width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["pattern", "item_id"]
            )

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return items.mapInArrow(run, "pattern binary, item_id string").distinct()


def block(rows: list) -> list[tuple]:
    """Patterns as (text, number of words, item ids)."""
    found: dict[str, list] = {}
    for pattern, item in rows:
        found.setdefault(bytes(pattern).decode("latin-1"), []).append(item)
    return [(text, text.count(" ") - 1, ids) for text, ids in sorted(found.items())]


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, block: list[tuple]) -> ahocorasick.Automaton | None:
    """Built once a worker; only the latest is kept, so blocks don't add up."""
    if name not in _built:
        _built.clear()
        auto = ahocorasick.Automaton()
        for number, (text, n, _) in enumerate(block):
            auto.add_word(text, (n, number))
        if block:
            auto.make_automaton()
        _built[name] = auto
    return _built[name] if len(_built[name]) else None


def _hits(normal: str, auto, ids: list[tuple]) -> tuple[np.ndarray | None, set]:
    """Word flags and the item ids found in one normalised text."""
    found = list(auto.iter(normal))
    if not found:
        return None, set()
    breaks = np.cumsum(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
    marks = np.zeros(int(breaks[-1]) + 1, np.int32)
    items: set = set()
    for end, (n, number) in found:
        last = int(breaks[end]) - 1  # the closing space ends this word
        marks[last - n] += 1
        marks[last] -= 1
        items.update(ids[number][2])
    return np.cumsum(marks)[: int(breaks[-1]) - 1] > 0, items


def char_spans(text: str, flags: np.ndarray) -> list[list[int]]:
    """Maximal runs of hit words as [start, end) code points of the original."""
    spans: list[list[int]] = []
    before = -2
    for number, word in enumerate(_WORD.finditer(text)):
        if flags[number]:
            if before == number - 1:
                spans[-1][1] = word.end()
            else:
                spans.append([word.start(), word.end()])
            before = number
    return spans


def _found(texts: list[bytes | None], name: str, part: Broadcast) -> tuple[list[int], list, list[set]]:
    """Numbers of words, word flags and items of each text."""
    auto = _automaton(name, part.value)
    words = [words_of(raw) for raw in texts]
    hits = [_hits(_spaced(w), auto, part.value) if w and auto is not None else (None, set()) for w in words]
    return [len(w) for w in words], [f for f, _ in hits], [ids for _, ids in hits]


_OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_spans"]


def _report(texts: list[bytes | None], counts: list[int], flags: list, items: list[set]) -> list[pa.Array]:
    """Columns ``_OUT``."""
    named = [sorted(i for i in ids if i is not None) for ids in items]
    spans = [char_spans(raw.decode("utf-8", "replace"), f) if f is not None else [] for raw, f in zip(texts, flags, strict=True)]
    return [
        pa.array(counts, pa.int64()),
        pa.array([0 if f is None else int(f.sum()) for f in flags], pa.int64()),
        pa.array([len(x) for x in named], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]),
        pa.array([f is not None for f in flags]),
        pa.array(named, pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
    ]


def _scan(name: str, part: Broadcast, at_text: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, at_text)
            yield pa.RecordBatch.from_arrays([*kept(batch, len(keep)), *_report(texts, *_found(texts, name, part))], names=[*keep, *_OUT])

    return run


def _scan_block(name: str, part: Broadcast):
    """(number, first and last words of runs, items) of the documents hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, flags, items = _found(texts_of(batch, 1), name, part)
            rows = [k for k, f in enumerate(flags) if f is not None]
            edges = [np.flatnonzero(np.diff(np.concatenate(([0], flags[k].astype(np.int8), [0])))).tolist() for k in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(edges, pa.list_(pa.int64())), pa.array([list(items[k]) for k in rows], pa.list_(pa.string()))],
                names=["row", "runs", "items"],
            )

    return run


def _joined(at_text: int, keep: list[str]):
    """The report from the runs and items of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, at_text)
            counts, flags, items = [len(words_of(raw)) for raw in texts], [], []
            for n, runs, found in zip(counts, batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                mark = np.zeros(n, bool)
                for edges in runs or []:
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        mark[a:b] = True
                flags.append(mark if runs else None)
                items.append({i for ids in found or [] for i in ids})
            yield pa.RecordBatch.from_arrays([*kept(batch, len(keep)), *_report(texts, counts, flags, items)], names=[*keep, *_OUT])

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    width: int = WIDTH,
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns of ``docs`` plus n_words, n_hit, n_items, items_sha256,
    contaminated, item_ids and hit_spans ([start, end) code points)."""
    keep = unclashed(keep, *_OUT)
    spark = tune(docs.sparkSession)
    found = stored(patterns(benchmark, width), "patterns")
    size = found.agg(F.sum(F.length("pattern"))).head()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = ", ".join(
        [
            *fields(docs, keep),
            "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string",
            "contaminated boolean, item_ids array<string>, hit_spans array<array<bigint>>",
        ]
    )
    rows, at = with_text(docs, keep, text_col)
    if blocks == 1:
        return rows.mapInArrow(_scan(uuid.uuid4().hex, spark.sparkContext.broadcast(block(found.collect())), at, keep), schema)
    # whole rows in a struct: their columns may have any names
    numbered = stored(rows.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("doc")), "numbered")
    texts = numbered.select("row", F.col(f"doc.`{rows.columns[at]}`").alias("text"))
    hits = None
    for k in range(blocks):
        part = spark.sparkContext.broadcast(block(found.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()))
        one = stored(texts.mapInArrow(_scan_block(uuid.uuid4().hex, part), "row bigint, runs array<bigint>, items array<string>"), "hits")
        part.destroy()
        hits = one if hits is None else hits.union(one)
    merged = hits.groupBy("row").agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))
    whole = numbered.join(merged, "row", "left").select(*[F.col(f"doc.`{c}`").alias(c) for c in rows.columns], "runs", "items")
    return whole.mapInArrow(_joined(at, keep), schema)
