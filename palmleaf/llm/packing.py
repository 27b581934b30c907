"""Hierarchical residual packing of token sequences.

Level 0 runs where the texts are read: a task tokenises its documents, cuts only
those longer than the sequence length, and packs the pieces best-fit decreasing.
Nearly full bins are final there.  What is left, the underfull bins, moves up a
tree as items (a bin id and a length each, never the pieces or their tokens):
``fan_in`` tasks' leftovers meet in one task, are packed best-fit again, nearly
full ones leave, and so on to the root.  A bin that moves up is never opened, so
a piece's place is its place in its first bin plus that bin's place in the last.

The leftovers of a node are bounded.  After best fit two bins of one node never fit
together, so at most one of them is half full or less, and bins that are more than half
full only ever take in such ones.  From elsewhere less than ``fan_in`` of these come to a
node's bins at each level, and a bin that fits any bin fits the one with the most room;
so beside its bin of half or less, only a node's ``LEVELS * fan_in`` bins with the most
room can be of use above.  The others are final: to carry them would save no sequence.

Recovery: level 0 is written to the shared folder before anything reads it twice
and all ids come from it, so a lost executor repeats one task and changes nothing.

Defined results: kept columns named like an operator's own are left out; a null text is an empty one (only the end token); repeated rows
are packed once each; an empty table gives no row; strings of the tokenizer's added tokens
in a text are those tokens, as the tokenizer has it.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.common import fields, kept, stored, texts_of, tune, unclashed, with_text

SEQUENCE = 4096
END_ID = 1
#: A bin with no more free places than this is final.
SLACK = 8
FAN_IN = 8
#: Levels of the tree at most: enough for a thousand million tasks at level 0.
LEVELS = 10
#: Entries of each of a worker's two caches of ids.
CACHE_WORDS = 300_000

#: The normaliser and pre-tokeniser for which ids go word by word: neither looks
#: across white space, and a run of letters or of symbols stands alone.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Symbols, letters and symbols of which no rule of that splitter takes apart more.
_PLAIN = re.compile("([!-&(-/:-@[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Blank-separated words to the bytes of their ids, found when first asked for."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = spec["normalizer"] == _NORMALIZER and splits[0].get("pattern") == {"Regex": _SPLIT} and spec["model"]["type"] == "BPE"
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {}
        added = [t["content"].lower() for t in spec["added_tokens"] if t["content"]]
        #: Texts with one of these are not the sum of their words.
        self.added = re.compile(b"|".join(re.escape(a.encode()) for a in added)) if added else None

    def of(self, raw: bytes) -> bytes:
        """Ids of a text."""
        if not self.by_word or (self.added and self.added.search(raw.lower())):
            return self.whole(raw.decode("utf-8", "replace"))
        return b"".join(map(self.__getitem__, raw.split()))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, run: str) -> bytes:
        """Ids of one lower-case run of letters or of symbols."""
        if run not in self.runs:
            spelt = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            self.runs[run] = np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
        return self.runs[run]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain:
            ids = b"".join(self.run(x.lower()) for x in plain.groups() if x)
        else:
            ids = self.whole(text)
        self[word] = ids
        return ids

    def bound(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.runs) > CACHE_WORDS:
            self.runs.clear()


_caches: dict[str, WordIds] = {}


def token_bytes(texts: list[bytes | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers, without the end token.

    Where the vocabulary's splitter allows it, ids of a text are those of its
    blank-separated words in turn, which repeat and are remembered; with another
    splitter each text is encoded at once.
    """
    if path not in _caches:
        _caches.clear()
        _caches[path] = WordIds(path)
    ids = _caches[path]
    out = []
    for t in texts:
        out.append(ids.of(t) if t else b"")
        ids.bound()
    return out


_OWN = (
    "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bin_id", "bin_offset", "bin_size", "final", "task", "item", "into", "at"
)


def best_fit(sizes: list[int], room: int = SEQUENCE) -> list[list[int]]:
    """Best-fit decreasing: item numbers of each bin, in the order of placing."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (free places, bin), sorted
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect.bisect_left(free, (sizes[at], -1))
        if k < len(free):
            left, b = free.pop(k)
        else:
            left, b = room, len(bins)
            bins.append([])
        bins[b].append(at)
        if left > sizes[at]:
            bisect.insort(free, (left - sizes[at], b))
    return bins


def rising(sizes: list[int], room: int, slack: int, fan_in: int) -> set[int]:
    """Which of a node's bins move up: those of half or less, and the others with the
    most room, unless they are nearly full."""
    open_ = sorted((size, k) for k, size in enumerate(sizes) if size < room - slack)
    small = [k for size, k in open_ if 2 * size <= room]
    return {*small, *(k for _, k in open_[len(small) : len(small) + LEVELS * fan_in])}


def _pieces(path: str, at_text: int, keep: list[str], room: int, end_id: int, slack: int, fan_in: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(5)]
        keeps: list[pa.Array] = []
        rows = 0
        for batch in batches:
            source: list[int] = []
            for row, ids in enumerate(token_bytes(texts_of(batch, at_text), path)):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, room)):
                    part = ids[4 * start : 4 * (start + room)]
                    source.append(row)
                    for column, value in zip(columns, (piece, start, len(part) // 4, zlib.crc32(part), 0), strict=True):
                        column.append(value)
            keeps.append(pa.RecordBatch.from_arrays(kept(batch, len(keep)), names=keep).take(pa.array(source, pa.int64())))
            rows += len(source)
        if not rows:
            return
        # only places are kept for a whole task, a few dozen bytes a piece
        lengths = columns[2]
        bins = best_fit(lengths, room)
        task = TaskContext.get().partitionId()
        bin_id, offset, total, done = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.ones(rows, bool)
        up = rising([sum(lengths[i] for i in members) for members in bins], room, slack, fan_in)
        for number, members in enumerate(bins):
            at = 0
            for i in members:
                bin_id[i], offset[i] = (task << 33) | number, at
                at += lengths[i]
            total[members] = at
            done[members] = number not in up
        places = pa.Table.from_batches(keeps)
        out = pa.table(
            [
                *places.columns,
                pa.array(columns[0], pa.int32()),
                *(pa.array(c, pa.int64()) for c in columns[1:4]),
                pa.array(bin_id),
                pa.array(offset),
                pa.array(total),
                pa.array(done),
                pa.array(np.full(rows, task, np.int64)),
            ],
            names=[*keep, "piece", "start", "length", "ids_crc32", "bin_id", "bin_offset", "bin_size", "final", "task"],
        )
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def _merge(room: int, slack: int, last: bool, fan_in: int):
    """One task packs the items of its node: bins that came from below."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("item", "ascending")])
        items, sizes = table.column("item").to_pylist(), table.column("size").to_pylist()
        rows = []
        bins = best_fit(sizes, room)
        totals = [sum(sizes[i] for i in members) for members in bins]
        up = set() if last else rising(totals, room, slack, fan_in)
        for number, members in enumerate(bins):
            at = 0
            for i in members:
                rows.append((items[i], items[members[0]], at, totals[number], number not in up, key[0].as_py()))
                at += sizes[i]
        return pa.table(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.bool_(), pa.int64()), strict=True)],
            names=["item", "into", "at", "total", "final", "node"],
        )

    return run


def pack(
    docs: DataFrame,
    keep: list[str],
    tokenizer_path: str,
    room: int = SEQUENCE,
    end_id: int = END_ID,
    slack: int = SLACK,
    fan_in: int = FAN_IN,
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: ``keep`` columns, piece, start, length, ids_crc32,
    sequence_id and offset."""
    keep = unclashed(keep, *_OWN)
    tune(docs.sparkSession)
    schema = ", ".join(
        [
            *fields(docs, keep),
            "piece int, start bigint, length bigint, ids_crc32 bigint, bin_id bigint",
            "bin_offset bigint, bin_size bigint, final boolean, task bigint",
        ]
    )
    rows, at = with_text(docs, keep, text_col)
    pieces = stored(rows.mapInArrow(_pieces(tokenizer_path, at, keep, room, end_id, slack, fan_in), schema), "pieces")

    # underfull bins: one row each, from the row of their first piece
    below = pieces.where(~F.col("final") & (F.col("bin_offset") == 0)).select(
        F.col("bin_id").alias("item"), F.col("bin_size").alias("size"), F.col("task").alias("node")
    )
    width = pieces.agg(F.max("task")).head()[0]
    places = below.select("item", F.col("item").alias("into"), F.lit(0).cast("bigint").alias("at"))
    nodes = 0 if width is None else width + 1
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        level = below.withColumn("node", F.floor(F.col("node") / fan_in).cast("bigint"))
        level = stored(
            level.groupBy("node").applyInArrow(
                _merge(room, slack, nodes == 1, fan_in),
                "item bigint, into bigint, at bigint, total bigint, final boolean, node bigint",
            ),
            "bins",
        )
        step = level.select(F.col("item").alias("into"), F.col("into").alias("next"), F.col("at").alias("more"))
        places = stored(
            places.join(step, "into", "left").select(
                "item",
                F.coalesce("next", "into").alias("into"),
                (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"),
            ),
            "places",
        )
        below = level.where(~F.col("final") & (F.col("at") == 0)).select(
            F.col("into").alias("item"), F.col("total").alias("size"), "node"
        )
    columns = [*keep, "piece", "start", "length", "ids_crc32"]
    done = pieces.where("final").select(*columns, F.col("bin_id").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    moved = pieces.where(~F.col("final")).join(places, pieces["bin_id"] == places["item"]).select(
        *columns, F.col("into").alias("sequence_id"), (F.col("bin_offset") + F.col("at")).alias("offset")
    )
    return done.unionByName(moved)
