"""Near-duplicates by Order MinHash and banded alignment.

Similarity is the edit similarity of two texts' lower-cased words: 1 - edits / words
of the longer text, at least ``SIMILARITY``.

Sketches.  A k-mer is ``k`` words in a row, labelled with its occurrence number in
the text.  Each of ``SKETCHES`` hash functions picks the two smallest labelled k-mers
and keeps them in text order, so two texts agree in a sketch only if they share both
passages in the same order: the chance falls with edit distance, not only with set
difference.  k goes by the length of the shorter text (``k_of``): single words of the
shortest texts, pairs, then triples; a text whose partners may fall on both sides of a
border has sketches of both kinds.  One agreement makes a candidate.  At the least
similarity, a fifth of the words edited, triples spread over the text at random agree
in 7 to 8 of 64 sketches on average and miss each other in one pair of 3,000; with
an edit in exactly every fifth word, the worst case, in one of 60.

Candidates.  First each text meets the hub of the most of its buckets (a bucket, a
sketch's value, has its smallest text as hub); then, where a bucket still holds several
components of the accepted links, those outside the commonest one meet one of its texts.
Both only if the bounds below allow it.  At last, in every bucket that
is still mixed, all texts of different components meet: no link is left to the luck of
a hub.  Buckets of more than ``SMALL`` texts would square there;
their texts meet by an exact prefix filter instead, in which the sketches play no part.

Prefix filter.  An edit spoils one word at most, so of the ``n`` words of the longer
text, labelled with their occurrence numbers, two near texts share ``n - e`` with ``e``
the allowed edits; whatever the order of all words, they then share one of each text's
first ``e + 1`` in it.  The order is from rare to common (by a table of hashed counts,
which affects the number of candidates only), so no pair of these texts is lost, and a
passage that many of them hold is a key only of texts that are hardly anything else.  A
pair meets by a word only where it may be the first that they share: the words after it
must be enough for the rest, which ends pairs that have just such a passage in common.

Before any text is moved, a pair must pass a lower bound of its edits: ``BINS`` word
counts by hash, of which an edit moves two at most.  What passes is decided by the
banded alignment alone.

Classes are the connected components of the accepted links; exact copies are one text
from the start and are never paired with each other.  All links, sketches and labels
stay distributed; the driver sees counts.  Tables that are read twice are written to the
shared folder, and removed when nothing reads them any more.

Defined results: a null text is a class of its own; texts without words are near
nothing, but exact copies of one are one class; class_id is the smallest doc_id of the
class (null if all are null); repeated rows share a class; an empty table gives no row.
Columns of the input other than the id and the text are not read by ``classes`` and pass
through ``deduplicate`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.common import discard, stored, tune
from palmleaf.llm.decontaminate import _FOLD

SKETCHES = 64
SIMILARITY = 0.8
#: Words of the shorter text from which k-mers of 2 and of 3 words are sampled.
K_FROM = ((48, 3), (16, 2), (0, 1))
#: Places of the word counts that bound a pair's edits from below.
BINS = 64
#: Rounds in which texts meet one of the commonest component, before all of them meet.
TURNS = 1
#: Texts of a bucket that meet in it; those of larger ones meet by the prefix filter.
SMALL = 256
#: Hash values held at once while a text is sketched.
CELLS = 1 << 21
#: Bits of a word's place in the table of counts: a byte each, sent to all tasks.
COUNT_BITS = 24
#: Places of the table that are summed together.
CHUNK = 1 << 16
#: Texts of a block: blocks of a bucket of the prefix filter meet in different tasks.
BLOCK = 256
#: Words before a shared one, in the order of the prefix filter, that are looked at for
#: an earlier one.  It changes how often a pair is found, not whether.
PRIOR = 16
#: Rows of the prefix filter that meet at once: the larger of this number and this share
#: of all words.  More of them meet in several passes, which bounds the disk they take.
PASS_ROWS, PASS_SHARE = 1_000_000, 1 / 64
#: Parts in which the partners of a text are listed.
PARTS = 16
#: Rows of a table of names up to which it is sent to all tasks: some 30 bytes each.
NAMES = 400_000
#: Rows of the alignment whose bits are one number; longer texts have several.
ROWS = 1 << 14

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(9)
_SEEDS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * _U(2) + _U(1)
_PLACES = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) * _U(2) + _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n; kept while short."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 22:
            return up, down
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def word_hashes(raw: bytes | None) -> np.ndarray:
    """A hash of each word of a text, equal in every process."""
    if not raw:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(raw.translate(_FOLD), np.uint8)
    inside = np.concatenate(([False], b != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)], dtype=np.uint64)))
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def k_of(n: int) -> int:
    """Words of a k-mer if the shorter text of a pair has n."""
    return next(k for least, k in K_FROM if n >= least)


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words; a shorter text is one window."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return _mix((words * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True))
    out = words[: n - k + 1] * _PLACES[0]
    for at in range(1, k):
        out = out + words[at : n - k + 1 + at] * _PLACES[at]
    return _mix(out)


def labelled(mers: np.ndarray) -> np.ndarray:
    """K-mer hashes joined with their occurrence numbers: all different."""
    order = np.argsort(mers, kind="stable")
    sorted_ = mers[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    if first.all():
        return _mix(mers)
    at = np.arange(len(mers))
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(mers)
    out[order] = sorted_ + occurrence.astype(np.uint64) * _BASE
    return _mix(out)


def sketch(words: np.ndarray, k: int) -> np.ndarray:
    """One number a sketch: its two k-mers in text order, and the sketch's own."""
    mers = kmers(words, k)
    if not len(mers):
        return np.zeros(0, np.int64)
    names = labelled(mers)
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, CELLS // len(names))
    for at in range(0, SKETCHES, step):
        table = names[None, :] * _SEEDS[at : at + step, None]
        rows = np.arange(len(table))
        one = table.argmin(axis=1)
        if len(names) == 1:
            two = one
        else:
            table[rows, one] = np.iinfo(np.uint64).max
            two = table.argmin(axis=1)
        left, right = np.minimum(one, two), np.maximum(one, two)
        out[at : at + step] = _mix(mers[left] * _PLACES[0] + mers[right] * _PLACES[1] + _SEEDS[at : at + step] + _U(k))
    return out.view(np.int64)


def sketches(words: np.ndarray, similarity: float) -> np.ndarray:
    """The sketches of all kinds that a pair with the text may have."""
    n = len(words)
    kinds = sorted({k_of(m) for m in (n, n - allowed(n, similarity))})
    return np.concatenate([sketch(words, k) for k in kinds])


def bag(words: np.ndarray) -> np.ndarray:
    """Word counts by hash, cut off where a byte ends."""
    return np.minimum(np.bincount((words >> _U(40)).astype(np.int64) % BINS, minlength=BINS), 127).astype(np.int8)


def allowed(n: int, similarity: float) -> int:
    """Edits that the similarity allows to texts of which the longer has n words."""
    return int((1 - similarity) * n + 1e-9)


def _places(names: np.ndarray) -> np.ndarray:
    return (names >> _U(64 - COUNT_BITS)).astype(np.int64)


def _codes(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: exact below 128, then by eighths of an octave."""
    large = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128))
    return np.where(counts < 128, counts, np.minimum(large, 255)).astype(np.uint8)


def rare_words(words: np.ndarray, codes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The text's prefix of labelled words from rare to common, without those that no
    other text has, and their places in that order."""
    names = labelled(words)
    code = codes[_places(names)].astype(np.uint64)
    order = np.sort((code << _U(56)) | (names & _U((1 << 56) - 1)))
    first = order[: allowed(len(words), similarity) + 1]
    known = np.flatnonzero(first >> _U(56) > 1)
    return first[known].view(np.int64), known.astype(np.int32)


def _columns_of(a: np.ndarray, width: int) -> Callable[[int, int], int]:
    """(word, row) -> number whose bit b tells whether the word is at row + b."""
    n, full = len(a), (1 << width) - 1
    masks: list[dict[int, int]] = []
    for start in range(0, n, ROWS):
        masks.append(found := {})
        for k, word in enumerate(a[start : start + ROWS].tolist()):
            found[word] = found.get(word, 0) | 1 << k
    if len(masks) == 1:
        only = masks[0].get
        return lambda word, row: (only(word, 0) >> row if row >= 0 else only(word, 0) << -row) & full

    def bits(word: int, row: int) -> int:
        first, last = max(row, 0) // ROWS, min(row + width - 1, n - 1) // ROWS
        whole = int.from_bytes(b"".join(m.get(word, 0).to_bytes(ROWS // 8, "little") for m in masks[first : last + 1]), "little")
        row -= first * ROWS
        return (whole >> row if row >= 0 else whole << -row) & full

    return bits


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the word edit distance is at most ``most``: the alignment inside the
    band of that half-width, a column of the band at a time as bits of one number
    (differences between neighbouring cells, all rows at once)."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    if not most:
        return bool((a == b).all())
    width = 2 * most + 1
    full, goal = (1 << width) - 1, n - m + most  # the last cell's diagonal
    column = _columns_of(a, width)
    up, down, edits = full ^ ((1 << most) - 1), 0, abs(n - m)
    for j, word in enumerate(b.tolist()):
        same = column(word, j - most)
        flat = ((((same & up) + up) ^ up) | same | down) & full  # a diagonal step without an edit
        right, left = down | (full ^ (flat | up)), flat & up
        if j + n - m >= 0 and not flat >> goal & 1:
            edits += 1
            if edits > most:
                return False
        flat >>= 1  # the band moves a row down
        up, down = left | (full ^ (flat | right)), flat & right
    return True


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the aligned words differ in at most the allowed edits: simple bounds
    either way first, then the band."""
    n, m = len(a), len(b)
    longer = max(n, m)
    most = allowed(longer, similarity)
    if not longer or min(n, m) < longer - most:
        return False
    if n == m and (a != b).sum() <= most:
        return True
    if len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < longer - most:
        return False  # an edit spoils one word at most
    return within(a, b, most)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by place of their labelled words: sparse sums of a task, by chunk."""
    counts = np.zeros(1 << COUNT_BITS, np.uint32)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            np.add.at(counts, _places(labelled(word_hashes(raw))), 1)
    for chunk in range(0, len(counts), CHUNK):
        part = counts[chunk : chunk + CHUNK]
        at = np.flatnonzero(part)
        if len(at):
            arrays = [[chunk // CHUNK], [at.astype(np.uint16).tobytes()], [part[at].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "at", "n"])


def _sum_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = sums.setdefault(chunk, np.zeros(CHUNK, np.int64))
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
    for chunk, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([_codes(total).tobytes()], pa.binary())], names=["chunk", "codes"])


def word_codes(raws: DataFrame) -> np.ndarray:
    """How many texts have a labelled word, as a byte by place; only this table of
    fixed size reaches the driver."""
    tallies = raws.mapInArrow(_tally, "chunk int, at binary, n binary")
    sums = tallies.repartition(16, "chunk").mapInArrow(_sum_tallies, "chunk int, codes binary")
    out = np.zeros(1 << COUNT_BITS, np.uint8)
    for r in sums.collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.codes, np.uint8)
    return out


def _sketches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [word_hashes(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.md5(t).digest() if t is not None else None for t in texts], pa.binary()),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([bag(w) for w in words], pa.list_(pa.int8())),
                    pa.array([sketches(w, similarity) if len(w) else [] for w in words], pa.list_(pa.int64())),
                ],
                names=["id", "content", "n", "bag", "keys"],
            )

    return run


def _rare(shared, similarity: float):
    """(num, root, n, bag) of a text and its prefix, a row a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            words = [word_hashes(t) for t in batch.column(2).to_pylist()]
            rare = [rare_words(w, codes, similarity) for w in words]
            keys, at = ([r[k] for r in rare] for k in range(2))
            own = [pa.array([len(w) for w in words], pa.int64()), pa.array([bag(w) for w in words], pa.list_(pa.int8()))]
            lists = [pa.array(keys, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own, *lists], names=["num", "root", "n", "bag", "keys", "at"])

    return run


def _words(rare: DataFrame, part: int, parts: int) -> DataFrame:
    """A row for each word of the prefixes that is of this part, with those before it."""

    def word(key: Column, k: Column) -> Column:
        prior = F.slice("keys", F.greatest(k - PRIOR, F.lit(0)) + 1, F.least(k, F.lit(PRIOR)))
        return F.struct(key.alias("key"), F.get("at", k).alias("at"), prior.alias("prior"))

    mine = F.filter(F.transform("keys", word), lambda x: F.pmod(x["key"], F.lit(parts)) == part)
    # dealt anew: the files of these short rows are few, and each gives many more
    return rare.repartition("num").select("num", "root", "n", "bag", F.inline(mine))


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashes = [None, None], [None, None]
        for batch in batches:
            keep = []
            for pair in zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
                for k, text in enumerate(pair):
                    if text != last[k]:  # rows of a text come in runs
                        last[k], hashes[k] = text, word_hashes(text)
                keep.append(similar(*hashes, similarity))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def content_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _near(similarity: float) -> Column:
    """Whether the lengths and word counts of x and y leave room for the similarity:
    s words replaced and d more or less move the counts by 2 * s + d at most."""
    small, large = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    most = F.floor((1 - similarity) * large + 1e-9)
    # lengths first: the counts are only summed where these allow it
    return F.when(small < large - most, False).otherwise(_apart() <= 2 * most - (large - small))


def _first_shared(similarity: float) -> Column:
    """Whether a shared word of x and y may be their first in the order: no more words
    than those from it on are shared then, and these must be enough; and none of those
    just before it is shared (by that one the pair meets, or by one before it)."""
    large = F.greatest("x_n", "y_n")
    enough = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= large - F.floor((1 - similarity) * large + 1e-9)
    return enough & ~F.arrays_overlap("x_prior", "y_prior")


def _apart() -> Column:
    return F.aggregate(F.zip_with("x_bag", "y_bag", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, d: s + d)


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("num").alias(name), F.col("n").alias(f"{name}_n"), F.col("bag").alias(f"{name}_bag"))


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (x, y) that the bounds let through."""
    return pairs.join(_side(nodes, "x"), "x").join(_side(nodes, "y"), "y").where(_near(similarity)).select("x", "y")


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, num, root) of buckets with several roots, with the bucket's commonest
    root ``top`` and its ``size``."""
    by_root = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    tops = by_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("t"), F.sum("c").alias("size"), F.count("*").alias("roots"))
    return rows.join(tops.where("roots > 1").select("key", F.col("t.root").alias("top"), "size"), "key")


def _across(few: DataFrame, all_: DataFrame, on: list[str], near: Column) -> DataFrame:
    """Pairs (x, y) of different roots: one of them is not of the commonest root, so
    texts of that root are never tried with each other."""
    extra = [c for c in few.columns if c not in ("num", "root", "top", "size", *on)]
    x = few.where("root <> top").select(*on, F.col("num").alias("x"), F.col("root").alias("x_root"), *[F.col(c).alias(f"x_{c}") for c in extra])
    y = all_.select(*on, F.col("num").alias("y"), F.col("root").alias("y_root"), (F.col("root") == F.col("top")).alias("common"), *[F.col(c).alias(f"y_{c}") for c in extra])
    once = (F.col("x_root") != F.col("y_root")) & (F.col("common") | (F.col("x") < F.col("y")))
    return x.join(y, on).where(once & near)


def _most_met(pairs: DataFrame, *by: str) -> DataFrame:
    """Of each text's pairs, a row a bucket, the one (x, y) with the most buckets: to
    begin with, a text meets one text, not one in each of its buckets."""
    met = pairs.groupBy("x", *by).agg(F.count("*").alias("c"))
    return met.groupBy(*by).agg(F.min_by("x", F.struct(-F.col("c"), "x")).alias("x")).select("x", "y")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _by_prefix(members: DataFrame, nodes: DataFrame, raw: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the members (num, root) that the prefix filter and the bounds leave."""
    named = stored(members.join(nodes.select("num", "first_id", "content"), "num"), "members")
    texts = stored(_texts(named, raw, "num", "root"), "member-texts")
    shared = raw.sparkSession.sparkContext.broadcast(word_codes(texts.select("raw")))
    rare = stored(texts.mapInArrow(_rare(shared, similarity), "num bigint, root bigint, n bigint, bag array<tinyint>, keys array<bigint>, at array<int>"), "rare")
    for done in (named, texts):
        discard(done)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    passes = max(1, math.ceil((rare.agg(F.sum(F.size("keys"))).first()[0] or 0) / max(PASS_ROWS, PASS_SHARE * total)))
    found = None
    for k in range(passes):
        mixed = stored(_mixed(_words(rare, k, passes)), "words")
        # a large bucket is dealt in blocks: each pair of a text and a block meets in one place
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        few = mixed.where("root <> top").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = mixed.withColumn("block", F.pmod(F.col("num"), blocks).cast("int"))
        pairs = stored(_ordered(_across(few, dealt, ["key", "block"], _first_shared(similarity) & _near(similarity))), "met")
        discard(mixed)
        found = pairs if found is None else found.union(pairs)
    discard(rare)
    return found


def _open(buckets: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets whose texts the links do not join yet."""
    roots = nodes.select("num", "content").join(labels.select("content.content", F.xxhash64("root.content").alias("root")), "content", "left")
    roots = roots.select("num", F.coalesce("root", "num").alias("root"))
    return stored(_mixed(buckets.select("key", "num").join(roots, "num")), "mixed")


def _to_common(mixed: DataFrame, nodes: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Texts outside a bucket's commonest component with one text of it, another one in
    each bucket: nearly all that belong to a large group join it here."""
    # one order of the texts in all buckets, so that those of a text have few answers
    one = mixed.where("root = top").groupBy("key").agg(F.max_by("num", F.xxhash64("num", F.lit(turn))).alias("x"))
    pairs = mixed.where("root <> top").select("key", "top", F.col("num").alias("y")).join(one, "key")
    return _ordered(_possible(_most_met(pairs, "y", "top"), nodes, similarity))


def _unlinked(mixed: DataFrame, nodes: DataFrame, raw: DataFrame, similarity: float) -> DataFrame:
    """All pairs of a bucket that the links do not join yet."""
    small = mixed.where(F.col("size") <= SMALL).join(nodes.select("num", "n", "bag"), "num")
    pairs = _ordered(_across(small, small, ["key"], _near(similarity)))
    members = stored(mixed.where(F.col("size") > SMALL).select("num", "root").distinct(), "crowd")
    if not members.isEmpty():
        pairs = pairs.union(_by_prefix(members, nodes, raw, similarity)).distinct()
    return pairs


def _texts(named: DataFrame, raw: DataFrame, *names: str) -> DataFrame:
    """(names, raw) of named texts (content, first_id), each from a row with its first id."""
    wanted = named.select(*names, F.col("content").alias("c"), "first_id")
    if named.count() <= NAMES:
        wanted = F.broadcast(wanted)
    found = raw.where("raw IS NOT NULL").join(wanted, (F.unhex(F.md5("raw")) == F.col("c")) & F.col("id").eqNullSafe(F.col("first_id")))
    return found.select(*names, "raw").dropDuplicates([names[0]])


def _accepted(pairs: DataFrame, nodes: DataFrame, raw: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the names of texts whose pairs the alignment accepts.
    Only texts of candidates are moved; x's, of which many may have the same, once for
    each list of its partners.  Only accepted pairs are named."""
    pairs = stored(pairs, "candidates")
    wanted = pairs.select(F.col("x").alias("num")).union(pairs.select("y")).distinct()
    named = stored(wanted.join(nodes.select("num", "first_id", "content"), "num"), "wanted")
    chosen = stored(_texts(named, raw, "num"), "candidate-texts")
    # rows without texts are small: a fixed number of tasks, or few would align them all
    tasks = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pairs.withColumn("part", F.pmod(F.xxhash64("y"), F.lit(PARTS))).repartition(tasks, "x", "part")
    lists = parts.groupBy("x", "part").agg(F.collect_list("y").alias("ys"))
    ones = lists.join(chosen.select(F.col("num").alias("x"), F.col("raw").alias("one")), "x").select("x", "one", F.explode("ys").alias("y"))
    both = ones.join(chosen.select(F.col("num").alias("y"), F.col("raw").alias("two")), "y")
    links = both.select("x", "y", "one", "two").mapInArrow(_verify(similarity), "x bigint, y bigint")
    label = F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "content")
    name = lambda num, c: named.select(F.col("num").alias(num), label.alias(c))
    links = stored(stored(links, "accepted").join(name("x", "a"), "x").join(name("y", "b"), "y").select("a", "b").distinct(), "links")
    for done in (pairs, chosen):
        discard(done)
    return links


def components(links: DataFrame) -> DataFrame:
    """(content, root) of the names that the links' first two columns join: the
    smallest name of a component stands for it.

    Each round points every text to its smallest neighbour and on to that one's,
    then contracts the graph: links between texts of the same root vanish, so a
    star is gone after one round and later rounds see few links.
    """
    edges = stored(links.toDF("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up"))
        beyond = near.select(F.col("a").alias("up"), F.col("up").alias("top"))
        step = stored(near.join(beyond, "up", "left").select("a", F.coalesce("top", "up").alias("to")), "step")
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            moved = step.select(F.col("a").alias("root"), "to")
            labels = stored(labels.join(moved, "root", "left").select("a", F.coalesce("to", "root").alias("root")), "labels")
        left = edges.join(step.withColumnRenamed("to", "x"), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels.withColumnRenamed("a", "content")


def _classed(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, content) of all rows, and (content, first_id, root) of all texts, with a
    null root where a text is alone."""
    tune(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    sketched = stored(
        raw.mapInArrow(_sketches(similarity), f"id {id_type}, content binary, n bigint, bag array<tinyint>, keys array<bigint>"), "sketches"
    )
    rows = stored(sketched.select("id", "content"), "rows")
    whole = stored(
        sketched.where("content IS NOT NULL").groupBy("content").agg(F.min("id").alias("first_id"), *(F.first(c).alias(c) for c in ("n", "bag", "keys"))),
        "texts",
    )
    discard(sketched)
    # short rows: numbers stand for contents until the texts are compared
    nodes = stored(whole.select(F.xxhash64("content").alias("num"), "content", "first_id", "n", "bag"), "nodes")
    # dealt once, for the hubs and for the join with them
    keyed = whole.select(F.xxhash64("content").alias("num"), F.explode("keys").alias("key")).repartition("key")
    hubs = keyed.groupBy("key").agg(F.min("num").alias("hub"), F.max("num").alias("last")).where("hub <> last")
    buckets = stored(keyed.join(hubs.select("key", "hub"), "key"), "buckets")
    discard(whole)
    tried = _most_met(buckets.where("hub <> num").select(F.col("hub").alias("x"), F.col("num").alias("y")), "y")
    links = _accepted(_possible(tried, nodes, similarity), nodes, raw, similarity)
    for turn in range(TURNS):
        mixed = _open(buckets, nodes, components(links))
        links = links.union(_accepted(_to_common(mixed, nodes, similarity, turn), nodes, raw, similarity))
        discard(mixed)
    mixed = _open(buckets, nodes, components(links))
    discard(buckets)
    links = links.union(_accepted(_unlinked(mixed, nodes, raw, similarity), nodes, raw, similarity))
    discard(mixed)
    return rows, nodes.select("content", "first_id").join(components(links).select("content.content", "root"), "content", "left")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: the id, class_id, content (the text's digest, null for a
    null text) and keeper (the digest that stands for the class)."""
    rows, texts = _classed(docs, id_col, text_col, similarity)
    alone = F.col("root").isNull()
    named = texts.select(
        "content", F.when(alone, F.col("first_id")).otherwise(F.col("root.first_id")).alias("class_id"), F.when(alone, F.col("content")).otherwise(F.col("root.content")).alias("keeper")
    )
    return rows.join(named, "content", "left").select(
        F.col("id").alias(id_col), F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "content", "keeper"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id.  Rows with
    a null text stay."""
    _, texts = _classed(docs, id_col, text_col, similarity)
    kept = texts.where(F.col("root").isNull() | (F.col("root.content") == F.col("content"))).select(F.col("first_id").alias("id"), F.col("content").alias("key"))
    # whole rows in a struct: their columns may have any names
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own"), content_of(F.col(f"`{text_col}`")).alias("digest"))
    stay = marked.where("digest IS NOT NULL").join(kept, (F.col("digest") == F.col("key")) & F.col("own").eqNullSafe(F.col("id")), "left_semi")
    whole = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return stay.dropDuplicates(["own", "digest"]).select(*whole).unionByName(marked.where("digest IS NULL").select(*whole))
