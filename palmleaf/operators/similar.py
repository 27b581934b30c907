"""Sequence similarity and containment of many texts with the entries of a dictionary.

The matched characters of two texts are a common subsequence, so two bounds hold from
above: the characters that both have, by their counts, and the longest common
subsequence.  The latter is found for all entries of a chunk at once, as bits of one
number, a character of the text at a time.  Only pairs that both bounds let through
are compared.  Where the closest entry is wanted, whatever its similarity, a comparison
ends as soon as it cannot reach the best one so far.
"""

from __future__ import annotations

import bisect
import difflib
import itertools
import math
from collections.abc import Iterator

import numpy as np

#: Entries of similar length whose bits are one number.
CHUNK = 64
#: Places of the character counts.
BINS = 64
#: Prepared entries kept at once.
KEPT = 512


def _bag(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes % BINS, minlength=BINS).astype(np.int32)


class _Chunk:
    """Entries at bits of their own, one more than they have, from a multiple of 64 on."""

    def __init__(self, at: list[int], keys: list[str]):
        self.at, self.keys = np.array(at), keys
        self.sizes = np.array([len(k) for k in keys])
        self.bags = np.stack([_bag(k) for k in keys])
        words = self.sizes // 64 + 1
        self.starts = np.cumsum(words) - words
        self.bytes = int(words.sum()) * 8
        places: dict[str, list[int]] = {}
        for key, start in zip(keys, (self.starts * 64).tolist(), strict=True):
            for k, c in enumerate(key):
                places.setdefault(c, []).append(start + k)
        self.masks = {c: self._number(p) for c, p in places.items()}
        self.full = self._number(np.concatenate([np.arange(m) + s * 64 for m, s in zip(self.sizes, self.starts, strict=True)]))

    def _number(self, places) -> int:
        bits = np.zeros(self.bytes * 8, np.uint8)
        bits[places] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def subsequences(self, text: str) -> np.ndarray:
        """Lengths of the longest common subsequences of the text and each entry."""
        masks, full = self.masks, self.full
        open_ = full
        for c in text:
            if (mask := masks.get(c)) is not None:
                met = open_ & mask
                open_ = ((open_ + met) | (open_ ^ met)) & full
        words = np.frombuffer((full ^ open_).to_bytes(self.bytes, "little"), np.uint64)
        return np.add.reduceat(np.bitwise_count(words).astype(np.int64), self.starts)


class _Key:
    """An entry for ``matched``: its characters' places, and those that difflib leaves out."""

    def __init__(self, key: str):
        self.key = key
        self.masks: dict[str, int] = {}
        for k, c in enumerate(key):
            self.masks[c] = self.masks.get(c, 0) | 1 << k
        popular = [c for c, mask in self.masks.items() if mask.bit_count() > len(key) // 100 + 1] if len(key) >= 200 else []
        unused = next(chr(c) for c in range(len(key) + 1) if chr(c) not in self.masks)
        self.hidden = dict.fromkeys(map(ord, popular), unused)

    def subsequence(self, text: str, low: int, high: int) -> int:
        """Length of the longest common subsequence with the entry's part."""
        masks, full = self.masks, ((1 << (high - low)) - 1) << low
        open_ = full
        for c in text:
            if (mask := masks.get(c)) is not None:
                met = open_ & mask
                open_ = ((open_ + met) | (open_ ^ met)) & full
        return (full ^ open_).bit_count()

    def matched(self, text: str, best: float) -> float | None:
        """difflib's ratio of the text to the entry; None if it is below ``best``.  The
        longest common block, first in the text, then in the entry, then the same on
        either side of it; what is left bounds the rest."""
        key, both = self.key, len(text) + len(self.key)
        shown = text.translate(self.hidden) if self.hidden else text
        total, left, first = 0, min(len(text), len(key)), True
        parts = [(0, len(text), 0, len(key), left)]
        while parts:
            a, a_end, b, b_end, bound = parts.pop()
            i, size = a, 0
            for k in range(a, a_end):
                if k + size >= a_end:
                    break
                while k + size < a_end and key.find(shown[k : k + size + 1], b, b_end) >= 0:
                    i, size = k, size + 1
            j = key.find(shown[i : i + size], b, b_end) if size else b
            end, j_end = i + size, j + size
            if self.hidden:
                while i > a and j > b and text[i - 1] == key[j - 1]:
                    i, j = i - 1, j - 1
                while end < a_end and j_end < b_end and text[end] == key[j_end]:
                    end, j_end = end + 1, j_end + 1
            total, left = total + end - i, left - bound
            if end > i:
                for lo, hi, b_lo, b_hi in ((a, i, b, j), (end, a_end, j_end, b_end)):
                    if lo < hi and b_lo < b_hi:
                        rest = self.subsequence(text[lo:hi], b_lo, b_hi) if first else min(hi - lo, b_hi - b_lo)
                        parts.append((lo, hi, b_lo, b_hi, rest))
                        left += rest
                first = False
            if 2.0 * (total + left) / both < best:
                return None
        return 2.0 * total / both


class Entries:
    """A dictionary's texts, none of them empty, prepared for ``near`` and ``closest``."""

    def __init__(self, keys: list[str]):
        order = sorted(range(len(keys)), key=lambda k: len(keys[k]))
        parts = [order[k : k + CHUNK] for k in range(0, len(order), CHUNK)]
        self.chunks = [_Chunk(p, [keys[k] for k in p]) for p in parts]
        self.matchers: dict[str, difflib.SequenceMatcher] = {}
        self.prepared: dict[str, _Key] = {}

    def _ratio(self, text: str, key: str) -> float:
        if (matcher := self.matchers.get(key)) is None:
            if len(self.matchers) >= KEPT:
                self.matchers.clear()
            matcher = self.matchers[key] = difflib.SequenceMatcher(None, "", key)
        matcher.set_seq1(text)
        return matcher.ratio()

    def near(self, text: str, least: float) -> Iterator[tuple[int, float]]:
        """(number, similarity) of the entries to which the text is at least so similar."""
        n = len(text)
        own = _bag(text)
        for chunk in self.chunks:
            both = n + chunk.sizes
            if not (open_ := 2.0 * np.minimum(n, chunk.sizes) / both >= least).any():
                continue
            open_ &= 2.0 * np.minimum(chunk.bags, own).sum(axis=1) / both >= least
            if not open_.any():
                continue
            open_ &= 2.0 * chunk.subsequences(text) / both >= least
            for k in np.flatnonzero(open_).tolist():
                if (sim := self._ratio(text, chunk.keys[k])) >= least:
                    yield int(chunk.at[k]), sim

    def _matched(self, text: str, key: str, best: float) -> float | None:
        if (known := self.prepared.get(key)) is None:
            if len(self.prepared) >= KEPT:
                self.prepared.clear()
            known = self.prepared[key] = _Key(key)
        return known.matched(text, best)

    def closest(self, text: str, least: float, share: float, inside: float, floor: float) -> tuple[int, float] | None:
        """(number, similarity) of the most similar entry, the first of equal ones, among
        those whose length allows ``least`` and has this ``share`` of the other's.  Where
        one of the two holds the other and the share is ``inside``, it is ``floor`` at least."""
        n, tried = len(text), []
        low, high = math.ceil(n * share), math.floor(n / share)
        for chunk in self.chunks:
            both, small, large = n + chunk.sizes, np.minimum(n, chunk.sizes), np.maximum(n, chunk.sizes)
            fits = (chunk.sizes >= low) & (chunk.sizes <= high) & (2.0 * small / both >= least) & (small / large >= share)
            if fits.any():
                common = chunk.subsequences(text)
                held = (common == small) & (n >= 8) & (small / large >= inside)
                bounds = np.where(held, np.maximum(2.0 * common / both, floor), 2.0 * common / both)
                tried += [(-bounds[k], int(chunk.at[k]), chunk.keys[k], held[k]) for k in np.flatnonzero(fits).tolist()]
        found = None
        for bound, at, key, held in sorted(tried, key=lambda x: x[:2]):
            best = found[0] if found else -1.0
            if -bound < best:
                break
            holds = held and (text in key or key in text)
            if (sim := self._matched(text, key, -1.0 if holds else best)) is None:
                continue
            one = (max(sim, floor) if holds else sim, -at)
            found = max(found, one) if found else one
        return (-found[1], found[0]) if found else None


class Held:
    """A dictionary's texts, of ``LEAST`` characters at least, for containment either way:
    entries are looked up by their first characters, longer ones searched all at once."""

    LEAST = 5

    def __init__(self, keys: list[str]):
        self.keys, self.longest = keys, max(map(len, keys), default=0)
        self.first: dict[str, list[int]] = {}
        for k, key in enumerate(keys):
            self.first.setdefault(key[: self.LEAST], []).append(k)
        self.all = "\0".join(keys)
        self.starts = list(itertools.accumulate((len(key) + 1 for key in keys), initial=0))

    def find(self, text: str) -> Iterator[int]:
        """Numbers of the entries that hold the text, and of shorter ones that it holds."""
        keys, n, size = self.keys, len(text), self.LEAST
        for start in self.first.keys() & {text[k : k + size] for k in range(n - size + 1)}:
            yield from (k for k in self.first[start] if len(keys[k]) < n and keys[k] in text)
        at = self.all.find(text) if n <= self.longest else -1
        while at >= 0:
            k = bisect.bisect_right(self.starts, at) - 1
            if text in keys[k]:
                yield k
            at = self.all.find(text, self.starts[k + 1])
