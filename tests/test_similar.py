"""Bounded similarity search against difflib over all pairs."""

import difflib
import random

from palmleaf.operators.similar import Entries, Held


def _texts(rng, n, alphabet="abcdefghij धर्मक", most=320):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most))) for _ in range(n)]


def _edited(rng, text):
    return "".join(c for c in text if rng.random() > 0.1) + "x" * rng.randrange(5)


def test_near_is_difflib_over_all_pairs():
    """Keys of one and several words of bits, one with an emoji, and long ones, where
    difflib leaves out frequent characters."""
    rng = random.Random(31)
    keys = _texts(rng, 150) + ["a" * 63, "a" * 64, "a" * 65, "😀ab" * 30]
    texts = [_edited(rng, k) for k in keys] + _texts(rng, 40) + ["a" * 64, "unlike"]
    known = Entries(keys)
    for text in texts:
        want = {k: s for k, key in enumerate(keys) if (s := difflib.SequenceMatcher(None, text, key).ratio()) >= 0.65}
        assert dict(known.near(text, 0.65)) == want


def test_unlike_texts_are_not_compared():
    """Bounds from above leave hardly a pair of unlike texts to the slow comparison."""
    rng = random.Random(32)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    line = lambda: " ".join(rng.choice(words) for _ in range(30))
    keys, texts = [line() for _ in range(100)], [line() for _ in range(100)]
    known = Entries(keys)
    assert not [k for t in texts for k in known.near(t, 0.65)]
    assert len(known.matchers) <= 5


def test_closest_is_difflibs_best():
    """The best entry and its exact ratio, also below any threshold, among lengths that fit."""
    rng = random.Random(33)
    keys = _texts(rng, 60, most=90) + _texts(rng, 40, most=500) + ["ab" * 120 + "xyz", "abc" * 70]
    texts = [_edited(rng, k) for k in keys[::3]] + _texts(rng, 40, most=400) + [keys[5] + "z", "ab" * 110]
    known = Entries(keys)
    for text in texts:
        n, want = len(text), None
        for at, key in enumerate(keys):
            small, large = min(n, len(key)), max(n, len(key))
            if not (2.0 * small / (n + len(key)) >= 0.68 and small / large >= 0.8):
                continue
            r = difflib.SequenceMatcher(None, text, key).ratio()
            if n >= 8 and small / large >= 0.85 and (text in key or key in text):
                r = max(r, 0.94)
            if want is None or r > want[1]:
                want = (at, r)
        assert known.closest(text, 0.68, 0.8, 0.85, 0.94) == want


def test_held_is_containment_either_way():
    rng = random.Random(34)
    keys = [k for k in _texts(rng, 300, "abc", 12) if len(k) >= 5] + ["abcab\0bcabc", "धर्मधर्म"]
    texts = [t for t in _texts(rng, 200, "abc", 60) if len(t) >= 5] + keys[::4] + ["b\0bca", "c\0abc"]
    known = Held(keys)
    for text in texts:
        got = list(known.find(text))
        assert len(got) == len(set(got))
        assert set(got) == {k for k, key in enumerate(keys) if (text in key if len(text) <= len(key) else key in text)}
