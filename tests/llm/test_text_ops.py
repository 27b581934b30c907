"""Decontamination, language ID, quality, packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palmleaf.llm import decontaminate, language, packing, quality, queries

VOCAB = public_tokenizers.path("word_bpe_49k.json")
EDGE = [(1, None), (2, ""), (3, "   "), (4, "one two"), (4, "one two"), (None, "a null id"), (5, "x " * 30_000), (6, "é’ñ… \x01 \x00 tab\tend")]


@pytest.fixture(scope="module")
def texts():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


def edge(spark, rows=EDGE):
    """Rows with nulls, repeats, long texts and columns of clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("x").alias("score"), F.lit(1).alias("n_words"), F.lit(2).alias("spans"), F.lit(3).alias("piece"))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _contaminated(text, items):
    words = _words(text)
    hit, found = set(), set()
    for item, item_text in items:
        w = _words(item_text)
        size = min(10, len(w))
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k : k + size]
            for at in range(len(words) - size + 1):
                if words[at : at + size] == window:
                    hit.update(range(at, at + size))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontaminate_matches_brute_force(spark, texts):
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op2_decontaminate(spark, SF).collect()}
    for doc_id, text in texts[:120]:
        assert got[doc_id] == _contaminated(text, items), doc_id
    assert any(r[4] for r in got.values())


def test_decontaminate_edges(spark):
    bench = spark.createDataFrame([(7, "one two"), (7, "one two"), (8, None), (9, "..."), (None, "a null id")], "item_id long, text string")
    rows = decontaminate.decontaminate(edge(spark), bench, ["doc_id", "score"]).collect()
    assert len(rows) == len(EDGE)
    by = {r.doc_id: r for r in rows}
    assert by[4].n_hit == 2 and by[4].item_ids == ["7"] and by[4].hit_spans == [[0, 7]]
    assert by[1].n_words == 0 and not by[1].contaminated and by[None].contaminated and by[None].n_items == 0
    blocks = decontaminate.decontaminate(edge(spark), bench, ["doc_id"], block_bytes=4).collect()
    assert sorted(map(repr, blocks)) == sorted(repr(r.__class__(**{k: v for k, v in r.asDict().items() if k != "score"})) for r in rows)
    none = bench.where("false")
    assert not any(r.contaminated for r in decontaminate.decontaminate(edge(spark), none, ["doc_id"]).collect())
    assert decontaminate.decontaminate(edge(spark).where("false"), bench, ["doc_id"]).count() == 0


def test_offsets_map_to_original(spark):
    docs = spark.createDataFrame([(1, "Ünï — Say: ONE, two; three! end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two THREE")], "item_id long, text string")
    row = decontaminate.decontaminate(docs, bench, ["doc_id"]).head()
    a, b = row.hit_spans[0]
    assert "Ünï — Say: ONE, two; three! end"[a:b] == "ONE, two; three"


def test_language_held_out_accuracy(spark):
    rows = queries.op3_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_mixture_and_edges(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    en = next(r.text for r in docs.where("lang = 'en' AND n_chars > 1500").take(1))
    de = next(r.text for r in docs.where("lang = 'de' AND n_chars > 1500").take(1))
    _, _, shares = language.predict(model, [(en[:1500] + " " + de[:900]).encode()])
    assert sorted(k for k, s in zip(model.languages, shares[0], strict=True) if s > 0.2) == ["de", "en"]
    rows = {r.doc_id: r for r in language.identify(edge(spark), model, ["doc_id", "score"]).withColumnRenamed("score", "share").collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].share == 0.0 and rows[4].lang_pred != "und"
    blank = language.fit([])
    assert {r.lang_pred for r in language.identify(edge(spark), blank, ["doc_id"]).collect()} == {"und"}
    assert language.identify(edge(spark).where("false"), model, ["doc_id"]).count() == 0


def _quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_matches_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.op5_quality(spark, SF).collect()}
    for doc_id, text in texts:
        r, want = got[doc_id], _quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_edges_and_ablations(spark):
    book = quality.ledger(edge(spark), ["doc_id", "score"])
    rows = {r.doc_id: r for r in book.collect()}
    for doc_id, text in EDGE:
        assert rows[doc_id].n_words == _quality(text)[0]
    masks = [r.failed for r in book.collect()]
    for row in quality.ablations(book).collect():
        bit, policy = 1 << quality.RULES[row.rule], quality.POLICIES[quality.CURRENT]
        assert row.n_failed == sum(bool(m & bit) for m in masks)
        assert row.n_kept_without == sum(not m & policy & ~bit for m in masks)
    assert quality.ledger(edge(spark).where("false"), ["doc_id"]).count() == 0


def _packed(rows, texts):
    """Checks pieces, tokens and places; returns the number of sequences."""
    tok = Tokenizer.from_file(VOCAB)
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
    for doc_id, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            found = pieces[doc_id, k // 4096]
            assert all((f.start, f.length, f.ids_crc32) == (k, len(part), zlib.crc32(part.tobytes())) for f in found)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [p[0] for p in places] == list(np.cumsum([0, *[p[1] for p in places[:-1]]]))
        assert sum(p[1] for p in places) <= 4096
    return len(by)


def test_packing_exact_and_tight(spark, texts):
    rows = queries.op10_packing(spark, SF).collect()
    n = _packed(rows, texts)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_tree_and_edges(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(20)
    rows = packing.pack(docs, ["doc_id"], VOCAB, fan_in=3).collect()
    n = _packed(rows, texts)
    assert n <= 1.03 * -(-sum(r.length for r in rows) // 4096) + 1
    rows = packing.pack(edge(spark), ["doc_id", "score"], VOCAB).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and len([r for r in rows if r.doc_id == 5]) > 1
    _packed(rows, [(d, t) for d, t in EDGE])
    assert packing.pack(edge(spark).where("false"), ["doc_id"], VOCAB).count() == 0


def test_word_ids_equal_whole_texts(texts):
    odd = ["it's DON'T “q” — ’tis naïve ΑΣ. İ x² Ⅷ 12ab a b d…! «a» a_b 日本語!! धर्म ß ẞ × ÷ <|endoftext|>", "\x1c \x85 \xa0y"]
    tok = Tokenizer.from_file(VOCAB)
    for text in odd:
        got = np.frombuffer(packing.token_bytes([text.encode()], VOCAB)[0], "<u4").tolist()
        assert got == tok.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_texts(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|STARTOFTEXT|>x<|startoftext|>"), (3, "it's <|endoftext|>" * 900)]
    _packed(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], VOCAB).collect(), rows)


def test_few_bins_rise_and_none_is_wasted():
    """Middling bins stay where they are; the count of sequences is that of all bins together."""
    rng = np.random.default_rng(3)
    assert len(packing.rising([2500] * 5000, 4096, 8, 8)) == packing.LEVELS * 8
    for sizes in (rng.integers(2049, 4000, 3000), rng.integers(1, 3000, 3000), np.concatenate([rng.integers(2100, 4000, 2990), rng.integers(1, 1500, 10)])):
        left, done = [list(map(int, part)) for part in np.array_split(sizes, 64)], 0
        while True:
            last, above = len(left) == 1, []
            for node in left:
                totals = [sum(node[i] for i in b) for b in packing.best_fit(node)]
                up = set() if last else packing.rising(totals, 4096, 8, 8)
                done += len(totals) - len(up)
                above.append([totals[k] for k in sorted(up)])
            if last:
                break
            left = [sum(above[k : k + 8], []) for k in range(0, len(above), 8)]
        assert done <= 1.01 * len(packing.best_fit(list(map(int, sizes)))) + 64
