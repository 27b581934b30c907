"""HTML extraction, near-duplicates and the pipeline against brute force."""

import html
import random
import re
import time

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from palmleaf.llm import html_extract, html_pages, neardup, queries


def _article(page):
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    if not m:
        return ""
    marked = re.sub(r"<[^>]*(>|\Z)", lambda t: "\0" if not re.match(r"</?(b|br)\b", t[0]) else " " if "br" in t[0] else "", m[1])
    return "\n".join(b for b in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in marked.split("\0")) if b)


def test_pages_match_article_text(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op7_html(spark, SF).collect():
        assert r.text == _article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_extraction_edges(spark):
    rows = [(1, None), (2, ""), (3, "plain text only, no markup"), (4, "<p>unfinished &lt;b&gt; &amp; <b>bold"), (4, "<p>unfinished &lt;b&gt; &amp; <b>bold"), (5, "<div>" * 3000 + "deep"), (6, "<!-- open"), (7, "<script>x")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r for r in html_extract.extract(pages, ["page_id", "text"]).collect()}
    assert got[1].text == got[2].text == got[6].text == got[7].text == ""
    assert html_extract.extract(pages.where("false"), ["page_id"]).count() == 0 and got[1].n_chars == 0


LAYOUT = """<html><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="sidebar"><p>{0}</p></div>
<div id="cookie-notice"><p>{0}</p><button>OK</button></div><main><article><h1>A title of this page</h1><p>First {0}</p><div class="ad"><p>{0}</p></div>
<ul><li>One point of it</li><li>Another point</li></ul><p>Last&nbsp;{0} &eacute;<form><label>Name</label><input><p>send it</p></form>
<section class="comments"><div class="comment"><p>Great {0}</p></div></section></article></main><footer><p>{0}</p></footer></body></html>"""


def test_other_layout(spark):
    fill = "words of some length that go on for a while and make a paragraph"
    got = html_extract.main_text(LAYOUT.format(fill)).split("\n")
    assert got == ["A title of this page", f"First {fill}", "One point of it", "Another point", f"Last {fill} é"]


def test_labelled_pages_are_learnt_and_marginals_exact():
    model = html_extract.trained()
    wrong = total = 0
    for page in html_pages.pages():
        tree, labels = html_extract._labelled(page)
        p = html_extract.marginals(tree, model)
        for node in {n for n, _ in tree.runs if n >= 0}:
            total += 1
            wrong += (p[node] > 0.5) != bool(labels[node])
    assert wrong <= 0.01 * total
    # sum-product against all labellings of a small tree
    tree = html_extract.parse("<div class=post><p>some words here<b>x</b></p><nav><a>k</a></nav></div>")
    seen, n = html_extract.evidence(tree), len(tree.tag)
    weights = np.zeros((1 << n))
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        w = model.potentials(seen[0])[y[0]] + model.body * y[0]
        for k in range(1, n):
            w += model.potentials(seen[k])[y[k]] + model.edge(seen[k][0], y[tree.parent[k]])[y[k]]
        weights[code] = w
    weights = np.exp(weights - weights.max())
    exact = [sum(weights[c] for c in range(1 << n) if c >> k & 1) / weights.sum() for k in range(n)]
    assert np.allclose(html_extract.marginals(tree, model), exact)


def test_no_text_is_lost_and_stray_tags_are_cheap():
    article = "<article><p>The first paragraph of the story is long enough to count as text.</p>{}<p>And the second one must not vanish either, whatever came before it.</p></article>"
    for between in ("<script>var x = 1;</script>", "İ" * 12 + "<script>var x = '</scripts>';</SCRIPT >", "<style>p{}</style\n>"):
        text = html_extract.main_text("<html><body>" + "İ" * 12 + article.format(between) + "</body></html>")
        assert "first paragraph" in text and "must not vanish" in text and "var x" not in text
    began = time.time()
    html_extract.main_text("<body><article><p>Some words of a story that go on for a while.</p>" + "<span>" * 20_000 + "</x>" * 20_000 + "</article></body>")
    html_extract.main_text("<body>" + "<ul><li>" * 5_000 + "<p>" * 20_000 + "</b>" * 20_000)
    assert time.time() - began < 5
    # a slash closes nothing, as in browsers
    tree = html_extract.parse("<div/><p>x</p><a href=a/>y</a>z")
    assert tree.parent == [-1, 0, 1, 1] and [r for r in tree.runs if r[0] >= 0] == [(2, "x"), (3, "y"), (1, "z")]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_matches_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 30) for _ in range(rng.randint(1, 60))]
        b = a[:]
        for _ in range(rng.randint(0, 14)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = [rng.randint(0, 30) for _ in range(rng.randint(0, 2))]
        if not b:
            continue
        want = _edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
        assert neardup.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def _brute(texts):
    """Components of all pairs within the similarity; texts without words alone."""
    ids = list(texts)
    words = {i: neardup.word_hashes(t.encode()) if t is not None else np.zeros(0, np.uint64) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if texts[i] is not None and (texts[i] == texts[j] or neardup.similar(words[i], words[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == _brute(texts)
    assert len(set(got.values())) < len(got)


def _family(n=40, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(160)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(4):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def test_near_duplicate_groups_and_edges(spark):
    family = _family()
    passage = " ".join(f"p{k}" for k in range(60))
    rng = random.Random(8)
    sharing = [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(150)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(family)] + [(100 + k, t) for k, t in enumerate(sharing)]
    rows += [(300, None), (301, None), (302, ""), (303, ""), (304, "short one"), (305, "Short, one!"), (306, "..."), (307, "x " * 20_000), (307, "x " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("x")).withColumn("keys", F.lit(1))
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert {got[k] for k in range(40)} == {0} and [got[100 + k] for k in range(60)] == [100 + k for k in range(60)]
    assert (got[300], got[301], got[302], got[303], got[304], got[305], got[306], got[307]) == (300, 301, 302, 302, 304, 304, 306, 307)
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 160), 300, 301, 302, 304, 306, 307]
    assert neardup.classes(docs.where("false")).count() == 0 and neardup.deduplicate(docs.where("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    root = {}
    for a, b in pairs:
        x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
        for k in x | y:
            root[k] = x | y
    links = spark.createDataFrame([(bytearray([a >> 8, a & 255]), bytearray([b >> 8, b & 255])) for a, b in pairs], "hub binary, content binary")
    got = {int.from_bytes(r.content, "big"): bytes(r.root) for r in neardup.components(links).collect()}
    assert set(got) == set(root)
    groups = {}
    for k, r in got.items():
        groups.setdefault(r, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in {frozenset(v) for v in root.values()})
    assert neardup.components(links.where("false")).count() == 0


def test_short_copies_between_long_texts(spark):
    """Texts that are mostly a passage are near each other, not near long texts with it."""
    rng = random.Random(12)
    noise = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [passage + " " + noise(200) for _ in range(50)] + [noise(3) + " " + passage + " " + noise(3) for _ in range(30)]
    for _ in range(10):
        base = noise(40) + " " + passage + " " + noise(40)
        texts += [base, base + " " + noise(6)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == _brute(dict(enumerate(texts)))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "1234 5678", "en", "s", 9), (10**6 + 1, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra).withColumn("row", F.lit("x")).withColumn("score", F.lit(0))
    first = corpus_pipeline.language_id(spark, docs, SF)
    assert first.columns == docs.columns and first.count() == docs.count() - 2
    second = corpus_pipeline.near_dedup(spark, first, SF)
    texts = {r.doc_id: r.text for r in first.select("doc_id", "text").orderBy("doc_id").collect()}
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(_brute(texts).values()))
    third = corpus_pipeline.benchmark_decontamination(spark, second, SF)
    assert third.columns == docs.columns and 0 < third.count() < second.count()
    fourth = corpus_pipeline.pii_pseudonyms(spark, third, SF)
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert fourth.where("n_chars <> length(text)").count() == 0
    assert not [v for r in fourth.join(third.select("doc_id", F.col("text").alias("was")), "doc_id").collect() for v in re.findall(r"\S+@\S+\.\w+", r.was) if v in r.text]
    last = corpus_pipeline.best_fit_packing(spark, fourth, SF)
    assert last.select("doc_id").distinct().count() == fourth.count()


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries() and "pipeline" in entry.queries()
