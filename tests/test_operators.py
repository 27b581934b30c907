"""Layout, sequences, images, ingest, sources, sinks, providers and streaming."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from palmleaf.operators import images, ingest, layout, metrics, providers, sequence, translate
from palmleaf.sources import literals, readers, sinks
from palmleaf.streaming import landing


def test_reading_order_two_columns(spark):
    rows = [("p", 0, 200, 10, 50, 20), ("p", 1, 10, 50, 50, 20), ("p", 2, 10, 10, 50, 20), ("p", 3, 200, 50, 50, 20)]
    boxes = spark.createDataFrame(rows, "doc_id string, seg_id long, x int, y int, w int, h int")
    got = layout.reading_order(boxes, multi_column=True, column_tol=0.3).orderBy("reading_pos").collect()
    assert [r.seg_id for r in got] == [2, 1, 0, 3]
    shuffled = layout.reading_order(boxes.orderBy(F.desc("seg_id")), multi_column=True, column_tol=0.3).orderBy("reading_pos").collect()
    assert [r.seg_id for r in shuffled] == [2, 1, 0, 3]


def test_recogniser_provider(spark):
    class Fake:
        def recognise(self, batch):
            if batch[0] == b"bad":
                raise ValueError("unreadable")
            return [{"res": {"rec_texts": ["कर्म", "धर्म"], "rec_scores": [0.9, 0.8], "rec_polys": [[[40, 40], [90, 40], [90, 55], [40, 55]], [[10, 10], [70, 10], [70, 25], [10, 25]]]}}]

    pics = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"bad"))], "img_id int, content binary")
    pages = providers.recognise(pics, Fake)
    segs = layout.segments(pages).orderBy("seg_id").collect()
    assert [(s.text, tuple(s.box)) for s in segs] == [("कर्म", (40, 38, 50, 19)), ("धर्म", (10, 8, 60, 19))]
    assert {r.img_id: r.error for r in pages.collect()} == {1: None, 2: "unreadable"}
    assert {r.error for r in providers.recognise(pics, None).collect()} == {"recogniser not available"}


def test_translation_tiers(spark):
    rows = [(0, "धर्म"), (1, "धर्म।"), (2, "A। B॥"), (3, ""), (4, None), (5, "zz qq"), (6, "धर्म zz qq yy")]
    texts = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in translate.cascade(texts, literals.dictionary_frame(spark)).collect()}
    assert [got[k].match_type for k in range(7)] == ["exact", "exact", "fallback", "none", "none", "fallback", "glossary"]
    assert got[0].english.startswith("Dharma") and got[6].english == "धर्म: Dharma"
    # punctuation becomes blanks that do not collapse, so the token tier takes it
    entries = spark.createDataFrame([(0, "A । B ॥", "both")], "ord int, key string, english string")
    assert translate.cascade(texts.where("id = 2"), entries).head().match_type == "partial"

    class Mt:
        name = "Test"

        def translate(self, batch):
            return [f"said {t}" for t in batch]

    keyed = texts.select(F.col("text").alias("cleaned")).where("id = 5")
    answers = providers.neural_answers(keyed, Mt)
    assert translate.cascade(texts.where("id = 5"), entries, neural=answers).head().match_type == "neural"


def test_compound_splits(spark):
    class Sandhi:
        def split_all(self, word):
            return [("a", "b"), ("abc", "d"), ("abd", "e")]

    words = spark.createDataFrame([("abcd",), ("ab",), (None,)], "w string")
    got = [r.s for r in words.select(providers.compound_splits(F.col("w"), Sandhi, 2).alias("s")).collect()]
    assert [[tuple(x) for x in s] for s in got] == [[("abc", "d"), ("abd", "e")], [], []]
    assert [r.s for r in words.select(providers.compound_splits(F.col("w")).alias("s")).collect()] == [[], [], None]


def test_labels(spark):
    ids = literals.glyph_ids()
    assert len(ids) + 1 == 119
    row = spark.createDataFrame([([1, 1, 0, 1, 2, 2], [0.9, 0.8, 0.1, 0.7, 0.6, 0.5])], "i array<int>, p array<double>")
    got = row.select(sequence.decode(F.col("i"), ids).alias("t"), sequence.path_confidence(F.col("i"), F.col("p")).alias("c")).head()
    names = {v: k for k, v in ids.items()}
    assert got.t == names[1] + names[1] + names[2] and got.c == pytest.approx(0.7)


def test_metrics_edges(spark):
    rows = spark.createDataFrame([("", ""), ("a", ""), (None, "b"), ("abc", "abd"), ("a b", "a c")], "r string, h string")
    got = rows.select(metrics.cer(F.col("r"), F.col("h")).alias("c"), metrics.wer(F.col("r"), F.col("h")).alias("w")).collect()
    assert [tuple(x) for x in got][:3] == [(0.0, 0.0), (1.0, 1.0), (1.0, 1.0)]
    assert got[3].c == pytest.approx(1 / 3) and got[4].w == 0.5
    same = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat")], "pair_id int, ref string, hyp string")
    assert metrics.bleu(same).head().bleu == pytest.approx(100) and metrics.chrf(same).head().chrf == pytest.approx(100)


def test_heal_and_headline(spark):
    row = [20 if 10 <= x <= 29 and x != 20 else 255 for x in range(50)]
    px = spark.createDataFrame([("a", y, x, row[x] if y == 15 else 255) for y in range(30) for x in range(50)], "img_id string, y int, x int, v int")
    assert images.heal(px).where("y = 15 AND x = 20").head().v < 100
    ink = px.withColumn("v", 255 - F.col("v")).withColumn("y", F.col("y") - 8).where("y >= 0")
    assert images.headline(ink).head().headline_y == 7
    bands = spark.createDataFrame([("a", y, 100 if 3 <= y < 20 or y >= 25 else 0) for y in range(40)], "img_id string, y int, proj int")
    assert [(r.y0, r.y1) for r in images.line_bands(bands).collect()] == [(3, 20)]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a\tb", "x"), (1, "c", "y")], "id int, sanskrit string, english string")
    sinks.tsv(rows, str(tmp_path / "t"), "id", "sanskrit", "english")
    back = readers.csv(spark, str(tmp_path / "nothing.csv"), "a string")
    assert back.count() == 0
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())[0] == "0\ta b\tx"
    sinks.json_document(rows, str(tmp_path / "j"), "sanskrit", "english", "id")
    assert [(r.key, r.value) for r in readers.json_object(spark, str(tmp_path / "j")).orderBy("ord").collect()] == [("a\tb", "x"), ("c", "y")]
    made = sinks.numbered(rows.withColumnRenamed("english", "label"), "id").withColumn("split", F.lit("train"))
    sinks.manifest(made, str(tmp_path / "m"), "file_name")
    assert sorted(r.label for r in readers.manifest(spark, str(tmp_path / "m/split=train")).collect()) == ["x", "y"]
    pics = spark.createDataFrame([("p1.png", 3, 2, bytearray([0, 50, 100, 150, 200, 250]))], "file_name string, width int, height int, data binary")
    png = sinks.grey_png(pics).head().content
    (tmp_path / "img").mkdir()
    (tmp_path / "img/p1.png").write_bytes(bytes(png))
    px = readers.pixels(readers.images(spark, str(tmp_path / "img")))
    assert [r.v for r in px.where("c = 0").orderBy("y", "x").collect()] == [0, 50, 100, 150, 200, 250]
    assert readers.image_files(spark, str(tmp_path / "img")).head().stem == "p1"


def test_streaming_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("राम:  x", "utf-8")
    stream = landing.cleaned(landing.texts(spark, str(tmp_path / "in")))
    landing.run(stream, lambda df: df.select("stem", "cleaned"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "रामः x")]
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert landing.event_counts(events).agg(F.sum("n")).head()[0] == events.count()


def test_first_rows_ignore_input_order(spark):
    rows = spark.createDataFrame([("a", 3, "z"), ("a", 1, "x"), ("b", 2, "y")], "k string, o int, v string")
    one = sorted(tuple(r) for r in ingest.first_rows(rows, ["k"], "o").collect())
    two = sorted(tuple(r) for r in ingest.first_rows(rows.orderBy(F.desc("o")), ["k"], "o").collect())
    assert one == two == [("a", 1, "x"), ("b", 2, "y")]


def test_dictionary_blocks_give_the_same_answers(spark, monkeypatch):
    """A dictionary of more than one block answers as one of one block."""
    from palmleaf.operators import translate

    entries = spark.createDataFrame([(k, f"word{k} some longer entry {k}", f"gloss {k}") for k in range(30)], "ord int, key string, english string")
    texts = spark.createDataFrame([(f"word{k} some longer entry",) for k in range(12)] + [("an word3 some longer entry 3 here",), ("wrd7 sme longer entry 7",)], "cleaned string").withColumn("norm", F.col("cleaned"))
    known = translate.normalised(entries)
    whole = [sorted(map(tuple, tier(texts, known).collect())) for tier in (translate.partial, translate.fuzzy)]
    monkeypatch.setattr(translate, "BROADCAST_ROWS", 4)
    assert [sorted(map(tuple, tier(texts, known).collect())) for tier in (translate.partial, translate.fuzzy)] == whole
    assert all(whole)


def test_long_lines_do_not_end_the_jvm(spark):
    from palmleaf.operators import quality

    lines = spark.createDataFrame([("क" * 300_000,), ("कखग" * 100_000,), ("क्षत्र" * 50_000,), (" " * 300_000,)], "t string")
    assert [r[0] for r in lines.select(quality.validity(F.col("t"))).collect()] == [0.0, 1.0, 1.0, 0.0]
