"""JVM patterns against Python's, and the text functions on fixed cases."""

import difflib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.functions.udfs import nfc, ratio
from palmleaf.operators import align, lexicon, quality
from palmleaf.sources import literals

ALPHABET = "कखगतरवपसशषमयदधहञजङचअउऽा ि ी ु े ो ् ः ं । ॥ | : ; ! . 5 S ( ) [ = - \n a B • *  ".split(" ") + [" ", "\n"]


def fuzz(n=400, seed=5):
    rng = random.Random(seed)
    bits = [*ALPHABET, *[v[a : a + 9] for v in literals.verses() for a in (0, 7, 15)]]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def column(spark, texts, of):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.o for r in rows.select("k", of(F.col("t")).alias("o")).orderBy("k").collect()]


def test_each_rule_matches_python(spark):
    texts = fuzz(150)
    rules = literals.rules()
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = rows.select("k", *[T.sub(F.col("t"), *r).alias(f"r{i}") for i, r in enumerate(rules)]).orderBy("k").collect()
    for i, (pattern, to, multi) in enumerate(rules):
        compiled = re.compile(pattern, re.M if multi else 0)
        for row, t in zip(got, texts, strict=True):
            assert row[f"r{i}"] == compiled.sub(to, t), (pattern, t)


def test_strip_and_fields_match_python(spark):
    texts = [*fuzz(100), "\x1c a b \x85", "", "  ", "　x"]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column(spark, texts, T.fields) == [t.split() for t in texts]


def test_clean(spark):
    cases = {
        "a ।\nb": "a । b",
        "  x || y\r\n\r\n z\x00": "x ॥ y\nz".replace("॥ y", "॥ y"),
        "क े": "के",
        "(राम)": "राम",
        "राम:": "रामः",
        "क·ख": "क • ख",
        "": "",
    }
    assert column(spark, list(cases), T.clean) == list(cases.values())
    assert column(spark, [None], T.clean) == [""]


def test_sentences(spark):
    got = column(spark, ["धर्म  क्षेत्रे ab कु  ि । मामकाः ॥ "], T.sentences)
    assert got == [["धर्म क्षेत्रे कुि", "मामकाः"]]


def test_nfc_and_ratio(spark):
    texts = ["é", "plain", "क़", None, "क़"]
    assert column(spark, texts, nfc) == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "a")], "a string, b string")
    got = [r.r for r in rows.select(ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [difflib.SequenceMatcher(None, "tide", "diet").ratio(), difflib.SequenceMatcher(None, "diet", "tide").ratio(), None]


def test_snap(spark):
    vocab = spark.createDataFrame([("सुखेषु",), ("विगत",), ("रामः",), ("परावरे",)], "word string")
    words = spark.createDataFrame([("सुखेपु",), ("वगित",), ("राम",), ("परावर।",), ("सुखेषु",), ("",), ("अज्ञात",)], "word string")
    got = {r.word: r.snapped for r in lexicon.snap(words, vocab).collect()}
    assert got == {"सुखेपु": "सुखेषु", "वगित": "विगत", "राम": "रामः", "परावर।": "परावरे।", "सुखेषु": "सुखेषु", "": "", "अज्ञात": "अज्ञात"}


def test_alignment_and_repair(spark):
    lines = spark.createDataFrame([("अजो नित्यः शाश्वतोऽयं पुराणो न हन्यते हन्यमाने शरीरे ॥",), ("क",), ("xyz unrelated words",)], "line string")
    got = {r.line: r for r in align.align(lines, literals.verse_frame(spark), min_similarity=0.70).collect()}
    assert "पुराणो न हन्यते" in got["अजो नित्यः शाश्वतोऽयं पुराणो न हन्यते हन्यमाने शरीरे ॥"].aligned
    assert got["क"].align_score == 0.0
    docs = spark.createDataFrame([(1, "धर्मक्षेत्रे कुरुक्षेत्रे समवेता युयुत्सवः ।", 0.82), (2, None, 0.5), (3, " ", 0.4)], "doc_id int, text string, raw_confidence double")
    rows = {r.doc_id: r for r in align.repair(docs).collect()}
    assert rows[1].calibrated_confidence > 0.82 and rows[1].lexical_validity >= 0.95
    assert rows[2].corrected == "" and rows[2].calibrated_confidence == 0.0 and rows[3].corrected == ""


def test_candidate_score_prefers_complete(spark):
    rows = spark.createDataFrame([("परावरे ॥", 0.92), ("परावर ।", 0.97)], "t string, c double")
    a, b = [r.s for r in rows.select(quality.candidate_score(F.col("t"), F.col("c"), F.lit("परावरे ॥")).alias("s")).collect()]
    assert a > b


def test_candidate_validity(spark):
    rows = spark.createDataFrame([("धर्मक्षेत्रे कुरुक्षेत्रे", 0.9), ("ककककक", 0.9), ("धर्म", 0.4), (None, 0.9)], "t string, c double")
    got = [r.s for r in rows.select(quality.is_valid_candidate(F.col("t"), F.lit("धर्म"), F.col("c")).alias("s")).collect()]
    assert got[1:] == [False, False, False]
