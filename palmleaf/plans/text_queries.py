"""Queries of text clean-up, counting and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from palmleaf.functions import text as T
from palmleaf.functions.udfs import nfc
from palmleaf.operators import lexicon, quality
from palmleaf.plans.tables import LINES_SQL, RE2_SPACE, document_lines, spread, sql_strip, sql_sub, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(rows, columns: str) -> str:
    quote = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({columns})"


_UNIX = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(
    f"""SELECT doc_id, length(c) AS n_clean, length(text) - length(c) AS n_removed
    FROM (SELECT doc_id, text, {sql_sub(_UNIX, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FEFF}\\x{FFFE}]', '')} AS c FROM documents)"""
)
def clean_control(spark, sf_dir):
    """Unix line ends, no control characters."""
    c = T.remove_control(T.unix_lines(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("bigint").alias("n_clean"), (F.length("text") - F.length(c)).cast("bigint").alias("n_removed"))


_WS = f"[{RE2_SPACE}]*"


@query(
    f"""SELECT doc_id, {sql_sub(sql_sub('text', '(?:॥+|[|]{2,}|।{2,})', ' ॥ '), _WS + '॥' + _WS, ' ॥ ')} AS text
    FROM documents"""
)
def danda_double(spark, sf_dir):
    """Double bars as spaced double dandas."""
    out = T.sub(T.sub(F.col("text"), r"(?:॥+|\|{2,}|।{2,})", " ॥ "), r"\s*॥\s*", " ॥ ")
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("text"))


_DANDAS = [
    (0, "a ।\nb", "a । b"), (1, "x||y", "x ॥ y"), (2, "x|y", "x । y"), (3, "क ।। ख", "क ॥ ख"), (4, "क॥", "क ॥ "), (5, "plain", "plain"),
]


@query(values([(a, c) for a, _, c in _DANDAS], "case_id, text"))
def danda_full(spark, sf_dir):
    rows = spark.createDataFrame([(a, b) for a, b, _ in _DANDAS], "case_id int, text string")
    return rows.select("case_id", T.dandas(F.col("text")).alias("text"))


_P = {k: T.PUNCT[k].replace("\\\"", "\"").replace("'", "''") for k in T.PUNCT}


@query(
    "SELECT item_id, "
    + ", ".join(f"{sql_strip(sql_sub('text', _P[k], ' '))} AS {k}_key" for k in ("dictionary", "corpus", "external"))
    + " FROM benchmark"
)
def strip_punct_variants(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", *[T.strip_punct(F.col("text"), k).alias(f"{k}_key") for k in ("dictionary", "corpus", "external")])


_LINE = sql_sub(sql_sub("text", "[\\r\\n\\t]+", " "), " +", " ")


@query(f"SELECT doc_id, {sql_strip(sql_sub(_LINE, '([।॥|])' + _WS + '[.]+', chr(92) + '1'))} AS line FROM documents")
def normalize_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


_E = sql_sub("text", "[*][^*]+(?:[*]|$)", "")
_E = sql_sub(sql_sub(_E, "### Human:" + _WS, ""), "### Assistant:" + _WS, "")


@query(f"SELECT conv_id, turn, {sql_strip(sql_sub(_E, ' +', ' '))} AS english FROM conversations")
def strip_footnotes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.english(F.col("text")).alias("english"))


_BLANK = RE2_SPACE.replace("\\n", "").replace("\\r", "")
_A = sql_sub(sql_strip("line"), f"^[(\\[{{<]{_WS}|{_WS}[)\\]}}>]$", "")


@query(f"WITH {LINES_SQL} SELECT * FROM (SELECT doc_id, line_no, {sql_strip(sql_sub(_A, f'[{_BLANK}]+', ' '))} AS line FROM lines) WHERE line <> ''")
def line_explode_clean(spark, sf_dir):
    """Lines without stray brackets and repeated blanks; empty ones go."""
    clean = lambda x: T.strip(F.regexp_replace(T.sub(T.strip(x), T.STRAY_BRACKET, ""), f"[{T.BLANK}]+", " "))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # cleaned and filtered within the array, so that each line is cleaned once
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.struct(k.alias("line_no"), clean(x).alias("line")))
    return docs.select("doc_id", F.inline(F.filter(lines, lambda x: x["line"] != "")))


@query(
    f"""SELECT doc_id, count(*) AS n_sentences, sum(length(s)) AS n_chars FROM (
      SELECT doc_id, {sql_strip('s')} AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.]+')) AS s FROM documents))
    WHERE length(s) >= 4 GROUP BY doc_id"""
)
def sentence_split(spark, sf_dir):
    parts = F.filter(F.transform(F.split("text", "[.]+"), T.strip), lambda x: F.length(x) >= 4)
    lens = F.transform(parts, lambda x: F.length(x))
    docs = table(spark, sf_dir, "documents").withColumn("lens", lens).where(F.size("lens") > 0)
    return docs.select("doc_id", F.size("lens").cast("bigint").alias("n_sentences"), F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_chars"))


# Cases whose result must hold a word.
_ORTHO = [
    (0, "तस्मादपरहार्येउर्थे", "ऽर्थे"), (1, "न तवं शोचितुमरहसि", "त्वं"), (2, "न तवं शोचितुमरहसि", "शोचितुमर्हसि"),
    (3, "जनाधपाः", "जनाधिपाः"), (4, "क्षीयन्ते चास्य कर्माणि तस्मिन्दृष्टे परावर ।", "परावरे ॥"), (5, "परम", "प्रम"), (6, "plain text", "plain text"),
]


@query(values([(a, True) for a, _, _ in _ORTHO], "case_id, holds"))
def ortho_rules(spark, sf_dir):
    rows = spark.createDataFrame(_ORTHO, "case_id int, text string, part string")
    return rows.select("case_id", nfc(T.rewrite(nfc(F.col("text")))).contains(F.col("part")).alias("holds"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY word")
def token_vocab(spark, sf_dir):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_FIELDS = f"len(list_filter(regexp_split_to_array(text, '[{RE2_SPACE}]+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, {_FIELDS} AS n_words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.fields(F.col("text"))).cast("bigint").alias("n_words"))


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[a-z]')) AS n_lower, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    len(regexp_extract_all(text, '[0-9]')) AS n_digits, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS n_script FROM documents"""
)
def char_class_counts(spark, sf_dir):
    n = lambda c, name: T.count(F.col("text"), c).cast("bigint").alias(name)
    return table(spark, sf_dir, "documents").select("doc_id", n("[a-z]", "n_lower"), n("[A-Z]", "n_upper"), n("[0-9]", "n_digits"), n(T.DEVANAGARI, "n_script"))


_LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,"
_PUNCT = "[।॥०-९0-9•·" + RE2_SPACE + r"–—,.:;!?\x{22}\x{27}“”‘’()\[\]{}/*\\#-]+"


@query(
    f"""WITH {LINES_SQL}, x AS (SELECT doc_id, line_no, {sql_strip('line')} AS t FROM lines),
    c AS (SELECT *, len(regexp_extract_all(t, '[a-zA-Z]')) AS base, length({sql_sub('t', f'[{RE2_SPACE}]', '')}) AS solid,
      len(regexp_extract_all(t, '[a-zA-Z0-9 .,]')) / greatest(length(t), 1)::DOUBLE AS ratio FROM x),
    d AS (SELECT *, base / greatest(solid, 1)::DOUBLE AS share,
      len(list_filter(regexp_split_to_array(t, '[{RE2_SPACE}]+'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[a-zA-Z]')
        AND NOT regexp_full_match(w, '{_PUNCT}'))) > 0 AS noisy FROM c)
    SELECT doc_id, line_no, CASE WHEN t = '' THEN 0.0::DOUBLE
      WHEN solid > 0 AND base = 0 THEN CASE WHEN regexp_full_match(t, '{_PUNCT}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      WHEN share < 0.20::DOUBLE THEN 0.0::DOUBLE WHEN noisy THEN 0.0::DOUBLE
      ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN share < 0.35::DOUBLE THEN ratio * 0.5::DOUBLE ELSE ratio END
        - CASE WHEN regexp_matches(t, '[aeiou][aeiou]') THEN 0.30::DOUBLE ELSE 0.0::DOUBLE END)) END AS validity FROM d"""
)
def validity_latin(spark, sf_dir):
    """The validity score with a Latin alphabet, on all document lines."""
    v = quality.validity(F.col("line"), _LATIN, "[a-zA-Z]", "[aeiou]")
    return document_lines(spark, sf_dir).select("doc_id", "line_no", v.alias("validity"))


# Texts with their exact or least validity.
_VALID = [
    (0, "ुुुुु", 0.0, 0.0), (1, "ु॒ु॒ु॒ु॒ ॒ख॒ु॒ु॒", 0.0, 0.0), (2, "धर्मक्षेत्रे कुरुक्षेत्रे समवेता युयुत्सवः ।", 0.95, 1.0), (3, "॥ १ ॥", 1.0, 1.0), (4, "॥ १.२ ॥", 1.0, 1.0),
    (5, "(१०८)", 1.0, 1.0), (6, "[ १ ]", 1.0, 1.0), (7, "ॐ", 1.0, 1.0), (8, "ॠ", 1.0, 1.0), (9, "ॡ", 1.0, 1.0), (10, "सोऽहम्", 0.95, 1.0), (11, None, 0.0, 0.0), (12, "", 0.0, 0.0),
]


@query(values([(r[0], True) for r in _VALID], "case_id, holds"))
def validity_deva(spark, sf_dir):
    rows = spark.createDataFrame(_VALID, "case_id int, text string, low double, high double")
    return rows.select("case_id", quality.validity(F.col("text")).between(F.col("low"), F.col("high")).alias("holds"))


# Segments and whether they are phantoms.
_PHANTOM = [
    (0, 0, "ुुुुु॒ु॒रु॒रुर॒ु॒ुरु॒॒ु॒ु॒॒॒॒ु॒ुरुुरुु ।", True), (1, 0, "ु॒ु॒ु॒ु॒ ॒ख॒ु॒ु॒ुरु॒े॒ु॒॒ख॒व॒जं॒॒ु॒ ॥", True), (2, 0, "्ु॒ुरु॒ु॒ु॒ु॒ु॒ु॒रु॒ु॒ ॥", True),
    (3, 1, "धर्मक्षेत्रे कुरुक्षेत्रे समवेता युयुत्सवः ।", False), (4, 1, "सङ्कल्पप्रभवान् कामान् त्यक्त्वा सर्वानशेषतः ।", False), (5, 1, "क ।", False), (6, 2, "॥ १ ॥", False), (7, 2, "ुुुुु", True),
]


@query(values([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 1, 0), (5, 1, 0), (6, 2, 1)], "seg_id, doc_id, filtered"))
def phantom_filter(spark, sf_dir):
    """Phantoms go; a page of phantoms only stays."""
    rows = spark.createDataFrame([r[:3] for r in _PHANTOM], "seg_id int, doc_id int, text string")
    return quality.drop_phantoms(rows, "doc_id").select("seg_id", "doc_id", F.col("filtered").cast("int").alias("filtered"))


@query(
    """SELECT doc_id, CASE WHEN sum(n) >= 5 THEN max(n) / sum(n)::DOUBLE ELSE 0.0::DOUBLE END AS share FROM (
      SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]')) AS c FROM documents) GROUP BY doc_id, c)
    GROUP BY doc_id"""
)
def dominant_char(spark, sf_dir):
    """Share of the most common letter of a document."""
    chars = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]"), F.lit(0))).alias("c"))
    n = chars.groupBy("doc_id", "c").agg(F.count("*").alias("n")).groupBy("doc_id")
    return n.agg(F.when(F.sum("n") >= 5, F.max("n") / F.sum("n")).otherwise(0.0).alias("share"))


@query(
    f"""WITH {LINES_SQL}, base AS (SELECT doc_id, line_no, {sql_strip('line')} AS t FROM lines),
    cand AS (SELECT doc_id, line_no, t, 0 AS variant, t AS c, 0.8::DOUBLE AS conf FROM base
      UNION ALL SELECT doc_id, line_no, t, 1, substr(t, 1, length(t) // 2), 0.95::DOUBLE FROM base
      UNION ALL SELECT doc_id, line_no, t, 2, t || t, (doc_id % 10) / 10.0::DOUBLE + 0.5::DOUBLE FROM base),
    s AS (SELECT *, {sql_strip('c')} AS k FROM cand),
    f AS (SELECT doc_id, line_no, variant, CASE WHEN k = '' THEN 0.0::DOUBLE ELSE conf * (1.0::DOUBLE + 0.35::DOUBLE * 0.5::DOUBLE) * CASE
      WHEN length(t) > 0 AND length(k) < length(t) THEN pow(length(k) / length(t)::DOUBLE, 0.8::DOUBLE)
      WHEN length(t) >= 4 AND length(k) > floor(length(t) * 1.6::DOUBLE) THEN pow(length(t) / length(k)::DOUBLE, 0.8::DOUBLE) ELSE 1.0::DOUBLE END END AS score FROM s)
    SELECT doc_id, line_no, arg_min(variant, (-score, variant)) AS variant FROM f GROUP BY doc_id, line_no"""
)
def candidate_argmax(spark, sf_dir):
    """The best of three candidates a line, the first on ties."""
    t = T.strip(F.col("line"))
    half = F.substring(F.col("t"), F.lit(1), F.floor(F.length("t") / 2).cast("int"))
    rows = document_lines(spark, sf_dir).withColumn("t", t)
    made = F.array(
        F.struct(F.lit(0).alias("variant"), F.col("t").alias("c"), F.lit(0.8).alias("conf")),
        F.struct(F.lit(1).alias("variant"), half.alias("c"), F.lit(0.95).alias("conf")),
        F.struct(F.lit(2).alias("variant"), F.concat("t", "t").alias("c"), (F.col("doc_id") % 10 / 10.0 + 0.5).alias("conf")),
    )
    score = lambda x: quality.candidate_score(x["c"], x["conf"], F.col("t"), F.lit(0.5))
    best = F.array_max(F.transform(made, lambda x: F.struct(score(x).alias("s"), (-x["variant"]).alias("v"))))
    return rows.select("doc_id", "line_no", (-best["v"]).alias("variant"))


@query(
    f"""WITH {LINES_SQL}, x AS (SELECT doc_id, line_no, ((doc_id * 31 + line_no * 17) % 100) / 100.0::DOUBLE AS raw,
      ((doc_id * 13 + line_no * 7) % 101) / 100.0::DOUBLE AS valid FROM lines)
    SELECT doc_id, line_no, greatest(raw, least(1.0::DOUBLE, raw * 0.65::DOUBLE + valid * 0.35::DOUBLE
      + CASE WHEN valid >= 0.95::DOUBLE THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) AS conf FROM x"""
)
def calibrate_conf(spark, sf_dir):
    d, i = F.col("doc_id"), F.col("line_no")
    raw, valid = (d * 31 + i * 17) % 100 / 100.0, (d * 13 + i * 7) % 101 / 100.0
    return document_lines(spark, sf_dir).select("doc_id", "line_no", quality.calibrated(raw, valid).alias("conf"))


_WORDS = "unnest(regexp_extract_all(lower(text), '[a-z]+'))"


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS word FROM documents), v AS (SELECT DISTINCT {_WORDS} AS word FROM benchmark)
    SELECT doc_id, count(*) AS n_known FROM w WHERE word IN (SELECT word FROM v) GROUP BY doc_id"""
)
def lexicon_semi(spark, sf_dir):
    """Words of each document that the lexicon holds."""
    words = lambda name, *keep: table(spark, sf_dir, name).select(*keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words("documents", "doc_id").join(words("benchmark").distinct(), "word", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_known"))


_PAIRS = (("a", "e"), ("th", "t"))


@query(
    f"""WITH w AS (SELECT DISTINCT {_WORDS} AS w FROM documents), v AS (SELECT DISTINCT {_WORDS} AS word FROM benchmark),
    o AS (SELECT w FROM w WHERE w NOT IN (SELECT word FROM v)),
    c AS (SELECT w, 0 AS pos, w || 's' AS cand FROM o UNION ALL SELECT w, 1, w || 'ed' FROM o
      UNION ALL SELECT w, 2, substr(w, 1, length(w) - 1) FROM o WHERE length(w) >= 3 AND (ends_with(w, 's') OR ends_with(w, 'n'))
      UNION ALL SELECT w, 3 + 2 * p, substr(w, 1, p - 1) || 'e' || substr(w, p + 1) FROM (SELECT w, unnest(generate_series(1, length(w))) AS p FROM o) WHERE substr(w, p, 1) = 'a'
      UNION ALL SELECT w, 4 + 2 * p, substr(w, 1, p - 1) || 'e' || substr(w, p + 1) || 's' FROM (SELECT w, unnest(generate_series(1, length(w))) AS p FROM o) WHERE substr(w, p, 1) = 'a'
      UNION ALL SELECT w, 1003 + 2 * p, substr(w, 1, p - 1) || 't' || substr(w, p + 2) FROM (SELECT w, unnest(generate_series(1, length(w))) AS p FROM o) WHERE substr(w, p, 2) = 'th'
      UNION ALL SELECT w, 1004 + 2 * p, substr(w, 1, p - 1) || 't' || substr(w, p + 2) || 's' FROM (SELECT w, unnest(generate_series(1, length(w))) AS p FROM o) WHERE substr(w, p, 2) = 'th'),
    h AS (SELECT w, arg_min(cand, pos) AS snapped FROM c WHERE cand IN (SELECT word FROM v) GROUP BY w)
    SELECT w.w AS word, coalesce(snapped, w.w) AS snapped FROM w LEFT JOIN h ON w.w = h.w"""
)
def lexicon_snap(spark, sf_dir):
    """Distinct document words snapped to the benchmark's, by Latin tables."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return lexicon.snap(words("documents"), words("benchmark"), suffixes=("s", "ed"), trailing=("s", "n"), confusions=_PAIRS, visarga="s", ikara=None)
