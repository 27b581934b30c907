"""Queries of dictionary tiers, alignment, metrics and translation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palmleaf.functions.text import PUNCT, fields
from palmleaf.operators import align, metrics, translate
from palmleaf.plans.tables import LINES_SQL, RE2_SPACE, document_lines, sql_strip, sql_sub, table
from palmleaf.sources import literals

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _entries(spark, sf_dir):
    """Benchmark items as a dictionary: key to id, ordered by id."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("ord"), F.col("text").alias("key"), F.concat(F.lit("item "), F.col("item_id"), F.lit(" (note)")).alias("english")
    )


def _texts(spark, sf_dir):
    """Items distorted in five ways, and all lines of the documents."""
    k = F.col("item_id") % 5
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("text_id"),
        F.when(k == 0, F.col("text"))
        .when(k == 1, F.replace("text", F.lit("."), F.lit(",")))
        .when(k == 2, F.substring("text", 6, 1 << 30))
        .when(k == 3, F.concat(F.lit("unseen "), F.regexp_replace("text", "[Tt]h", "q")))
        .otherwise(F.array_join(F.reverse(F.split("text", " ")), " "))
        .alias("text"),
    )
    lines = document_lines(spark, sf_dir).select((F.col("doc_id") + 1000000).alias("text_id"), F.col("line").alias("text"))
    return items.unionByName(lines)


_N = lambda x: sql_strip(sql_sub(x, PUNCT["dictionary"], " "))
_TOK = lambda x: f"list_distinct(list_filter(regexp_split_to_array({x}, '[{RE2_SPACE}]+'), lambda x: x <> ''))"
_BASE = f"""
{LINES_SQL}, t AS (
  SELECT item_id AS text_id, CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN replace(text, '.', ',') WHEN 2 THEN substr(text, 6)
    WHEN 3 THEN 'unseen ' || regexp_replace(text, '[Tt]h', 'q', 'g') ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS text FROM benchmark
  UNION ALL SELECT doc_id + 1000000, line FROM lines),
q AS (SELECT text_id, cleaned, {_N('cleaned')} AS norm FROM (SELECT text_id, {sql_strip('text')} AS cleaned FROM t)),
d AS (SELECT item_id AS ord, text AS key, 'item ' || item_id || ' (note)' AS english, {_N('text')} AS k_norm FROM benchmark),
u AS (SELECT DISTINCT cleaned, norm FROM q WHERE cleaned <> ''),
e1 AS (SELECT cleaned, arg_min(english, ord) AS english FROM u JOIN d ON cleaned = key GROUP BY cleaned),
e2 AS (SELECT cleaned, arg_min(english, ord) AS english FROM u JOIN d ON norm = k_norm WHERE norm <> '' AND cleaned NOT IN (SELECT cleaned FROM e1) GROUP BY cleaned),
exact AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2),
partial AS (
  SELECT cleaned, arg_max(english, (length(key), -ord)) AS english FROM u, d
  WHERE length(norm) > 4 AND length(k_norm) > 4 AND (contains(k_norm, norm) OR contains(norm, k_norm)) GROUP BY cleaned),
ut AS (SELECT cleaned, toks, len(toks) AS n FROM (SELECT cleaned, {_TOK('norm')} AS toks FROM u) WHERE len(toks) >= 2),
dt AS (SELECT ord, english, toks, len(toks) AS m FROM (SELECT ord, english, {_TOK('k_norm')} AS toks FROM d)),
j AS (
  SELECT a.cleaned, b.ord, any_value(b.english) AS english, count(*) AS n_both, any_value(n) AS n, any_value(m) AS m
  FROM (SELECT cleaned, n, unnest(toks) AS tok FROM ut) a JOIN (SELECT ord, english, m, unnest(toks) AS tok FROM dt) b ON a.tok = b.tok GROUP BY a.cleaned, b.ord),
jaccard AS (
  SELECT cleaned, arg_max(english, (n_both / (n + m - n_both)::DOUBLE, -ord)) AS english FROM j WHERE n_both / (n + m - n_both)::DOUBLE >= 0.4::DOUBLE GROUP BY cleaned),
w AS (SELECT cleaned, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM (SELECT cleaned, list_filter(regexp_split_to_array(norm, '[{RE2_SPACE}]+'), lambda x: x <> '') AS a FROM u)),
g AS (SELECT k_norm, arg_min(english, ord) AS english FROM gd GROUP BY k_norm),
glossary AS (
  SELECT cleaned, string_agg(word || ': ' || {sql_strip("string_split(g.english, '(')[1]")}, '; ' ORDER BY pos) AS english FROM w JOIN g ON word = k_norm WHERE length(word) > 1 GROUP BY cleaned)
"""
#: The glossary's own entries: single words of the items.
_WORDS_SQL = "SELECT row_number() OVER (ORDER BY word) AS ord, word AS k_norm, 'gloss of ' || word || ' (item)' AS english FROM (SELECT item_id, unnest(regexp_extract_all(text, '[a-z]{4,}')) AS word FROM benchmark) GROUP BY word"
_WITH = "WITH " + _BASE.strip().replace("g AS (SELECT k_norm", f"gd AS ({_WORDS_SQL}), g AS (SELECT k_norm", 1)


def _norms(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return texts.select(translate.strip(F.col("text")).alias("cleaned")).where("cleaned <> ''").distinct().withColumn("norm", translate.strip_punct(F.col("cleaned")))


def _words(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("key"))
    # a dictionary's order is one list; its distinct words are few
    first = words.select("key").distinct().withColumn("ord", F.row_number().over(Window.orderBy("key")))
    return first.select("ord", "key", F.concat(F.lit("gloss of "), "key", F.lit(" (item)")).alias("english"))


@query(f"{_WITH} SELECT cleaned, english FROM exact")
def dict_exact(spark, sf_dir):
    return translate.exact(_norms(spark, sf_dir), translate.normalised(_entries(spark, sf_dir)))


@query(f"{_WITH} SELECT cleaned, english FROM partial")
def dict_partial(spark, sf_dir):
    return translate.partial(_norms(spark, sf_dir), translate.normalised(_entries(spark, sf_dir)))


@query(f"{_WITH} SELECT cleaned, english FROM jaccard")
def dict_jaccard(spark, sf_dir):
    return translate.by_tokens(_norms(spark, sf_dir), translate.normalised(_entries(spark, sf_dir)))


@query()
def dict_fuzzy(spark, sf_dir):
    return translate.fuzzy(_norms(spark, sf_dir), translate.normalised(_entries(spark, sf_dir)))


@query(f"{_WITH} SELECT cleaned, english FROM glossary")
def dict_glossary(spark, sf_dir):
    return translate.glossary(_norms(spark, sf_dir), translate.normalised(_words(spark, sf_dir)))


_D2 = "SELECT ord, key, english, k_norm FROM d UNION ALL SELECT ord + 1000000, k_norm, english, k_norm FROM gd"


@query(
    f"""WITH {_BASE.strip().replace("d AS (SELECT item_id AS ord", f"gd AS ({_WORDS_SQL}), d AS (SELECT item_id AS ord", 1)
        .replace("FROM benchmark)," + chr(10) + "u AS", "FROM benchmark UNION ALL SELECT ord + 1000000, k_norm, english, k_norm FROM gd)," + chr(10) + "u AS", 1)
        .replace("FROM gd GROUP BY k_norm", "FROM d GROUP BY k_norm", 1)}
    SELECT text_id, q.cleaned,
      CASE WHEN q.cleaned = '' THEN '' ELSE coalesce(e.english, p.english, j.english, g.english, 'Sanskrit Devanagari text: ''' || q.cleaned || ''' (Classical Sanskrit)') END AS english,
      CASE WHEN q.cleaned = '' THEN 'None' WHEN e.english IS NOT NULL OR p.english IS NOT NULL THEN 'Corpus Dictionary' WHEN j.english IS NOT NULL THEN 'Corpus Dictionary (Semantic Match)'
        WHEN g.english IS NOT NULL THEN 'Sanskrit Lexical Glossary' ELSE 'Normalized Sanskrit' END AS source,
      CASE WHEN q.cleaned = '' THEN 'none' WHEN e.english IS NOT NULL THEN 'exact' WHEN p.english IS NOT NULL OR j.english IS NOT NULL THEN 'partial'
        WHEN g.english IS NOT NULL THEN 'glossary' ELSE 'fallback' END AS match_type
    FROM q LEFT JOIN exact e ON q.cleaned = e.cleaned LEFT JOIN partial p ON q.cleaned = p.cleaned LEFT JOIN jaccard j ON q.cleaned = j.cleaned LEFT JOIN glossary g ON q.cleaned = g.cleaned"""
)
def translate_cascade(spark, sf_dir):
    """All tiers but the fuzzy one over items and words."""
    words = _words(spark, sf_dir).withColumn("ord", (F.col("ord") + 1000000).cast("int"))
    entries = _entries(spark, sf_dir).unionByName(words)
    out = translate.cascade(_texts(spark, sf_dir), entries, with_fuzzy=False)
    return out.select("text_id", "cleaned", "english", "source", "match_type")


@query()
def translate_verses(spark, sf_dir):
    """The shipped dictionary on the verse lines, fuzzy tier included."""
    verses = literals.verse_frame(spark)
    return translate.cascade(verses, literals.dictionary_frame(spark), text="line").select("ord", "cleaned", "english", "source", "match_type")


@query()
def corpus_align(spark, sf_dir):
    """Document lines aligned with the benchmark's items."""
    corpus = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("ord"), F.col("text").alias("line"))
    return align.align(document_lines(spark, sf_dir), corpus).select("doc_id", "line_no", "aligned", "align_score")


@query()
def repair_text(spark, sf_dir):
    """Rewriting, snapping, alignment and calibration of distorted verses."""
    v = literals.verse_frame(spark).select(F.col("ord").alias("doc_id"), F.regexp_replace("line", "ः", ":").alias("text"), (F.col("ord") % 10 / 10.0).alias("raw_confidence"))
    return align.repair(v, align_corpus=True).select("doc_id", "corrected", "calibrated_confidence", "lexical_validity", "corpus_aligned_lines")


_BAD = "CASE WHEN item_id % 3 = 0 THEN replace(text, 'e', 'a') WHEN item_id % 3 = 1 THEN substr(text, 1, length(text) - 7) ELSE text || ' end' END"


def _pairs(spark, sf_dir):
    """Benchmark items and distorted copies."""
    k = F.col("item_id") % 3
    bad = (
        F.when(k == 0, F.replace("text", F.lit("e"), F.lit("a")))
        .when(k == 1, F.substring(F.col("text"), F.lit(1), F.length("text") - 7))
        .otherwise(F.concat("text", F.lit(" end")))
    )
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("ref"), bad.alias("hyp"))


_PAIRS = f"p AS (SELECT item_id AS pair_id, text AS ref, {_BAD} AS hyp FROM benchmark)"


def _spelt(side: str) -> str:
    """A list of units as a string of one ASCII character each: DuckDB counts bytes."""
    return f"array_to_string(list_transform({side}, lambda w: chr(CAST(32 + list_position(ws, w) AS INTEGER))), '')"


@query(
    f"""WITH {_PAIRS}, f AS (SELECT pair_id, string_split({sql_strip('ref')}, '') AS r, string_split({sql_strip('hyp')}, '') AS h FROM p),
    u AS (SELECT *, list_distinct(list_concat(r, h)) AS ws FROM f)
    SELECT pair_id, levenshtein({_spelt('r')}, {_spelt('h')}) / len(r)::DOUBLE AS cer FROM u"""
)
def cer_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", metrics.cer(F.col("ref"), F.col("hyp")).alias("cer"))


@query(
    f"""WITH {_PAIRS}, f AS (SELECT pair_id, list_filter(regexp_split_to_array(ref, '[{RE2_SPACE}]+'), lambda x: x <> '') AS r,
      list_filter(regexp_split_to_array(hyp, '[{RE2_SPACE}]+'), lambda x: x <> '') AS h FROM p),
    u AS (SELECT *, list_distinct(list_concat(r, h)) AS ws FROM f)
    SELECT pair_id, levenshtein({_spelt('r')}, {_spelt('h')}) / len(r)::DOUBLE AS wer FROM u"""
)
def wer_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", metrics.wer(F.col("ref"), F.col("hyp")).alias("wer"))


def _grams(units: str, n: int, glue: str) -> str:
    return f"CASE WHEN len({units}) >= {n} THEN list_transform(generate_series(1, len({units}) - {n - 1}), lambda k: array_to_string(list_slice({units}, CAST(k AS BIGINT), CAST(k + {n - 1} AS BIGINT)), '{glue}')) ELSE [] END"


def _counts(units: str, orders: int, glue: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT pair_id, {n} AS o, unnest({_grams(side, n, glue)}) AS gram, {int(side == 'h')} AS h, {int(side == 'r')} AS r FROM f" for n in range(1, orders + 1) for side in ("r", "h")
    )
    return f"""f AS (SELECT pair_id, {units.replace('{}', 'ref')} AS r, {units.replace('{}', 'hyp')} AS h FROM p), flat AS ({each}),
    c AS (SELECT pair_id, o, gram, sum(h) AS h, sum(r) AS r FROM flat GROUP BY pair_id, o, gram),
    n AS (SELECT o, sum(h) AS hyp, sum(r) AS ref, sum(least(h, r)) AS n_both FROM c GROUP BY o)"""


_CHARS = f"list_filter(string_split({sql_sub('{}', '[ \\t\\n\\v\\f\\r]+', '')}, ''), lambda c: c <> '')"
_MEAN = lambda c: "(" + " + ".join(f"coalesce(max(CASE WHEN o = {k} THEN n_both / {c}::DOUBLE END), 0.0::DOUBLE)" for k in range(1, 7)) + ") / count(*)"


@query(
    f"""WITH {_PAIRS}, {_counts(_CHARS, 6, '')}, m AS (SELECT {_MEAN('hyp')} AS p, {_MEAN('ref')} AS r FROM n WHERE hyp > 0 AND ref > 0)
    SELECT 100 * 5.0::DOUBLE * p * r / (4.0::DOUBLE * p + r) AS chrf FROM m"""
)
def chrf_corpus(spark, sf_dir):
    return metrics.chrf(_pairs(spark, sf_dir))


_TOKENS = f"list_filter(regexp_split_to_array({{}}, '[{RE2_SPACE}]+'), lambda c: c <> '')"


@query(
    f"""WITH {_PAIRS}, {_counts(_TOKENS, 4, ' ')}
    SELECT round(max(CASE WHEN o = 1 AND hyp < ref THEN exp(1 - ref / hyp::DOUBLE) WHEN o = 1 THEN 1.0::DOUBLE END) * exp(sum(ln(100.0::DOUBLE * n_both / hyp)) / 4), 6) AS bleu FROM n"""
)
def bleu_corpus(spark, sf_dir):
    """Corpus BLEU on blank-separated words."""
    return metrics.bleu(_pairs(spark, sf_dir), tokens=fields).select(F.round("bleu", 6).alias("bleu"))


@query(
    """WITH m AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END AS strategy, event_id % 7 AS err, event_id % 11 AS conf FROM events),
    s AS (SELECT strategy, sum(err) / greatest(count(err), 1)::DOUBLE AS err, sum(conf) / greatest(count(conf), 1)::DOUBLE AS conf FROM m GROUP BY strategy)
    SELECT strategy, err, conf, CASE WHEN b.base > 0 THEN (b.base - err) / b.base ELSE 0.0::DOUBLE END AS gain FROM s, (SELECT err AS base FROM s WHERE strategy = 'A') b"""
)
def bench_strategy_means(spark, sf_dir):
    """Means by strategy and the relative gain on the first."""
    m = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 2 == 0, "A").otherwise("D").alias("strategy"), (F.col("event_id") % 7).alias("err"), (F.col("event_id") % 11).alias("conf")
    )
    s = metrics.strategy_means(m, ["err", "conf"])
    base = s.where("strategy = 'A'").select(F.col("err").alias("base"))
    return s.withColumn("base", base.scalar()).select("strategy", "err", "conf", metrics.improvement(F.col("base"), F.col("err")).alias("gain"))


@query(
    f"""WITH {LINES_SQL}, c AS (SELECT doc_id, {sql_strip(sql_sub(sql_sub('line', '[\\r\\n\\t]+', ' '), ' +', ' '))} AS line FROM lines),
    w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(line, '[{RE2_SPACE}]+'), lambda x: x <> '')) AS word FROM c),
    v AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[{RE2_SPACE}]+'), lambda x: x <> '')) AS word FROM benchmark)
    SELECT lang, count(*) AS n_words, count(*) FILTER (WHERE v.word IS NOT NULL) AS n_hits FROM w JOIN documents USING (doc_id) LEFT JOIN v ON w.word = v.word GROUP BY lang"""
)
def line_dictionary_hits(spark, sf_dir):
    """Words of cleaned lines, and those in the dictionary, by language.

    The language travels with the document, so the only shuffle is the sum by
    language: the dictionary is a small distinct set that joins by hash.
    """
    from palmleaf.functions.text import one_line

    docs = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    words = docs.select("lang", F.explode(fields(one_line(F.col("line"), dots=False))).alias("word"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(fields(F.col("text"))).alias("word")).distinct().withColumn("hit", F.lit(1))
    # pre-aggregated on the left side of the join: one row a language and word
    return (
        words.groupBy("lang", "word").agg(F.count("*").alias("n"))
        .join(known, "word", "left")
        .groupBy("lang")
        .agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("n_hits"))
    )
