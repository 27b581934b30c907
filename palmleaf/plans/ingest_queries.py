"""Queries of filters, merges, limits and pairings."""

from __future__ import annotations

from pyspark.sql import functions as F

from palmleaf.operators import ingest
from palmleaf.plans.tables import table
from palmleaf.sources.readers import stem

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH r AS (SELECT conv_id, turn, text AS surface FROM conversations), k AS (SELECT text AS surface FROM benchmark),
    f AS (SELECT surface, arg_min(conv_id, (conv_id, turn)) AS conv_id, arg_min(turn, (conv_id, turn)) AS turn FROM r GROUP BY surface)
    SELECT surface, conv_id, turn FROM f WHERE surface NOT IN (SELECT surface FROM k)"""
)
def rule_anti_dedupe(spark, sf_dir):
    """New surfaces, each once, the first one."""
    found = table(spark, sf_dir, "conversations").select(F.col("text").alias("surface"), "conv_id", "turn").withColumn("o", F.struct("conv_id", "turn"))
    known = table(spark, sf_dir, "benchmark").select(F.col("text").alias("surface"))
    return ingest.new_rules(found, known, ["surface"], "o").select("surface", "conv_id", "turn")


@query(
    """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce('q' || l.quality, d.lang) AS value, l.doc_id IS NOT NULL AND d.doc_id IS NULL AS added
    FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 3 > 0) d FULL JOIN labels l ON d.doc_id = l.doc_id"""
)
def dict_merge(spark, sf_dir):
    """Old values overridden by new ones, and which keys are new."""
    old = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", F.col("lang").alias("value"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("value"))
    added = new.join(old, "doc_id", "left_anti").select("doc_id", F.lit(True).alias("added"))
    return ingest.merge(old, new, "doc_id", "value").join(added, "doc_id", "left").withColumn("added", F.coalesce("added", F.lit(False)))


@query("SELECT count(*) AS n_added FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0)")
def key_set_difference(spark, sf_dir):
    old = table(spark, sf_dir, "documents").where("doc_id % 3 > 0")
    return ingest.added_keys(old, table(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH p AS (SELECT item_id AS o, text AS k, 'v' || item_id AS v FROM benchmark),
    i AS (SELECT o * 2 AS o, k, v FROM p UNION ALL SELECT o * 2 + 1, trim(regexp_replace(k, '[।॥|\\-_,.;:\\n\\r\\t\\x{22}\\x{27}!?()<>]+', ' ', 'g')), v FROM p)
    SELECT k, arg_max(v, o) AS v FROM i WHERE k <> '' GROUP BY k"""
)
def dual_index(spark, sf_dir):
    """Items under their text and its punctuation-free form; the last wins."""
    pairs = table(spark, sf_dir, "benchmark").select("item_id", "text", F.concat(F.lit("v"), "item_id").alias("v"))
    return ingest.dual_index(pairs, "text", "v", "item_id")


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '([^/]+)[.][^./]+$', 1) AS stem FROM pages)
    SELECT p.page_id, p.stem, d.lang FROM p JOIN (SELECT CAST(doc_id AS VARCHAR) AS stem, lang FROM documents) d ON p.stem = d.stem"""
)
def pair_by_stem(spark, sf_dir):
    """Pages and documents with the same stem."""
    pages = table(spark, sf_dir, "pages").select("page_id", stem(F.col("url")).alias("stem"))
    return pages.join(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), "lang"), "stem")


@query(
    """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant')
    SELECT u.conv_id, CAST(u.pos AS INTEGER) AS pos, u.turn, a.turn AS turn_r FROM u JOIN a ON u.conv_id = a.conv_id AND u.pos = a.pos"""
)
def zip_positional(spark, sf_dir):
    """User and assistant turns paired by position; the shorter side ends it."""
    side = lambda role: table(spark, sf_dir, "conversations").where(F.col("role") == role).select("conv_id", "turn")
    return ingest.zip_rows(side("user"), side("assistant"), "conv_id", "turn")


@query(
    """SELECT doc_id, 'first' AS kind FROM documents WHERE doc_id < 50 AND lang = 'en'
    UNION ALL SELECT doc_id, 'valid' FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50)
    UNION ALL SELECT doc_id, 'head' FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20)"""
)
def limit_semantics(spark, sf_dir):
    """A cut by index, a cut by passing rows and a plain head."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    en = F.col("lang") == "en"
    named = lambda rows, kind: rows.select("doc_id", F.lit(kind).alias("kind"))
    return (
        named(ingest.first_records(docs, "doc_id", 50, en), "first")
        .unionByName(named(ingest.first_valid(docs, "doc_id", 50, en), "valid"))
        .unionByName(named(ingest.head(docs, "doc_id", 20), "head"))
    )


@query(
    """WITH p AS (SELECT conv_id, max(CASE WHEN role = 'user' AND turn = 0 THEN text END) AS u, max(CASE WHEN role = 'assistant' AND turn = 1 THEN text END) AS a
      FROM conversations GROUP BY conv_id),
    r AS (SELECT conv_id, u || '### Assistant:' || a || CASE WHEN conv_id % 7 = 0 THEN '### Assistant:' ELSE '' END AS text FROM p),
    s AS (SELECT conv_id, string_split(text, '### Assistant:') AS parts FROM r),
    c AS (SELECT conv_id, trim(regexp_replace(regexp_replace(parts[2], '[\\r\\n\\t]+', ' ', 'g'), ' +', ' ', 'g')) AS source,
      trim(regexp_replace(regexp_replace(parts[1], '[*][^*]+(?:[*]|$)', '', 'g'), ' +', ' ', 'g'), ' ' || chr(10)) AS english FROM s WHERE len(parts) = 2)
    SELECT conv_id, source, english FROM c WHERE source <> '' AND english <> '' AND len(regexp_extract_all(source, '[a-z]')) >= 5"""
)
def chat_split(spark, sf_dir):
    """Marked records cut into cleaned pairs; records with two markers go."""
    at = lambda role, turn: F.max(F.when((F.col("role") == role) & (F.col("turn") == turn), F.col("text")))
    two = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(at("user", 0).alias("u"), at("assistant", 1).alias("a"))
    more = F.when(F.col("conv_id") % 7 == 0, ingest.MARKER).otherwise("")
    records = two.select("conv_id", F.concat("u", F.lit(ingest.MARKER), "a", more).alias("text"))
    return ingest.parallel_pairs(records, script="[a-z]").select("conv_id", "source", "english")


@query(
    """SELECT doc_id, lang FROM documents WHERE regexp_matches(text, 'tion[a-d]') OR regexp_matches(lang, '(?i)ES')"""
)
def keyword_search(spark, sf_dir):
    """A pattern in the text, or any case of a word in the other column."""
    return ingest.keyword(table(spark, sf_dir, "documents"), "tion[a-d]", "text", "lang").select("doc_id", "lang").unionByName(
        table(spark, sf_dir, "documents").where(~F.coalesce(F.col("text").rlike("tion[a-d]"), F.lit(False)) & F.col("lang").rlike("(?i)ES")).select("doc_id", "lang")
    )


@query(
    """SELECT conv_id, turn, substr(text, 1, 40) AS surface, lower(substr(text, 1, 40)) AS split FROM conversations
    WHERE text <> '' AND substr(text, 1, 40) <> lower(substr(text, 1, 40)) AND length(substr(text, 1, 40)) <= 39"""
)
def sandhi_filter(spark, sf_dir):
    """Pairs with both sides, different, and a short surface."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("text", 1, 40).alias("surface")).withColumn("split", F.lower("surface"))
    return ingest.sandhi_filter(rows, "surface", "split", 39)
