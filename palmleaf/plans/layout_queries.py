"""Queries of boxes, reading order, sequences, passes and recogniser results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palmleaf.operators import layout, sequence
from palmleaf.plans.tables import BOXES_SQL, LINES_SQL, boxes, document_lines, table
from palmleaf.sources import literals

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_STATS = """SELECT doc_id, sum(conf) / count(conf) AS mean_conf, min(conf) AS min_conf, max(conf) AS max_conf,
  count(*) AS n_segments, sum(length(trim(text))) AS n_text FROM boxes GROUP BY doc_id"""


@query(
    f"""WITH {BOXES_SQL} SELECT doc_id, count(*) AS n_segments, min(conf) AS min_conf, max(conf) AS max_conf, sum(length(trim(text))) AS n_text,
    sum(CAST(round(conf * 100) AS BIGINT)) / count(*)::DOUBLE < 88 OR min(conf) < 0.7::DOUBLE AS second FROM boxes GROUP BY doc_id"""
)
def seg_conf_stats(spark, sf_dir):
    """Confidence statistics of a page, and whether it needs a second pass."""
    segs = boxes(spark, sf_dir)
    stats = layout.confidence_stats(segs, ["doc_id"])
    cents = segs.groupBy("doc_id").agg((F.sum(F.round(F.col("conf") * 100).cast("bigint")) / F.count("*") / 100).alias("mean"))
    need = layout.needs_second_pass(F.col("n_segments"), F.col("mean"), F.col("min_conf"))
    return stats.join(cents, "doc_id").select("doc_id", "n_segments", "min_conf", "max_conf", F.col("n_text").cast("bigint").alias("n_text"), need.alias("second"))


@query(
    f"""WITH {LINES_SQL}, one AS (SELECT doc_id, count(*) AS n, sum(length(trim(line))) AS t, (doc_id * 31 % 100) / 100.0::DOUBLE AS c FROM lines WHERE doc_id % 5 > 0 GROUP BY doc_id),
    two AS (SELECT doc_id, count(*) AS n, sum(length(trim(line))) AS t, (doc_id * 17 % 100) / 100.0::DOUBLE AS c FROM lines WHERE line_no % 9 < 8 GROUP BY doc_id)
    SELECT coalesce(one.doc_id, two.doc_id) AS doc_id, CASE WHEN (one.n IS NULL AND two.n > 0) OR (one.n > 0 AND two.n > 0 AND two.c > one.c + 0.03::DOUBLE AND two.t >= floor(one.t * 0.85::DOUBLE))
      THEN 2 ELSE 1 END AS pass_selected FROM one FULL JOIN two ON one.doc_id = two.doc_id"""
)
def pass_select(spark, sf_dir):
    """The better of two passes of each page."""
    lines = document_lines(spark, sf_dir)

    def stats(rows, k):
        conf = (F.col("doc_id") * k % 100 / 100.0).alias("mean_conf")
        return rows.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.length(F.trim("line"))).alias("n_text")).select("doc_id", "n_segments", "n_text", conf)

    one, two = stats(lines.where("doc_id % 5 > 0"), 31), stats(lines.where("line_no % 9 < 8"), 17)
    return layout.choose_pass(one, two, "doc_id").select("doc_id", "pass_selected")


@query(
    f"""WITH {BOXES_SQL}, m AS (SELECT *, max(x + w) OVER (PARTITION BY doc_id) AS widest FROM boxes),
    c AS (SELECT doc_id, seg_id, x, y, CAST(floor(x / greatest(100.0::DOUBLE, widest * 0.3::DOUBLE)) AS BIGINT) AS col_id FROM m)
    SELECT doc_id, seg_id, col_id, row_number() OVER (PARTITION BY doc_id ORDER BY col_id, y, x, seg_id) AS pos FROM c"""
)
def reading_order_columns(spark, sf_dir):
    """Boxes by column band, then top, then left."""
    rows = layout.columns_of(boxes(spark, sf_dir), tolerance=0.3)
    w = Window.partitionBy("doc_id").orderBy("col_id", "y", "x", "seg_id")
    return rows.select("doc_id", "seg_id", "col_id", F.row_number().over(w).cast("bigint").alias("pos"))


@query()
def reading_order_exact(spark, sf_dir):
    return layout.reading_order(boxes(spark, sf_dir), multi_column=True, column_tol=0.3)


@query(
    f"""WITH {BOXES_SQL}, p AS (SELECT doc_id, seg_id, x, y, x + w AS x2, y + h AS y2, CAST(trunc(h * 0.18::DOUBLE) AS INTEGER) AS dy, w, h FROM boxes),
    b AS (SELECT doc_id, seg_id, x, CASE WHEN h > 0 THEN greatest(0, y - dy) ELSE y END AS y, w,
      CASE WHEN h > 0 THEN least(500, y2 + dy) - greatest(0, y - dy) ELSE h END AS h FROM p)
    SELECT doc_id, seg_id, x, y, w, h, greatest(320, least(1024, CAST(floor((greatest(32, CAST(trunc(w * (48.0::DOUBLE / greatest(1, h))) AS INTEGER)) + 15) / 16.0::DOUBLE) * 16 AS INTEGER))) AS width FROM b"""
)
def box_geometry(spark, sf_dir):
    """Padded boxes of polygons and the widths of their crops."""
    c = {k: F.col(k).cast("double") for k in "xywh"}
    corner = lambda a, b: F.array(a, b)
    poly = F.array(
        corner(c["x"], c["y"]), corner(c["x"] + c["w"], c["y"]), corner(c["x"] + c["w"], c["y"] + c["h"]), corner(c["x"], c["y"] + c["h"])
    )
    rows = boxes(spark, sf_dir).withColumn("b", layout.box(poly, height=F.lit(500)))
    return rows.select("doc_id", "seg_id", "b.*").withColumn("width", layout.crop_width(F.col("w"), F.col("h")))


_JSON = [
    (0, '{"rec_texts": ["कर्म", "धर्म"], "rec_scores": [0.9, 0.8], "rec_polys": [[[40,40],[90,40],[90,55],[40,55]], [[10,10],[70,10],[70,25],[10,25]]]}'),
    (1, '{"rec_texts": ["a", " ", "b"], "rec_scores": [0.5, 0.6], "dt_polys": [[[0,0],[10,0],[10,10],[0,10]], [[0,0],[1,0],[1,1],[0,1]], [[5,5],[6,5],[6,6],[5,6]]]}'),
    (2, '{"rec_texts": [], "rec_scores": []}'),
]


@query(
    """SELECT * FROM (VALUES (0, 0, 'कर्म', 0.9::DOUBLE, 40, 38, 50, 19), (0, 1, 'धर्म', 0.8::DOUBLE, 10, 8, 60, 19), (1, 0, 'a', 0.5::DOUBLE, 0, 0, 10, 11))
    AS t(page_id, seg_id, text, conf, x, y, w, h)"""
)
def result_normalise(spark, sf_dir):
    """Pages of parallel lists as segments."""
    pages = spark.createDataFrame(_JSON, "page_id int, raw string").select("page_id", F.from_json("raw", layout.PAGE_SCHEMA).alias("page"))
    return layout.segments(pages).select("page_id", "seg_id", "text", "conf", "box.*")


@query(
    """WITH c AS (SELECT * FROM (VALUES (0, 'click'), (1, 'view'), (2, 'purchase')) AS t(class_idx, name))
    SELECT event_type, class_idx, count(*) AS n FROM events LEFT JOIN c ON event_type = name GROUP BY event_type, class_idx"""
)
def class_lookup(spark, sf_dir):
    """Class numbers of names, null for unknown ones."""
    classes = spark.createDataFrame([(0, "click"), (1, "view"), (2, "purchase")], "class_idx int, name string")
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(classes, F.col("event_type") == F.col("name"), "left").select("event_type", "class_idx", "n")


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{g}', '{label}', '{name}')" for i, g, label, name in literals.classes())
    + ") AS t(class_idx, devanagari, label, name)"
)
def class_table(spark, sf_dir):
    """The character classes."""
    return literals.frame(spark, literals.classes(), "class_idx int, devanagari string, label string, name string").drop("ord")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(
    f"""WITH i AS (SELECT item_id, list_filter(list_transform(string_split(lower(text), ''), lambda c: position(c IN '{_LETTERS}')), lambda k: k > 0) AS ids FROM benchmark)
    SELECT item_id, len(ids) AS n_ids, array_to_string(list_concat(list_slice(ids, 1, 64), list_transform(generate_series(1, 64 - least(64, len(ids))), lambda k: 0)), ' ') AS padded FROM i"""
)
def id_encode(spark, sf_dir):
    """Letters as ids, cut or padded to 64."""
    ids = sequence.encode(F.lower("text"), {c: k + 1 for k, c in enumerate(_LETTERS)})
    rows = table(spark, sf_dir, "benchmark").select("item_id", ids.alias("ids"))
    padded = F.array_join(F.transform(sequence.pad(F.col("ids")), lambda x: x.cast("string")), " ")
    return rows.select("item_id", F.size("ids").cast("bigint").alias("n_ids"), padded.alias("padded"))


@query(
    """WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 4 AS id, lag(CAST(floor(value) AS BIGINT) % 4) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    k AS (SELECT user_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY event_id) FILTER (WHERE id <> 0 AND (before IS NULL OR id <> before)) AS ids FROM e GROUP BY user_id)
    SELECT user_id, coalesce(ids, '') AS ids FROM k"""
)
def ctc_decode(spark, sf_dir):
    """Steps of each user without repeats and blanks."""
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 4).alias("id"))
    path = steps.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "id"))), lambda x: x["id"]).alias("path"))
    kept = sequence.collapse(F.col("path"))
    return path.select("user_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), " ").alias("ids"))


@query(
    """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, count(*) OVER () AS n FROM documents)
    SELECT doc_id, position, CASE WHEN position <= floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM d"""
)
def manifest_split(spark, sf_dir):
    """The first 85 % of the documents train."""
    return sequence.positional_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
