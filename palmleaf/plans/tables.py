"""Inputs shared by the queries: tables of a folder, and synthetic relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions.pyregex import SPACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, as a small file gives, dealt to all cores;
    larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n").alias("lines"))
    return docs.select("doc_id", F.posexplode("lines").alias("line_no", "line"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic segments: one a document line."""
    d, i = F.col("doc_id"), F.col("line_no")
    return document_lines(spark, sf_dir).select(
        "doc_id",
        i.cast("bigint").alias("seg_id"),
        F.col("line").alias("text"),
        ((d * 31 + i * 17) % 100 / 100.0).alias("conf"),
        ((d * 37 + i * 91) % 600).cast("int").alias("x"),
        (i * 20 + d % 7).cast("int").alias("y"),
        (F.length("line") * 5).cast("int").alias("w"),
        (F.lit(14) + (d + i) % 5).cast("int").alias("h"),
    )


#: Python white space for RE2, for use inside a class.
RE2_SPACE = r"\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{RE2_SPACE}]+|[{RE2_SPACE}]+$', '', 'g')"


def sql_sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


LINES_SQL = """
lines AS (
  SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line_no, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
"""
BOXES_SQL = (
    LINES_SQL
    + """, boxes AS (
  SELECT doc_id, CAST(line_no AS BIGINT) AS seg_id, line AS text, ((doc_id * 31 + line_no * 17) % 100) / 100.0::DOUBLE AS conf,
         CAST((doc_id * 37 + line_no * 91) % 600 AS INTEGER) AS x, CAST(line_no * 20 + doc_id % 7 AS INTEGER) AS y,
         CAST(length(line) * 5 AS INTEGER) AS w, CAST(14 + (doc_id + line_no) % 5 AS INTEGER) AS h FROM lines)
"""
)
__all__ = ["BOXES_SQL", "LINES_SQL", "RE2_SPACE", "SPACE", "boxes", "document_lines", "spread", "sql_strip", "sql_sub", "table"]
