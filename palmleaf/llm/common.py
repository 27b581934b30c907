"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.plans.session import discard, prepare, shared_dir, stored

#: Rows of one Arrow batch sent to a Python worker.  Texts can be long, so the
#: default of 10,000 rows would let a batch grow to gigabytes.
ARROW_ROWS = 64


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers hold; returns ``spark``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unclashed(keep: list[str], *own: str) -> list[str]:
    """``keep`` without names of an operator's own columns: those win."""
    return [c for c in keep if c not in own]


def with_text(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int]:
    """``keep`` columns and the text, and the text's place: a text that is kept
    anyway travels to Python once."""
    if text_col in keep:
        return docs.select(*keep), keep.index(text_col)
    return docs.select(*keep, F.col(text_col).alias("__text")), len(keep)


def texts_of(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    """A batch's texts as UTF-8 bytes."""
    return batch.column(at).cast(pa.binary()).to_pylist()


def kept(batch: pa.RecordBatch, n: int) -> list[pa.Array]:
    return batch.columns[:n]


def fields(docs: DataFrame, keep: list[str]) -> list[str]:
    """Schema entries of the kept columns."""
    return [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]


__all__ = ["discard", "fields", "kept", "prepare", "shared_dir", "stored", "table", "texts_of", "tune", "unclashed", "with_text"]
