"""Corpus pipeline: language ID, near-dedup, decontamination, PII, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; all but the last return the columns of ``docs``.  Stages carry
whole rows as one struct, so further columns of any name pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.llm import decontaminate, language, neardup, packing, pii
from palmleaf.llm.common import stored, table
from palmleaf.llm.queries import pii_key

#: A document goes if no language has this share of it.
LEAST_SHARE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one struct."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def _columns(docs: DataFrame) -> list:
    return [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a leading language, go."""
    model = language.fit(language.training_rows(docs))
    told = language.identify(_rows(docs), model, ["row", "text"])
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.decontaminate(_rows(docs), table(spark, sf_dir, "benchmark"), ["row", "text"])
    return found.where(~F.col("contaminated")).select(*_columns(docs))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms in their formats."""
    done = pii.pseudonymise(_rows(docs), pii_key(spark))
    columns = _columns(docs)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns[docs.columns.index("n_chars")] = F.when(F.size("pii") > 0, size).otherwise(F.col("row.n_chars")).alias("n_chars")
    return done.select(*columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents left."""
    return packing.pack(docs, ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_pseudonyms", pii_pseudonyms),
    ("best_fit_packing", best_fit_packing),
]
#: No stage but decontamination can be put in SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
