"""Queries of the training-data operators over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.llm import chat, decontaminate, html_extract, language, neardup, packing, pii, quality, secrets, url_filter
from palmleaf.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(
        table(spark, sf_dir, "pages"), url_filter.default_rules(spark), url_filter.default_list(spark), ["page_id"]
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    )
    model = language.fit(language.training_rows(docs.where(~F.col("held_out"))))
    return language.identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def pii_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms, from the session; the synthetic tables hold no
    real person and have a published one."""
    return spark.conf.get("spark.palmleaf.pii.key", "synthetic tables")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark))
    n_of = lambda kind: F.coalesce(
        F.get(F.transform(F.filter("pii", lambda x: x["kind"] == kind), lambda x: x["n"]), F.lit(0)), F.lit(0)
    ).alias(f"n_{kind}")
    return docs.select("doc_id", "text", *map(n_of, pii.KINDS))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return quality.apply_policy(book).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_decontaminate,
        op3_language,
        op4_pii,
        op5_quality,
        op6_secrets,
        op7_html,
        op8_chat,
        op9_neardup,
        op10_packing,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": url_filter.sql(), "op8_chat": chat.SQL}
