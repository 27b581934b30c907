"""Sinks: JSON, TSV, manifests, images, text, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, text unescaped."""
    rows.write.mode("overwrite").json(path)


def json_object(rows: DataFrame, path: str, key: str, value: str, order: str) -> None:
    """Pairs as JSON lines in their order; a single object is only for dictionaries
    that fit one file, see ``json_document``."""
    rows.orderBy(order).select(F.to_json(F.create_map(key, value)).alias("value")).write.mode("overwrite").text(path)


def json_document(rows: DataFrame, path: str, key: str, value: str, order: str, most: int = 1_000_000) -> None:
    """One JSON object; refuses tables of more than ``most`` rows."""
    if rows.count() > most:
        raise ValueError("too many rows for one JSON document: write JSON lines")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(value).alias("v"))))
    as_map = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"], x["v"])))
    rows.agg(F.to_json(as_map).alias("value")).write.mode("overwrite").text(path)


def tsv(rows: DataFrame, path: str, *columns: str) -> None:
    """Tab-separated with a header; tabs in values become blanks."""
    rows.select(*[F.translate(F.col(c).cast("string"), "\t", " ").alias(c) for c in columns]).write.mode("overwrite").csv(
        path, sep="\t", header=True, quote="\u0000", escapeQuotes=False, emptyValue=""
    )


def manifest(rows: DataFrame, path: str, rel_path: str = "rel_path", label: str = "label", split: str = "split") -> None:
    """``rel_path<TAB>label`` lines, a folder for each split."""
    line = F.concat_ws("\t", rel_path, label).alias("value")
    rows.select(line, F.col(split)).write.mode("overwrite").partitionBy(split).text(path)


def numbered(rows: DataFrame, at: str, pattern: str = "ext_ocr_%05d.png") -> DataFrame:
    """``file_name`` from a row number, zero-padded."""
    return rows.withColumn("file_name", F.format_string(pattern, F.col(at)))


def image_bytes(rows: DataFrame, path: str, name: str = "file_name", content: str = "content") -> None:
    """Image bytes as Parquet with their names: one table, not one file an image."""
    rows.select(name, content).write.mode("overwrite").parquet(path)


def grey_png(rows: DataFrame, width: str = "width", height: str = "height", data: str = "data", keep: str = "file_name") -> DataFrame:
    """(keep, content): grey images as PNG bytes."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, raw in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                lines = b"".join(b"\0" + raw[y * w : (y + 1) * w] for y in range(h))
                head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
                out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[keep, "content"])

    return rows.select(keep, F.col(width).cast("int"), F.col(height).cast("int"), data).mapInArrow(encode, f"`{keep}` string, content binary")


def text(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(column).write.mode("overwrite").text(path)


def bilingual_report(rows: DataFrame, source: str = "cleaned", target: str = "english") -> DataFrame:
    """Lines of a two-language report, one block a row."""
    return rows.select(F.concat(F.lit("Sanskrit:\n"), F.col(source), F.lit("\n\nEnglish:\n"), F.col(target), F.lit("\n")).alias("text"))


def percent(column, digits: int = 2):
    return F.format_string(f"%.{digits}f%%", column * 100)
