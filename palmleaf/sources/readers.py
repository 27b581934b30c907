"""Sources: Parquet, CSV, JSON, label manifests, plain text, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palmleaf.functions.text import strip


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern has files, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    return found is not None and len(found) > 0


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, head: int | None = None) -> DataFrame:
    """A CSV file with a header; a missing one is an empty table.  ``head`` keeps the
    first rows of the file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return df.limit(head) if head is not None else df


def json_object(spark: SparkSession, path: str) -> DataFrame:
    """(ord, key, value) of one JSON object of strings, in its order."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    return whole.select(F.posexplode(entries).alias("ord", "e")).select("ord", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def manifest(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """(rel_path, label) of tab-separated lines; lines without a label go, and with
    ``images`` (rel_path) those without an image."""
    cut = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(cut) >= 2).select(strip(cut[0]).alias("rel_path"), strip(cut[1]).alias("label"))
    return rows if images is None else rows.join(images.select("rel_path").distinct(), "rel_path", "left_semi")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text) of text files, stripped."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), strip(F.col("value")).alias("text"))
    return rows.withColumn("stem", stem(F.col("path")))


def word_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a file with one a line; blank lines go."""
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).where("word <> ''").distinct()


def glyph_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, glyph): ids from 1 in the order of first appearance in one small file."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.array_distinct(F.filter(F.split("value", "\r?\n"), lambda x: x != ""))).alias("at", "glyph"))
    return whole.select((F.col("at") + 1).alias("id"), "glyph")


def stem(path):
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def image_files(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, stem, length) of image files; their bytes are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", stem(F.col("path")).alias("stem"), "length")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; undecodable files go."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")


def embedded_images(rows: DataFrame, image: str = "image") -> DataFrame:
    """Rows whose image struct has bytes."""
    return rows.where(F.col(f"{image}.bytes").isNotNull() & (F.length(f"{image}.bytes") > 0))


def pixels(decoded: DataFrame) -> DataFrame:
    """(img_id, y, x, c, v) of decoded images (origin, width, nChannels, data)."""
    n = F.length("data")
    at = F.explode(F.sequence(F.lit(0), n - 1)).alias("k")
    rows = decoded.where(n > 0).select(F.col("origin").alias("img_id"), "width", "nChannels", "data", at)
    step = F.col("width") * F.col("nChannels")
    value = F.conv(F.hex(F.substring(F.col("data"), F.col("k") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select(
        "img_id",
        F.floor(F.col("k") / step).cast("int").alias("y"),
        F.floor((F.col("k") % step) / F.col("nChannels")).cast("int").alias("x"),
        (F.col("k") % F.col("nChannels")).cast("int").alias("c"),
        value.alias("v"),
    )


def pair_by_stem(images_: DataFrame, truths: DataFrame) -> DataFrame:
    return images_.join(truths.select("stem", "text"), "stem")


def message(spark: SparkSession, text: str | None = None, path: str | None = None, default: str = "") -> DataFrame:
    """One row from an argument, a file or a default, in this order."""
    if text is None and path is not None:
        return whole_text(spark, path).select("text")
    return spark.createDataFrame([(text if text is not None else default,)], "text string")
