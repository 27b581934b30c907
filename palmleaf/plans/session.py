"""Session preparation."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folder that holds this package.
ROOT = str(Path(__file__).resolve().parents[2])
#: Spark's switch for removing the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import the package when only the driver's path has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset (tests,
    one machine), a folder under the warehouse is set and used."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_palmleaf_checkpoints"
        sc.setCheckpointDir(where)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage and survives lost executors.  The shuffle files of the write go with its
    end: nothing reads them again, and the garbage collector would keep them for long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palmleaf-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a ``stored`` table that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/palmleaf-" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
