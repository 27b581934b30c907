"""Java functions of this package, compiled by the compiler that Spark generates code with."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOADED: dict[tuple[str, Path], object] = {}


def java_class(spark: SparkSession, source: Path):
    """The class of a source file; the executors get it as a jar from the driver."""
    sc = spark.sparkContext
    if (known := _LOADED.get((sc.applicationId, source))) is not None:
        return known
    compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(sc._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    compiler.cook(source.name, sc._jvm.java.io.StringReader(source.read_text("utf-8")))
    packed, names = io.BytesIO(), []
    with zipfile.ZipFile(packed, "w") as jar:
        for entry in compiler.getBytecodes().entrySet():
            names.append(entry.getKey())
            jar.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
    path = Path(tempfile.mkdtemp(prefix="palmleaf-")).resolve() / f"{source.stem}.jar"
    path.write_bytes(packed.getvalue())
    sc._jsc.addJar(str(path))
    name = next(n for n in names if n.rpartition(".")[2] == source.stem)
    return _LOADED.setdefault((sc.applicationId, source), compiler.getClassLoader().loadClass(name))


def function(spark: SparkSession, source: Path, schema: str, *args) -> Callable[[Column], Column]:
    """A function of one column: the class's ``call``, of an instance made with these arguments."""
    sc, session = spark.sparkContext, spark._jsparkSession
    values = sc._gateway.new_array(sc._jvm.java.lang.Object, len(args))
    for k, value in enumerate(args):
        values[k] = value
    made = java_class(spark, source).getConstructors()[0].newInstance(values)
    name = f"palmleaf_{source.stem.lower()}_{uuid.uuid4().hex}"
    session.udf().register(name, made, session.parseDataType(StructType.fromDDL(schema).json()))
    return lambda column: F.call_function(name, column)
