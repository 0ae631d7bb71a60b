"""The context mixer as functions of Spark.

Coding a text bit by bit is a loop that neither SQL functions nor numpy can run in bounded time, so
it is Java (``java/Mixer.java``), compiled by the compiler that Spark itself generates code with.  The
classes go as a jar into the shared folder, and from there to the executors.
"""

from __future__ import annotations

import io
import pkgutil
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, kept

#: Packed models that are added at a time.
FAN_IN = 8
_COMPILED: dict[str, object] = {}


def _classes(spark: SparkSession):
    """Loader of the compiled classes, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _COMPILED:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data(__package__, "java/Mixer.java").decode())
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        path = jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "mixer") + ".jar")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(packed.getvalue())
        out.close()
        spark.sparkContext._jsc.sc().addJar(path.toString())
        _COMPILED.clear()
        _COMPILED[app] = compiler.getClassLoader()
    return _COMPILED[app]


def _new(spark: SparkSession, name: str, *args):
    """An object of a nested class, which has one constructor."""
    java, gateway = spark._jvm.java, spark.sparkContext._gateway
    values = gateway.new_array(java.lang.Object, len(args))
    for i, x in enumerate(args):
        values[i] = x
    return _classes(spark).loadClass(f"tideweave.llm.Mixer${name}").getConstructors()[0].newInstance(values)


def _function(spark: SparkSession, name: str, made) -> Callable[[Column], Column]:
    """A registered function from an array of models, or a text, to bytes."""
    spark._jsparkSession.udf().register(name, made, spark._jsparkSession.parseDataType('"binary"'))
    return lambda c: F.call_function(name, c)


def _aggregate(spark: SparkSession) -> Callable[[Column], Column]:
    jvm = spark._jvm
    made = jvm.org.apache.spark.sql.functions.udaf(_new(spark, "Learn"), jvm.org.apache.spark.sql.Encoders.BINARY())
    spark._jsparkSession.udf().register("tideweave_mixer_learn", made)
    return lambda c: F.call_function("tideweave_mixer_learn", c)


def learn(texts: DataFrame, text_col: str = "text") -> bytes:
    """A packed model of all texts: tables of fixed size, some MB however large the input is.

    Every partition learns on its own, online; the models are added up in a tree, in the order of the
    partitions, and the last one comes to the driver.  Without rows the model is empty.
    """
    spark = texts.sparkSession
    rows = texts.select(F.spark_partition_id().alias("part"), F.col(text_col).cast("binary").alias("text"))
    rows = kept(rows.groupBy("part").agg(_aggregate(spark)(F.col("text")).alias("model")), "models")
    add = _function(spark, "tideweave_mixer_add", _new(spark, "Add"))
    last = rows.agg(F.max("part")).first()[0]
    while last:
        ordered = F.array_sort(F.collect_list(F.struct("part", "model")))
        rows = rows.groupBy(F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(ordered.alias("models"))
        rows = kept(rows.select("part", add(F.col("models.model")).alias("model")), "models")
        last //= FAN_IN
    found = rows.first()
    return bytes(found.model if found else _new(spark, "Add").pack())


def scorer(spark: SparkSession, model: bytes) -> Callable[[Column], Column]:
    """Function from a text's bytes to the log10 probabilities (float32) of its tokens."""
    sent = spark._jsc.broadcast(model)
    return _function(spark, "tideweave_mixer_score", _new(spark, "Score", sent))
