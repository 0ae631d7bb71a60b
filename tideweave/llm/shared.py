"""Folders that the driver and all executors share, and tables kept there.

``spark.checkpoint.dir`` names the shared folder of a cluster.  Only where it is unset (tests,
``local[n]``) a folder of this machine is made and set for the session.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, as a URI or path without a closing slash."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tideweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    # with its scheme, so that Spark and other readers mean the same file system
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return ("file://" + at[len("file:") :] if at.startswith("file:/") and not at.startswith("file://") else at).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/tideweave/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs one read of the table, never the work before it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(docs: DataFrame, **keys) -> DataFrame:
    """The columns ``keys`` beside each row of ``docs`` as a struct ``row``: no name of ``docs`` can clash."""
    return docs.select(*(c.alias(n) for n, c in keys.items()), F.struct(*(docs[c] for c in docs.columns)).alias("row"))


#: Bits of a filter that is sent to all tasks, a power of two: 2 MB as a table.
FILTER_BITS = 1 << 23


def filter_of(ids: DataFrame, id_col: str) -> DataFrame:
    """A filter of fixed size over identifiers: FILTER_BITS / 64 rows (word, bits) at most."""
    place = f"pmod(xxhash64({id_col}), {FILTER_BITS})"
    return ids.groupBy(F.expr(f"shiftright({place}, 6)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} & 63 as int))")).alias("bits"))


def may_hold(rows: DataFrame, id_col: str, filter_rows: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false where the identifier is surely not in the filter."""
    place = f"pmod(xxhash64({id_col}), {FILTER_BITS})"
    found = rows.join(F.broadcast(filter_rows), F.expr(f"shiftright({place}, 6)") == F.col("word"), "left")
    return found.withColumn("maybe", F.expr(f"coalesce(shiftrightunsigned(bits, cast({place} & 63 as int)) & 1, 0) = 1")).drop("word", "bits")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes and rows of a batch that goes to or from a Python worker, at most.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches: texts are long, and each worker holds a batch or two."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key, "1000000000")).rstrip("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return memory that this process has freed to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work):
    """A function over a partition's batches that gives memory back when it has ended."""

    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
