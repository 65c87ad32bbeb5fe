"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names the folder. Where a session leaves it unset, a folder on this machine
is used if the master is local (tests); on a cluster the missing setting is an error, for a
machine-local folder would lose its files with the machine.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        place = tempfile.TemporaryDirectory(prefix="vecspan-")
        atexit.register(place.cleanup)
        _OWN[app] = f"file://{place.name}"
    return _OWN[app]


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    This cuts the lineage with files that outlive any executor, and fixes the values of
    expressions that could differ between runs of the plan. The shuffle files that made the table
    go with its last task, instead of with some later collection of the driver's garbage.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of batches, after which a task returns to the system what it has freed; workers live on, and would keep it."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return whole


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` returned and that nothing reads any more."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            drop_scratch(table.sparkSession, path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_row_key(docs: DataFrame, key: str = "_row", id_col: str = "doc_id") -> DataFrame:
    """Add a long that differs between all rows.

    It is ``id_col`` itself when that is a unique non-null integer (one small aggregate over that
    column alone decides). Otherwise rows are numbered and written once, so that the numbers hold
    for every later read.
    """
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        worst = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max(F.col(id_col).isNull().cast("int"))).first()
        if (worst[0] or 0) <= 1 and not worst[1]:
            return docs.withColumn(key, F.col(id_col).cast("long"))
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows")


def small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` (short) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
