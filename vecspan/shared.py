"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_place(spark: SparkSession, tag: str) -> str:
    """A path of its own, as a URI, in the folder of ``spark.checkpoint.dir``; on this machine if the master is local and none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            place = tempfile.TemporaryDirectory(prefix="vecspan-core-")
            atexit.register(place.cleanup)
            _OWN[app] = place.name
        named = _OWN[app]
    uri = named if "://" in named else f"file://{named.removeprefix('file:')}"
    return f"{uri.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read back: the same rows at every later read, whatever executors are lost."""
    path = shared_place(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
