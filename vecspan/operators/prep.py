"""Number rows in order, and cut a corpus into chunks of equally many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``position``, from 0, in the order of ``order``; rows that tie go by a hash of all their columns.

    Rows are range-partitioned and written once with their partition's number, so that what is counted and what is numbered
    agree; then each partition adds the rows of those before it. No task holds more than its range. Ranges hold rows of equal order
    together only if their hashes are, so that a frequent value spreads too.
    """
    tie = F.xxhash64(*[F.to_json(c) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in df.columns])
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.withColumn("_tie", tie)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(keyed.repartitionByRange(n, *columns, F.col("_tie")).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*columns, "_tie")) - 1
    numbered = ranged.withColumn("_in", inside).join(F.broadcast(before), "_part")  # a row for each shuffle partition
    return numbered.withColumn("position", (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before", "_tie")


def chunk_documents(docs: DataFrame, order: str, size: int = 100) -> DataFrame:
    """Add ``position`` (from 0, in the order of ``order``) and ``chunk`` (position over ``size``)."""
    if size < 1:
        raise ValueError("size must be positive")
    return number_rows(docs, order).withColumn("chunk", F.floor(F.col("position") / size).cast("long"))


def chunk_name(base: str, number: int) -> str:
    """File name of a chunk: the base name and four digits, or more if they are needed."""
    return f"{base}_{number:04d}.json"
