"""Ingest JSON documents as files arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import normalize
from ..sources.json_dir import parse_documents


def ingest_stream(spark: SparkSession, source: str, out: str, checkpoint: str, dim: int) -> StreamingQuery:
    """Read new files of ``source`` once, and append their valid documents, normalized, to the Parquet table ``out``.

    Files that earlier runs read are skipped by the stream's checkpoint; the file sink commits each batch once.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(source)
    rows = parse_documents(files.select(F.col("_metadata.file_path").alias("source_file"), "value"), dim)
    valid = rows.where("reason IS NULL").select("id", "text", "metadata_json", normalize(F.col("embedding")).cast("array<float>").alias("embedding"))
    return valid.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
