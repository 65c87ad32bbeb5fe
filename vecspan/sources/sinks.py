"""Write documents as JSON, as lines or as arrays in files of a fixed number of documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prep import chunk_documents, chunk_name


def write_json_lines(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    docs.write.mode(mode).json(path)


def write_named(files: DataFrame, path: str) -> DataFrame:
    """Write each row (name, value) as a file of ``path``, a URI or an absolute path; the names and sizes that were written.

    A file is written under a name of its own and then renamed, so that a task may run again or twice. The result is that
    of one run, kept as it was.
    """
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, value in zip(names, batch.column("value").to_pylist()):
                data = value.encode("utf-8", "surrogatepass")
                hidden = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as f:
                    f.write(data)
                system.move(hidden, f"{root}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    rows = files.select("name", "value").mapInArrow(write, "name string, bytes long").collect()  # a name for each file
    return files.sparkSession.createDataFrame([tuple(r) for r in rows], "name string, bytes long")


def write_json_arrays(docs: DataFrame, path: str, order: str = "id", size: int = 100, base: str = "part") -> DataFrame:
    """One file ``<base>_<number of four digits>.json`` for each ``size`` documents, a JSON array of them; returns (name, bytes).

    A chunk has at most ``size`` rows, so its array fits a row.
    """
    numbered = chunk_documents(docs, order, size)
    whole = F.struct(*docs.columns)
    rows = numbered.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("position", F.to_json(whole).alias("doc")))).alias("rows"))
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["doc"]), ",\n"), F.lit("]"))
    name = F.concat(F.lit(f"{base}_"), F.when(F.col("chunk") < 10_000, F.lpad(F.col("chunk").cast("string"), 4, "0")).otherwise(F.col("chunk").cast("string")), F.lit(".json"))
    return write_named(rows.select(name.alias("name"), text.alias("value")), path)


__all__ = ["chunk_name", "write_json_arrays", "write_json_lines", "write_named"]
