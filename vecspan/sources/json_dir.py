"""Read a directory of JSON documents with strict types, keeping what is valid and saying why the rest isn't."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import is_finite

LARGE_FILE = 8 << 20  #: bytes of a file that is still parsed whole
RAW_CHARS = 1 << 16  #: of a broken file that are kept to show it
_NUMBERS = "^ARRAY<(VOID|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _kind(v: str) -> str:
    return f"coalesce(schema_of_variant({v}), 'MISSING')"


def parse_documents(files: DataFrame, dim: int) -> DataFrame:
    """One row for each document in ``files`` (source_file, value), valid or not.

    ``value`` is a file's whole text: one JSON object, or an array of them. Types are as strict as the document's
    schema: id and text must be JSON strings, metadata an object, its embedding an array of exactly ``dim``
    JSON numbers, all finite as 32-bit floats. ``reason`` is null for a valid document and otherwise one of parse_error,
    not_object, bad_id, bad_text, bad_metadata, bad_embedding, wrong_dim and non_finite.
    """
    parsed = files.select("source_file", F.expr("try_parse_json(value)").alias("v"), "value")
    # the text stays only where it can't be parsed: every document of a file would carry it else
    listed = parsed.select("source_file", F.col("v").isNull().alias("broken"), F.when(F.col("v").isNull(), F.col("value")).alias("value"), F.expr(f"CASE WHEN {_kind('v')} LIKE 'ARRAY%' THEN variant_get(v, '$', 'array<variant>') ELSE array(v) END").alias("ds"))
    return _checked(listed.select("source_file", "broken", "value", F.posexplode("ds").alias("doc_index", "d")), dim)


def _checked(each: DataFrame, dim: int) -> DataFrame:
    """Judge documents (source_file, broken, value, doc_index, d as variant)."""
    fields = each.select(
        "source_file",
        "doc_index",
        "broken",
        F.when(F.col("broken"), F.substring("value", 1, RAW_CHARS)).otherwise(F.expr("to_json(d)")).alias("raw"),
        F.expr(_kind("d")).alias("kind"),
        *[F.expr(f"CASE WHEN {_kind('d')} LIKE 'OBJECT%' THEN try_variant_get(d, '$.{name}', 'variant') END").alias(name) for name in ("id", "text", "metadata")],
    ).withColumn("emb", F.expr(f"CASE WHEN {_kind('metadata')} LIKE 'OBJECT%' THEN try_variant_get(metadata, '$.embedding', 'variant') END"))
    # the type of all elements at once; nulls don't show in it
    numeric = F.expr(f"{_kind('emb')} RLIKE '{_NUMBERS}'")
    numbers = _apart(fields).withColumn("x", F.when(numeric, F.expr("try_variant_get(emb, '$', 'array<double>')")))
    numbers = numbers.withColumn("numeric", F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull()))
    reason = (
        F.when(F.col("broken"), "parse_error")
        .when(~F.col("kind").like("OBJECT%"), "not_object")
        .when(F.expr(_kind("id")) != "STRING", "bad_id")
        .when(F.expr(_kind("text")) != "STRING", "bad_text")
        .when(~F.expr(_kind("metadata")).like("OBJECT%"), "bad_metadata")
        .when(~F.col("numeric"), "bad_embedding")
        .when(F.size("x") != dim, "wrong_dim")
        .when(~is_finite(F.col("x")), "non_finite")
    )
    return _apart(_apart(numbers).withColumn("reason", reason)).select(
        "source_file",
        "doc_index",
        "reason",
        "raw",
        *[F.when(F.col("reason").isNull(), value).alias(name) for name, value in _document().items()],
    )


def _apart(df: DataFrame) -> DataFrame:
    """``df``, with expressions that the optimizer doesn't repeat in what follows, as it would in filters above."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*")


def _document() -> dict[str, Column]:
    return {
        "id": F.expr("cast(id AS string)"),
        "text": F.expr("cast(text AS string)"),
        "metadata_json": F.expr("to_json(metadata)"),
        "embedding": F.col("x").cast("array<float>"),
    }


def read_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(source_file, value) of the files right in ``path`` whose names end in .json, in that case; of ``most`` bytes, if that is given.

    Files in sub-directories are left out. A path that doesn't exist is an error. Names that begin with
    ``_`` or ``.`` are hidden from Spark's file sources, and so are left out too.
    """
    text = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(path)
    if most is not None:
        text = text.where(F.col("_metadata.file_size") <= most)
    return text.select(F.col("_metadata.file_path").alias("source_file"), "value")


_STRING = rb'"(?:[^"\\]|\\.)*+"'
_DEEP = re.compile(_STRING + rb"|[\[\]{}]", re.S)
_FLAT = re.compile(_STRING + rb"|[\[\]{},]", re.S)


def array_elements(read: Callable[[int], bytes], chunk: int = 8 << 20, check: bool = True) -> Iterator[bytes]:
    """The elements of a JSON array, or the one value, that a stream of bytes holds; ValueError if it isn't JSON.

    Only the element at hand is in memory, and a chunk. Elements are found by their brackets and strings, and each is
    parsed to make sure that it is JSON, with ``check``.
    """

    def valid(data: bytes) -> bytes:
        def no(name: str) -> None:
            raise ValueError(name)

        if check:
            json.loads(data, parse_constant=no)
        return data.strip()

    held, at, start, depth, after_comma = bytearray(read(chunk)), 0, 0, 0, False
    while not held.strip() and (more := read(chunk)):
        held = bytearray(more)
    if not bytes(held.lstrip()).startswith(b"["):
        while more := read(chunk):
            held += more
        yield valid(bytes(held))
        return
    while True:
        found = (_FLAT if depth <= 1 else _DEEP).search(held, at)
        # a string may go on beyond what is read; so may what a failed search has left
        quote = held.find(b'"', at, found.start() if found else len(held)) if found is None or held[found.start()] != 34 else -1
        if found is None or quote >= 0:
            more = read(chunk)
            if not more:
                raise ValueError("the text ends within a value")
            del held[:start]
            at, start = (quote if quote >= 0 else len(held) + start) - start, 0
            held += more
            continue
        at = found.end()
        c = held[found.start()]
        if c in b"[{":
            depth += 1
            if depth == 1:
                start = at
        elif c == 44:
            yield valid(bytes(held[start : at - 1]))
            after_comma, start = True, at
        elif c in b"]}":
            depth -= 1
            if not depth:
                if c != 93:
                    raise ValueError("brackets don't match")
                last = bytes(held[start : at - 1])
                if last.strip() or after_comma:
                    yield valid(last)
                rest = bytes(held[at:])
                while not rest.strip():
                    rest = read(chunk)
                    if not rest:
                        return
                raise ValueError("there is more after the array")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of large files, a row each; of a file that isn't JSON one row, with its beginning."""
    names = ["source_file", "broken", "value", "doc_index", "doc"]

    def rows(path: str, broken: str | None, at: int, docs: list[str]) -> pa.RecordBatch:
        n = max(1, len(docs))
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([broken is not None] * n), pa.array([broken] * n, pa.string()), pa.array(range(at, at + n), pa.int32()), pa.array(docs or [None], pa.string())], names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, place = fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:", "file://", path))
            try:
                with system.open_input_stream(place) as f:
                    for _ in array_elements(f.read):
                        pass
            except (ValueError, RecursionError):
                with system.open_input_stream(place) as f:
                    yield rows(path, f.read(RAW_CHARS).decode("utf-8", "replace"), 0, [])
                continue
            with system.open_input_stream(place) as f:
                docs, held, at = [], 0, 0
                for element in array_elements(f.read, check=False):
                    docs.append(element.decode("utf-8", "replace"))
                    held += len(element)
                    if held > 4 << 20:
                        yield rows(path, None, at, docs)
                        at, docs, held = at + len(docs), [], 0
                if docs:
                    yield rows(path, None, at, docs)


def split_files(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Documents (source_file, broken, value, doc_index, d) of the files of more than ``least`` bytes, read as streams."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).where(F.col("length") > least).select("path")
    docs = files.mapInArrow(_split, "source_file string, broken boolean, value string, doc_index int, doc string")
    docs = docs.repartition("source_file", "doc_index")  # one task reads a file, all judge its documents
    return docs.select("source_file", "broken", "value", "doc_index", F.explode(F.array(F.expr("try_parse_json(doc)"))).alias("d"))


def read_json_dir(spark: SparkSession, path: str, dim: int, large: int = LARGE_FILE) -> tuple[DataFrame, DataFrame]:
    """(valid documents, rejected ones) of a directory.

    Files of up to ``large`` bytes are parsed whole, in the JVM; larger ones are cut into documents as they are read,
    so that memory is bounded by a document, not by a file. Both judge alike.
    """
    rows = parse_documents(read_files(spark, path, large), dim).unionByName(_checked(split_files(spark, path, large), dim))
    valid = rows.where("reason IS NULL").select("id", "text", "metadata_json", "embedding")
    rejected = rows.where("reason IS NOT NULL").select("source_file", "doc_index", "reason", "raw")
    return valid, rejected
