"""Embed texts and corpora with a function of choice."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEMO_DIM = 1536
BATCH = 20  #: texts of one call of the function
Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def demo_embedding(text: str, dim: int = DEMO_DIM) -> list[float]:
    """Numbers in [-1, 1] that only depend on the text: a 32-bit string hash over UTF-16 units seeds a congruential
    generator, whose products are rounded to doubles before the low 31 bits are taken."""
    h = 0
    units = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[k : k + 2], "little") + 2**31) % 2**32 - 2**31
    out = []
    for _ in range(dim):
        h = int(float(h) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        out.append(h / 0x7FFFFFFF * 2 - 1)
    return out


def demo_embed(texts: list[str]) -> list[list[float]]:
    return [demo_embedding(t) for t in texts]


def with_fallback(embed: Embed | None, fallback: Embed = demo_embed) -> Embed:
    """``embed``, or ``fallback`` where it is missing or fails."""

    def run(texts: list[str]) -> Sequence[Sequence[float]]:
        if embed is None:
            return fallback(texts)
        try:
            return embed(texts)
        except Exception:
            return fallback(texts)

    return run


def embed_column(df: DataFrame, text: str, embed: Embed = demo_embed, out: str = "embedding", batch: int = BATCH, retries: int = 2, wait: float = 0.0) -> DataFrame:
    """Add ``out``: the embedding of column ``text``, null where the text is null or the function keeps failing on its batch.

    The function gets ``batch`` texts at a time, in the tasks that hold them; a failed call is tried again after ``wait`` seconds, and twice as
    many each further time (a limited service needs a minute or so).
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(names.index(text)).to_pylist()
            vectors: list = [None] * len(texts)
            wanted = [k for k, t in enumerate(texts) if t is not None]
            for at in range(0, len(wanted), batch):
                some = wanted[at : at + batch]
                for attempt in range(retries + 1):
                    try:
                        for k, v in zip(some, embed([texts[k] for k in some])):
                            vectors[k] = [float(x) for x in v]
                        break
                    except Exception:
                        if attempt == retries:
                            break
                        time.sleep(wait * 2**attempt)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<float>")


def _first_text(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def prepare_corpus(raw: DataFrame, text_limit: int = 1000) -> DataFrame:
    """What embedding a raw corpus (source_file, position, id, text, content, title, meta as JSON if it has it) works on, before any vector.

    ``to_embed`` is the text, or else the content, with the title on a line before it; rows with neither go. The id is
    the row's own or doc_<base name>_<position>; the stored text is cut to ``text_limit`` characters and ``original_length`` says what it was.
    """
    body = _first_text("text", "content")
    base = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.json$", "")
    whole = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), body)
    return raw.where(body.isNotNull()).select(
        F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat_ws("_", F.lit("doc"), base, F.col("position").cast("string"))).alias("id"),
        F.substring(whole, 1, text_limit).alias("text"),
        whole.alias("to_embed"),
        F.char_length(whole).cast("long").alias("original_length"),
        *(["meta"] if "meta" in raw.columns else []),
    )


def embed_corpus(raw: DataFrame, embed: Embed = demo_embed) -> DataFrame:
    """(id, text, embedding, original_length, metadata_json) of a raw corpus; what can't be embedded goes.

    The metadata are one JSON object: embedding, then the members of ``meta`` if that is an object, then original_length.
    """
    rows = embed_column(prepare_corpus(raw), "to_embed", embed).where("embedding IS NOT NULL").drop("to_embed")
    meta = F.col("meta") if "meta" in raw.columns else F.lit(None).cast("string")
    members = F.regexp_extract(F.trim(meta), r"(?s)^\{\s*(.*\S)\s*\}$", 1)
    whole = F.concat(F.lit('{"embedding":'), F.to_json("embedding"), F.lit(","), F.when(F.coalesce(members, F.lit("")) != "", F.concat(members, F.lit(","))).otherwise(""), F.lit('"original_length":'), F.col("original_length"), F.lit("}"))
    return rows.withColumn("metadata_json", whole).drop("meta")


def number_documents(raw: DataFrame) -> DataFrame:
    """Ids doc_<file number>_<position>, with files numbered from 0 in the order of their names.

    Only the distinct file names are put in one order; rows get their number by a join.
    """
    files = raw.select("source_file").distinct().withColumn("file_index", F.row_number().over(Window.orderBy("source_file")) - 1)
    numbered = raw.drop("id").join(files, "source_file")
    return numbered.withColumn("id", F.concat_ws("_", F.lit("doc"), F.col("file_index").cast("string"), F.col("position").cast("string")))


def embed_numbered(raw: DataFrame, embed: Embed = demo_embed, model: str = "demo") -> DataFrame:
    """The raw corpus with ids by number and metadata (embedding, embedding_model, embedding_dim, original_meta as JSON).

    Rows without a text or content stay, with null metadata.
    """
    rows = embed_column(number_documents(raw).withColumn("_body", _first_text("text", "content")), "_body", embed)
    metadata = F.struct("embedding", F.lit(model).alias("embedding_model"), F.size("embedding").alias("embedding_dim"), F.col("meta").alias("original_meta"))
    return rows.withColumn("metadata", F.when(F.col("embedding").isNotNull(), metadata)).drop("_body", "embedding")


def embed_file(raw: DataFrame, embed: Embed = demo_embed, model: str = "demo") -> DataFrame:
    """A raw corpus of one file, each document with a text under the id doc_<position> and with metadata as in ``embed_numbered``.

    Documents without a text, or whose embedding fails, stay as they are, with null metadata. Content is no text here.
    """
    rows = embed_column(raw.withColumn("_body", F.nullif("text", F.lit(""))), "_body", embed, batch=1)
    done = F.col("embedding").isNotNull()
    metadata = F.struct("embedding", F.lit(model).alias("embedding_model"), F.size("embedding").alias("embedding_dim"), F.col("meta").alias("original_meta"))
    named = F.when(done, F.concat(F.lit("doc_"), F.col("position").cast("string"))).otherwise(F.col("id"))
    return rows.withColumn("id", named).withColumn("metadata", F.when(done, metadata)).drop("_body", "embedding")


def embed_missing(docs: DataFrame, embed: Embed = demo_embed) -> DataFrame:
    """Embed the rows (source_file, position, id, text, content, embedding) that have none and whose text isn't blank; the rest stays as it is."""
    body = F.coalesce("text", "content")
    base = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.json$", "")
    ided = docs.withColumn("id", F.coalesce("id", F.concat_ws("_", base, F.col("position").cast("string"))))
    wanted = F.col("embedding").isNull() & (F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s", " ")) != "")
    new = embed_column(ided.where(wanted).drop("embedding").withColumn("_body", body), "_body", embed).drop("_body")
    return ided.where(~wanted).unionByName(new)
