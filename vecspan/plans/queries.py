"""The registered queries of the store's operators, and the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import embed, evaluate, prep, rag
from ..operators.search import normalized, top_k, top_k_batch
from ..operators.store import VectorStore
from ..shared import shared_place
from ..sources.json_dir import read_json_dir
from ..sources.sinks import write_json_arrays, write_json_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BATCH_IDS = 20
BY_TOPIC = ("erth", "ing", "zzz")


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))) if scaled else e


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector of the single searches: that of vec_id 0."""
    return list(_read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


_D = "CAST(embedding AS DOUBLE[])"
_Q = f"(SELECT {_D} FROM embeddings WHERE vec_id = 0)"
_SCALED = f"SELECT vec_id, list_transform({_D}, lambda x: x * (vec_id + 1)) AS v FROM embeddings"
_UNIT = f"SELECT vec_id, list_transform(v, lambda x: x * (1.0::DOUBLE / sqrt(list_dot_product(v, v)))) AS v FROM ({_SCALED})"
_PLAIN_UNIT = f"SELECT vec_id, list_transform(v, lambda x: x * (1.0::DOUBLE / sqrt(list_dot_product(v, v)))) AS v FROM (SELECT vec_id, {_D} AS v FROM embeddings)"
_UNIT_Q = f"(SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) FROM (SELECT {_D} AS v FROM embeddings WHERE vec_id = 0))"


def _top(vectors: str, query: str, k: int) -> str:
    return f"SELECT vec_id, s FROM (SELECT vec_id, list_dot_product(v, {query}) AS s FROM ({vectors})) ORDER BY s DESC, vec_id LIMIT {k}"


@_query(f"SELECT vec_id, round(sum(x * x), 6) AS norm2, round(sum(x), 6) AS total, round(min(x), 6) AS least, round(max(x), 6) AS most FROM (SELECT vec_id, unnest(v) AS x FROM ({_UNIT})) GROUP BY vec_id")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir, True).withColumn("v", V.normalize(F.col("embedding")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.round(V.squared_length(F.col("v")), 6).alias("norm2"), F.round(total, 6).alias("total"), F.round(F.array_min("v"), 6).alias("least"), F.round(F.array_max("v"), 6).alias("most"))


@_query(f"SELECT vec_id, round(s, 6) AS score FROM ({_top(f'SELECT vec_id, {_D} AS v FROM embeddings', _UNIT_Q, 10)})")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(top_k(_vectors(spark, sf_dir), normalized(_first(spark, sf_dir)), 10, ["vec_id"]))


@_query(f"SELECT vec_id, round(s, 6) AS score FROM ({_top(_UNIT, _UNIT_Q, 10)})")
def vec_topk_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir, True).withColumn("embedding", V.normalize(F.col("embedding")))
    return _rounded(top_k(unit, normalized(_first(spark, sf_dir)), 10, ["vec_id"]))


@_query(f"""SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM (
    SELECT q.vec_id AS qid, e.vec_id, list_dot_product(e.v, q.v) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.v, q.v) DESC, e.vec_id) AS rank
    FROM ({_PLAIN_UNIT}) e, ({_PLAIN_UNIT}) q WHERE q.vec_id % {BATCH_IDS} = 0) WHERE rank <= 5""")
def vec_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).withColumn("embedding", V.normalize(F.col("embedding")))
    asked = unit.where(F.col("vec_id") % BATCH_IDS == 0).withColumnRenamed("vec_id", "qid")
    return _rounded(top_k_batch(unit, asked, 5, key="vec_id"))


@_query(f"SELECT vec_id, round(s, 6) AS score FROM ({_top(_PLAIN_UNIT, f'list_transform({_Q}, lambda x: 2 * x)', 10)})")
def vec_topk_raw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).withColumn("embedding", V.normalize(F.col("embedding")))
    return _rounded(top_k(unit, [2 * x for x in _first(spark, sf_dir)], 10, ["vec_id"]))


@_query(f"SELECT vec_id, round(s, 6) AS score FROM ({_top(_PLAIN_UNIT, _UNIT_Q, 50)}) WHERE s >= 0.2")
def vec_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).withColumn("embedding", V.normalize(F.col("embedding")))
    return _rounded(rag.above_threshold(top_k(unit, normalized(_first(spark, sf_dir)), 50, ["vec_id"]), 0.2))


@_query(f"SELECT vec_id, round(s, 6) AS score FROM ({_top(_PLAIN_UNIT, _UNIT_Q, 100_000_000)})")
def vec_k_gt_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).withColumn("embedding", V.normalize(F.col("embedding")))
    return _rounded(top_k(unit, normalized(_first(spark, sf_dir)), 100_000_000, ["vec_id"]))


@_query(f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 4) AS magnitude FROM ({_SCALED})")
def vec_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, True).select("vec_id", F.round(V.magnitude(F.col("embedding")), 4).alias("magnitude"))


@_query("""SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x))) > 0 AS has_nan, len(list_filter(embedding, lambda x: x <> 0)) = 0 AS all_zero,
    round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS magnitude FROM embeddings""")
def vec_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.embedding_health(_vectors(spark, sf_dir), "vec_id")


@_query(f"""SELECT CAST(count(*) AS BIGINT) AS "documentCount", CAST(max(len(embedding)) AS INTEGER) AS dimensions, true AS "isLoaded" FROM embeddings""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return spark.createDataFrame([tuple(store.stats().values())], "documentCount long, dimensions int, isLoaded boolean")


def _store(spark: SparkSession, sf_dir: str) -> VectorStore:
    e, d = _read(spark, sf_dir, "embeddings"), _read(spark, sf_dir, "documents")
    store = VectorStore(spark, len(_first(spark, sf_dir)))
    rows = e.join(d.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    store.add_documents(rows.select(F.col("vec_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.to_json(F.struct("label")).alias("metadata_json"), "embedding"))
    store.finalize()
    return store


@_query(f"""SELECT round(t.s, 4) AS score, CAST(t.vec_id AS VARCHAR) AS id, coalesce(d.text, '') AS text, '{{"label":' || e.label || '}}' AS metadata_json
    FROM ({_top(_PLAIN_UNIT, _UNIT_Q, 10)}) t JOIN embeddings e ON e.vec_id = t.vec_id LEFT JOIN documents d ON d.doc_id = t.vec_id""")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).search(_first(spark, sf_dir), 10).withColumn("score", F.round("score", 4))


@_query(r"""SELECT doc_id, regexp_replace(substring(text, 1, 500), '^\s+|\s+$', '', 'g') || CASE WHEN length(text) > 500 THEN '...' ELSE '' END AS preview FROM documents""")
def rag_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", rag.preview(F.col("text")).alias("preview"))


_FENCED = "CASE WHEN doc_id % 3 = 0 THEN 'See ```first ' || lang || '``` and ```second``` ' || text ELSE text END"


@_query(rf"""SELECT CAST(doc_id AS VARCHAR) AS id, nullif(regexp_extract(t, '```[\s\S]*?```'), '') AS code, CASE WHEN regexp_matches(t, '```[\s\S]*?```')
    THEN regexp_replace(substring(t, 1, 600), '^\s+|\s+$', '', 'g') || '...' || chr(10) || chr(10) || '**Code Example:**' || chr(10) || regexp_extract(t, '```[\s\S]*?```')
    ELSE regexp_replace(substring(t, 1, 800), '^\s+|\s+$', '', 'g') || '...' END AS content FROM (SELECT doc_id, {_FENCED} AS t FROM documents)""")
def rag_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.expr(_FENCED).alias("text"), F.lit(0.5).alias("score"))
    return rag.with_code(docs).select("id", "code", "content")


@_query(f"""SELECT id, round(s, 6) AS score FROM (SELECT CAST(t.vec_id AS VARCHAR) AS id, s, d.text FROM ({_top(_PLAIN_UNIT, _UNIT_Q, 20)}) t JOIN documents d ON d.doc_id = t.vec_id)
    WHERE contains(lower(text), 'ing') OR contains(lower(text), 'zu') ORDER BY s DESC, id LIMIT 5""")
def rag_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = top_k(_vectors(spark, sf_dir).withColumn("embedding", V.normalize(F.col("embedding"))), normalized(_first(spark, sf_dir)), 20, ["vec_id"])
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = near.join(docs, "vec_id").select(F.col("vec_id").cast("string").alias("id"), "text", "score")
    return _rounded(rows.where(rag.mentions(("ing", "zu"))).orderBy(F.desc("score"), "id").limit(5)).select("id", "score")


@_query(f"""SELECT id, round(s, 6) AS score, exact FROM (SELECT CAST(vec_id AS VARCHAR) AS id, s, contains(CAST(vec_id AS VARCHAR), '7') AS exact FROM ({_top(_PLAIN_UNIT, _UNIT_Q, 10)})) ORDER BY exact DESC, s DESC, id LIMIT 1""")
def rag_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rag.Retrieval(_store(spark, sf_dir), lambda text: _first(spark, sf_dir))
    return _rounded(r.section("7").select("id", "score", "exact"))


@_query("SELECT CAST(row_number() OVER (ORDER BY topic) - 1 AS INTEGER) AS position, topic FROM (VALUES " + ", ".join(f"('{t}')" for t in rag.TOPICS) + ") t(topic)")
def rag_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(rag.TOPICS)], "position int, topic string")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a raw corpus: odd ones have their text as content; files by source. Two rows without any text are added."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    d = d.union(spark.createDataFrame([(-1, None, "en", "none"), (-2, "", "en", "none")], "doc_id long, text string, lang string, source string"))
    body = F.col("text")
    return d.select(
        F.concat(F.lit("/in/"), "source", F.lit(".json")).alias("source_file"),
        F.col("doc_id").alias("position"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("own-"), F.col("doc_id").cast("string"))).alias("id"),
        F.when(F.col("doc_id") % 2 == 0, body).otherwise("").alias("text"),
        F.when(F.col("doc_id") % 2 == 1, body).alias("content"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("title"),
        F.to_json(F.struct(F.struct(F.struct(F.col("source").alias("filename")).alias("origin")).alias("meta"))).alias("meta"),
    )


_BODY = "nullif(text, '')"
_DOCS = "(SELECT doc_id, text, lang, source FROM documents UNION ALL SELECT -1, NULL, 'en', 'none' UNION ALL SELECT -2, '', 'en', 'none')"


@_query(f"""SELECT CASE WHEN doc_id % 4 = 0 THEN 'own-' || doc_id ELSE 'doc_' || source || '_' || doc_id END AS id, substring(w, 1, 1000) AS text, CAST(length(w) AS BIGINT) AS original_length
    FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN lang || chr(10) ELSE '' END || {_BODY} AS w FROM {_DOCS}) WHERE w IS NOT NULL""")
def corpus_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.prepare_corpus(_raw(spark, sf_dir)).drop("to_embed", "meta")


_NUMBERED = "'doc_' || (dense_rank() OVER (ORDER BY '/in/' || source || '.json') - 1) || '_' || doc_id"


@_query(f"SELECT doc_id AS position, {_NUMBERED} AS id FROM {_DOCS}")
def corpus_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.number_documents(_raw(spark, sf_dir)).select("position", "id")


def _length_embed(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: two numbers that SQL can compute."""
    return [[float(len(t)), float(t.count("a"))] for t in texts]


@_query(f"""SELECT CASE WHEN doc_id % 4 = 0 THEN 'own-' || doc_id ELSE 'doc_' || source || '_' || doc_id END AS id, CAST(length(w) AS DOUBLE) AS chars, CAST(length(w) - length(replace(w, 'a', '')) AS DOUBLE) AS letters,
    source AS filename, CAST(length(w) AS BIGINT) AS original_length FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN lang || chr(10) ELSE '' END || {_BODY} AS w FROM {_DOCS}) WHERE w IS NOT NULL""")
def corpus_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embed.embed_corpus(_raw(spark, sf_dir), _length_embed)
    of = lambda path, kind: evaluate.metadata_value(path).cast(kind)
    return e.select("id", of("embedding[0]", "double").alias("chars"), of("embedding[1]", "double").alias("letters"), of("meta.origin.filename", "string").alias("filename"), of("original_length", "long").alias("original_length"))


_META = "metadata.original_meta"


@_query(f"""SELECT doc_id AS position, {_NUMBERED} AS id, CASE WHEN {_BODY} IS NOT NULL THEN 'demo' END AS model, CAST(CASE WHEN {_BODY} IS NOT NULL THEN 2 END AS INTEGER) AS dim, CAST(length({_BODY}) AS DOUBLE) AS chars,
    CASE WHEN {_BODY} IS NOT NULL THEN source END AS filename FROM {_DOCS}""")
def corpus_embed_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embed.embed_numbered(_raw(spark, sf_dir), _length_embed)
    return e.select("position", "id", F.col("metadata.embedding_model").alias("model"), F.col("metadata.embedding_dim").alias("dim"), F.get("metadata.embedding", F.lit(0)).cast("double").alias("chars"), evaluate.metadata_value("meta.origin.filename", _META).alias("filename"))


@_query(f"""SELECT doc_id AS position, CASE WHEN t IS NOT NULL THEN 'doc_' || doc_id WHEN doc_id % 4 = 0 THEN 'own-' || doc_id END AS id, CAST(length(t) AS DOUBLE) AS chars, CASE WHEN t IS NOT NULL THEN source END AS filename
    FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN {_BODY} END AS t FROM {_DOCS})""")
def corpus_embed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embed.embed_file(_raw(spark, sf_dir), _length_embed)
    return e.select("position", "id", F.get("metadata.embedding", F.lit(0)).cast("double").alias("chars"), evaluate.metadata_value("meta.origin.filename", _META).alias("filename"))


@_query(f"""SELECT coalesce(CASE WHEN doc_id % 4 = 0 THEN 'own-' || doc_id END, source || '_' || doc_id) AS id,
    CASE WHEN doc_id % 5 = 0 THEN -1.0::DOUBLE WHEN doc_id % 2 = 0 AND trim(coalesce({_BODY}, '')) <> '' THEN length(text)::DOUBLE END AS chars FROM {_DOCS}""")
def corpus_embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir).withColumn("embedding", F.when(F.col("position") % 5 == 0, F.array(F.lit(-1.0), F.lit(-1.0)).cast("array<float>")))
    return embed.embed_missing(rows, _length_embed).select("id", F.get("embedding", F.lit(0)).cast("double").alias("chars"))


@_query("SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS BIGINT) AS chunk, doc_id FROM documents")
def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.chunk_documents(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("chunk", "doc_id")


@_query(f"""SELECT label, round(avg(s), 6) AS mean_score, round(avg(CASE WHEN s >= 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS relevance_rate, count(*) AS n
    FROM (SELECT label, list_dot_product({_D}, {_UNIT_Q}) AS s FROM embeddings) GROUP BY label""")
def eval_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _read(spark, sf_dir, "embeddings").select("label", V.dot(F.col("embedding"), V.vector_literal(normalized(_first(spark, sf_dir)))).alias("score"))
    return evaluate.category_report(scored, "label", 0.2).withColumn("mean_score", F.round("mean_score", 6)).withColumn("relevance_rate", F.round("relevance_rate", 6))


_MATCHES = " + ".join(f"CAST(contains(lower(text), '{t}') OR contains(lower(lang), '{t}') AS INTEGER)" for t in BY_TOPIC)


@_query(f"SELECT source, round(sum(score * m) / 5, 6) AS relevance FROM (SELECT source, {_MATCHES} AS m, 1.0::DOUBLE / (1 + rank) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)) WHERE rank <= 5 GROUP BY source")
def eval_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _read(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).withColumn("score", 1.0 / (1 + F.col("rank")))
    return evaluate.weighted_relevance(ranked, "source", evaluate.topic_matches(BY_TOPIC, "text", "lang")).withColumn("relevance", F.round("relevance", 6))


@_query("""SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, list_sort(list(value))[count(value) // 2 + 1] AS median, round(stddev_pop(value), 6) AS stddev,
    round(count(value) * 1000.0::DOUBLE / sum(value), 6) AS rate FROM events GROUP BY event_type""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    rates = events.groupBy("event_type").agg(F.round(evaluate.throughput(F.count("value"), F.sum("value")), 6).alias("rate"))
    summary = evaluate.timing_summary(events, "event_type", "value").withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))
    return summary.join(rates, "event_type")


@_query(f"SELECT doc_id AS position, source AS filename FROM {_DOCS}")
def metadata_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("position", evaluate.metadata_value("meta.origin.filename", "meta").alias("filename"))


_NEXT = "CAST(CAST(h AS DOUBLE) * 1103515245.0::DOUBLE + 12345.0::DOUBLE AS BIGINT) & 2147483647"
_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"
_LAST = f"list_reduce(list_prepend(h, list_transform(range(0, {embed.DEMO_DIM}), lambda x: x::BIGINT)), lambda h, k: {_NEXT})"


@_query(f"""SELECT item_id, CAST({embed.DEMO_DIM} AS INTEGER) AS dim, round(({_NEXT})::DOUBLE / 2147483647 * 2 - 1, 6) AS first, round(({_LAST})::DOUBLE / 2147483647 * 2 - 1, 6) AS last
    FROM (SELECT item_id, CASE WHEN text = '' THEN 0 ELSE {_HASH} END AS h FROM benchmark)""")
def demo_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark")
    e = embed.embed_column(items, "text", embed.with_fallback(None)).select("item_id", "embedding")
    number = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double"), 6)
    return e.select("item_id", F.size("embedding").alias("dim"), number(0).alias("first"), number(embed.DEMO_DIM - 1).alias("last"))


def _write_arrays(docs: DataFrame, place: str, file_docs: int = 500) -> None:
    """Write ``docs``, one JSON document a row, as files that hold an array each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(place)
        system.create_dir(root, recursive=True)
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, file_docs):
                with system.open_output_stream(f"{root}/table-{task}-{at}.json") as f:
                    f.write(("[" + ",\n".join(batch.column(0).slice(start, file_docs).to_pylist()) + "]").encode())
                at += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([at], pa.int64())})

    docs.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _directory(spark: SparkSession, sf_dir: str) -> str:
    """A directory with the whole table of vectors, in files of an array each, and some single, broken and mistyped documents."""
    place = shared_place(spark, "ingest")
    vectors = _vectors(spark, sf_dir)
    metadata = F.struct("embedding", F.struct(F.lit(1).alias("n")).alias("k")).alias("metadata")
    name = F.col("vec_id").cast("string")
    _write_arrays(vectors.select(F.to_json(F.struct(name.alias("id"), F.concat(F.lit("text "), name).alias("text"), metadata))), place)
    vector = _first(spark, sf_dir)
    dim = len(vector)
    doc = lambda i, e: {"id": i, "text": f"text {i}", "metadata": {"embedding": e, "k": {"n": 1}}}
    extra = {
        "many.json": json.dumps([{**doc("0", vector), "id": 7}, "junk", doc("short", [1.0]), doc("typed", ["1"] * dim), {**doc("0", vector), "text": None}, {"id": "x", "text": "y", "metadata": []}]),
        "one.json": "  " + json.dumps(dict(reversed(doc("0", vector).items()))),
        "broken.json": '[{"id": "x", ',
        "OTHER.JSON": json.dumps([doc("0", vector)]),
        "long.json": json.dumps([{"id": "long", "text": "x" * 200_000 + '"[]{}', "metadata": {"embedding": vector}}, "junk", 5]),
        "long_broken.json": "[" + json.dumps({"id": "long", "text": "x" * 200_000}) + ", {]",
    }
    system, root = fs.FileSystem.from_uri(place)
    system.create_dir(root, recursive=True)
    for file, text in extra.items():
        with system.open_output_stream(f"{root}/{file}") as f:
            f.write(text.encode())
    return place


_REJECTED = ["bad_id", "not_object", "wrong_dim", "bad_embedding", "bad_text", "bad_metadata", "parse_error", "not_object", "not_object", "parse_error"]
_NOTHING = "NULL::VARCHAR AS id, NULL::BIGINT AS chars, NULL::BIGINT AS n, NULL::DOUBLE AS total"


@_query(f"""SELECT CAST(vec_id AS VARCHAR) AS id, CAST(length('text ' || vec_id) AS BIGINT) AS chars, 1::BIGINT AS n, round(list_sum({_D}), 4) AS total, NULL::VARCHAR AS reason FROM embeddings
    UNION ALL SELECT '0', 6, 1, round(list_sum({_Q}), 4), NULL UNION ALL SELECT 'long', 200005, NULL, round(list_sum({_Q}), 4), NULL
    UNION ALL SELECT {_NOTHING}, reason FROM (VALUES {", ".join(f"('{r}')" for r in _REJECTED)}) t(reason)""")
def ingest_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a directory, and why the rest isn't; files above 100,000 bytes are cut as they are read."""
    valid, rejected = read_json_dir(spark, _directory(spark, sf_dir), len(_first(spark, sf_dir)), 100_000)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    kept = valid.select("id", F.char_length("text").cast("long").alias("chars"), evaluate.metadata_value("k.n").cast("long").alias("n"), total.alias("total"), F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(t) for t in ("string", "long", "long", "double")]
    return kept.union(rejected.select(*none, "reason"))


_LOADED = "(SELECT count(*) + 2 FROM embeddings)"


@_query(" UNION ALL ".join(f"SELECT '{m}' AS method, true AS success, {_LOADED} AS documents, 1.0::DOUBLE AS best" for m in ("load_dir", "load_dir_mmap", "load_dir_adaptive", "load_timed")))
def store_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaders, each on the same directory; ``best`` is the score of the first vector's own document."""
    place, first = _directory(spark, sf_dir), _first(spark, sf_dir)
    rows = []
    for method in ("load_dir", "load_dir_mmap", "load_dir_adaptive", "load_timed"):
        store = VectorStore(spark, len(first))
        said = getattr(store, method)(place) or {}
        best = store.search(first, 1).first()
        rows.append((method, store.is_finalized and said.get("success", True), store.size(), round(best.score, 4)))
        store.unpersist()
    return spark.createDataFrame(rows, "method string, success boolean, documents long, best double")


_FEW = [("a", [3.0, 4.0, 0.0]), ("b", [0.0, 2.0, 0.0]), ("c", [1.0, 1.0, 1.0]), ("a", [0.0, 0.0, -5.0])]
_FEW_SQL = "(VALUES " + ", ".join(f"('{i}', 'text of {i}', {v}::DOUBLE[])" for i, v in _FEW) + ") t(id, text, v)"


@_query(f"""SELECT id, text, round(list_dot_product(v, [3.0, 4.0, 0.0]::DOUBLE[]) / sqrt(list_dot_product(v, v)) / 5, 6) AS score FROM {_FEW_SQL} ORDER BY score DESC, id, text LIMIT 3""")
def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added one by one, then normalized and searched; ids repeat."""
    store = VectorStore(spark, 3)
    for i, v in _FEW:
        store.add_document({"id": i, "text": f"text of {i}", "metadata": {"embedding": v}})
    store.normalize()
    return _rounded(store.search([3.0, 4.0, 0.0], 3)).select("id", "text", "score")


def _loading(spark: SparkSession, sf_dir: str, most: int | None = None) -> VectorStore:
    """A store with the whole table, not finalized."""
    store = VectorStore(spark, len(_first(spark, sf_dir)), most)
    store.add_documents(_vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), F.lit("t").alias("text"), F.lit("{}").alias("metadata_json"), "embedding"))
    return store


def _error(call: Callable[[], object]) -> str | None:
    try:
        call()
    except Exception as e:
        return type(e).__name__
    return None


@_query("""SELECT step, finalized, CAST(n AS BIGINT) AS documents, CAST(found AS BIGINT) AS found, error FROM (SELECT count(*) AS n, least(count(*), 7) AS k FROM embeddings), LATERAL (VALUES
    ('loading', false, 0, NULL), ('one short', false, 0, 'StoreError'), ('finalized', true, k, NULL), ('again', true, k, NULL), ('added', true, k, 'StoreFinalizedError')) t(step, finalized, found, error)""")
def store_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, finalize, serve: what each phase lets through."""
    store, first = _loading(spark, sf_dir), _first(spark, sf_dir)
    state = lambda step, error=None: (step, store.is_finalized, store.size(), store.search(first, 7).count(), error)
    rows = [state("loading"), state("one short", _error(lambda: store.add_document({"id": "x", "text": "y", "metadata": {"embedding": first[1:]}})))]
    store.finalize()
    rows.append(state("finalized"))
    store.normalize()
    rows += [state("again"), state("added", _error(lambda: store.add_document({"id": "x", "text": "y", "metadata": {"embedding": first}})))]
    store.unpersist()
    return spark.createDataFrame(rows, "step string, finalized boolean, documents long, found long, error string")


@_query("""SELECT allowed, CASE WHEN allowed < n THEN 'StoreError' END AS error, CASE WHEN allowed < n THEN false ELSE true END AS finalized FROM (SELECT count(*) AS n FROM embeddings), LATERAL (VALUES (n - 1), (n), (n + 1)) t(allowed)""")
def store_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More documents than allowed are an error; nothing is dropped."""
    n = _vectors(spark, sf_dir).count()
    rows = []
    for most in (n - 1, n, n + 1):
        store = _loading(spark, sf_dir, most)
        rows.append((most, _error(store.finalize), store.is_finalized))
        store.unpersist()
    return spark.createDataFrame(rows, "allowed long, error string, finalized boolean")


@_query(f"""SELECT CAST(e.vec_id AS VARCHAR) AS id, coalesce(d.text, '') AS text, round(list_dot_product(v, v), 4) AS norm2 FROM ({_PLAIN_UNIT}) e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id = 7""")
def store_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _store(spark, sf_dir).get_entry("7")
    return found.select("id", "text", F.round(V.squared_length(F.col("embedding")), 4).alias("norm2"))


@_query(f"""WITH n AS (SELECT count(*) AS n, max(len(embedding)) AS dim FROM embeddings)
    SELECT request, answer FROM n, (SELECT count(*) AS hits FROM ({_top(_PLAIN_UNIT, _UNIT_Q, 9)}) WHERE s >= 0.2), LATERAL (VALUES ('vector_search', 'count ' || hits), ('wrong_dim', 'error'), ('get_stats', n || ' of ' || dim || ' true'), ('add_late', 'error'),
    ('add_empty', 'error'), ('unknown', 'unknown method: nothing'), ('cpp://status', 'Documents loaded: ' || n), ('cpp://stats', CAST(n AS VARCHAR)), ('cpp://none', 'StoreError'), ('unloaded', 'error'), ('added', 'true new'), ('load_again', 'true ' || n)) t(request, answer)""")
def rag_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a store that serves the whole table, and to one that is empty."""
    first = _first(spark, sf_dir)
    store = _store(spark, sf_dir)
    r, empty = rag.Retrieval(store, lambda text: first), rag.Retrieval(VectorStore(spark, 3), lambda text: first)
    new = {"id": "new", "text": "t", "metadata": {"embedding": [1.0, 2.0, 3.0]}}
    stats = r.handle("get_stats")
    added = empty.handle("add_document", {"document": new})
    loaded = r.handle("load_documents", {"path": "/nowhere"})
    failed = lambda a: "error" if set(a) == {"error"} else str(a)
    rows = [
        ("vector_search", f"count {r.handle('vector_search', {'embedding': first, 'k': 9, 'threshold': 0.2})['count']}"),
        ("wrong_dim", failed(r.handle("vector_search", {"embedding": first[1:]}))),
        ("get_stats", f"{stats['documentCount']} of {stats['dimensions']} {str(stats['isLoaded']).lower()}"),
        ("add_late", failed(r.handle("add_document", {"document": {**new, "metadata": {"embedding": first}}}))),
        ("add_empty", failed(empty.handle("add_document", {"document": {**new, "text": ""}}))),
        ("unknown", r.handle("nothing")["error"]),
        ("cpp://status", r.resource("cpp://status")),
        ("cpp://stats", str(json.loads(r.resource("cpp://stats"))["documentCount"])),
        ("cpp://none", _error(lambda: r.resource("cpp://none"))),
        ("unloaded", failed(empty.handle("vector_search", {"embedding": [1.0, 0.0, 0.0]}))),
        ("added", f"{str(added['success']).lower()} {added['id']}"),
        ("load_again", f"{str(loaded['success']).lower()} {loaded['documentCount']}"),
    ]
    return spark.createDataFrame(rows, "request string, answer string")


@_query(f"""SELECT CAST(vec_id AS VARCHAR) AS id, printf('%.4f', round(s, 10)) AS score_text, regexp_replace(substring(coalesce(text, ''), 1, 500), '^\\s+|\\s+$', '', 'g') || CASE WHEN length(text) > 500 THEN '...' ELSE '' END AS preview
    FROM ({_top(_PLAIN_UNIT, _UNIT_Q, 20)}) t LEFT JOIN documents d ON d.doc_id = t.vec_id""")
def rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a hundred wanted results twenty come."""
    return rag.Retrieval(_store(spark, sf_dir), lambda text: _first(spark, sf_dir)).search("anything", 100)


_WORDS = " OR ".join(f"contains(lower(id), '{w}') OR contains(lower(text), '{w}')" for w in sorted(rag.CATEGORY_KEYWORDS["io"]))


@_query(f"""SELECT id, round(s, 6) AS score FROM (SELECT CAST(t.vec_id AS VARCHAR) AS id, s, coalesce(d.text, '') AS text FROM ({_top(_PLAIN_UNIT, _UNIT_Q, 40)}) t LEFT JOIN documents d ON d.doc_id = t.vec_id) WHERE {_WORDS} ORDER BY s DESC, id LIMIT 20""")
def rag_category_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rag.Retrieval(_store(spark, sf_dir), lambda text: _first(spark, sf_dir)).search_category("io", "how", 20).select("id", "score"))


@_query("""SELECT 'docs_' || CASE WHEN c < 10000 THEN lpad(CAST(c AS VARCHAR), 4, '0') ELSE CAST(c AS VARCHAR) END || '.json' AS name, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last
    FROM (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS BIGINT) AS c FROM documents) GROUP BY c""")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in JSON files of a hundred each, read back from the files."""
    place = shared_place(spark, "chunks")
    write_json_arrays(_read(spark, sf_dir, "documents"), place, "doc_id", 100, "docs")
    files = spark.read.format("text").option("wholetext", True).load(place).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.from_json("value", "array<struct<doc_id: long, text: string>>").alias("docs"))
    ids = F.transform("docs", lambda d: d["doc_id"])
    return files.select("name", F.size("docs").cast("long").alias("n"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"))


@_query("SELECT doc_id, source, CAST(length(text) AS BIGINT) AS chars FROM documents")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON lines, read back."""
    place = shared_place(spark, "lines")
    docs = _read(spark, sf_dir, "documents")
    write_json_lines(docs, place)
    return spark.read.schema(docs.schema).json(place).select("doc_id", "source", F.char_length("text").cast("long").alias("chars"))


@_query("SELECT vec_id, 1.0::DOUBLE AS magnitude, CAST(32 AS INTEGER) AS dim, true AS same FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random vectors of length 1 that depend on row key and seed alone, whatever the partitions."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id")
    one = evaluate.random_unit_vectors(rows, 32, 3, "vec_id")
    other = evaluate.random_unit_vectors(rows.repartition(3), 32, 3, "vec_id").select("vec_id", F.col("embedding").alias("other"))
    return one.join(other, "vec_id").select("vec_id", F.round(V.magnitude(F.col("embedding")), 4).alias("magnitude"), F.size("embedding").alias("dim"), (F.col("embedding") == F.col("other")).alias("same"))
