"""Exact top-k search by dot product."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.vectors import NORM_FLOOR, dot, vector_literal
from ..schema import StoreError
from .prep import number_rows

LARGE_K = 100_000  #: rows that one task may merge
CELLS = 4_000_000  #: scores that a task holds at once, about
QUERY_BYTES = 32 << 20  #: queries that one pass over the corpus serves, in bytes; bounds what goes to executors


def check_query(query: Sequence[float], dim: int, k: int) -> list[float]:
    values = [float(x) for x in query]
    if len(values) != dim:
        raise StoreError(f"the query has {len(values)} numbers; the store has {dim}")
    if k < 0:
        raise StoreError("k must not be negative")
    if not all(math.isfinite(x) for x in values):
        raise StoreError("the query must be finite")
    return values


def normalized(query: Sequence[float]) -> list[float]:
    """The query over its length, unless its squared length is at most NORM_FLOOR."""
    s = sum(x * x for x in query)
    return [x / math.sqrt(s) for x in query] if s > NORM_FLOOR else list(query)


def top_k(docs: DataFrame, query: Sequence[float], k: int, ties: Sequence[str] = ("id", "text"), vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``docs`` with the largest dot product, as ``score`` and all other columns.

    Each partition keeps its own best k and only these are merged (TakeOrderedAndProject): no shuffle, whatever
    the size of ``docs``. For k above LARGE_K rows are sorted in ranges and numbered instead. Ties go by ``ties``, ascending.
    """
    scored = docs.withColumn("score", dot(F.col(vector), vector_literal(query)))
    rest = [c for c in docs.columns if c != vector]
    ranked = scored.select("score", *rest)
    if k > LARGE_K:
        return number_rows(ranked, F.desc("score"), *ties).where(F.col("position") < k).drop("position").orderBy(F.desc("score"), *ties)
    return ranked.orderBy(F.desc("score"), *ties).limit(k)


def top_k_batch(docs: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", query_key: str = "qid", query_vector: str = "embedding") -> DataFrame:
    """(qid, rank, key, score): for each query the ``k`` rows with the largest dot product, ties by key.

    Queries go to the executors in blocks of QUERY_BYTES at most. A partition scores its vectors against a block by
    one matrix product for each batch and returns its best k of each query, so that what is shuffled grows with partitions and queries, not with rows.
    Vectors of the queries are used as they are; keys should be unique. Rows without a vector, or with one of another length than
    the query's, aren't candidates; queries without a vector have no results.
    """
    if k <= 0:
        return docs.sparkSession.createDataFrame([], f"{query_key} {dict(queries.dtypes)[query_key]}, rank int, {key} {dict(docs.dtypes)[key]}, score double")
    kind, query_kind = dict(docs.dtypes)[key], dict(queries.dtypes)[query_key]
    parts: list[DataFrame] = []
    ids: list = []
    vectors: list[np.ndarray] = []
    held = 0

    def block() -> list[DataFrame]:
        by = {}
        for i, v in zip(ids, vectors):
            by.setdefault(len(v), ([], []))[0].append(i)
            by[len(v)][1].append(v)
        return [_best(docs, i, np.stack(v), k, key, vector, query_key, kind, query_kind) for i, v in by.values()]

    for row in queries.select(query_key, query_vector).toLocalIterator():
        if row[1] is None:
            continue
        ids.append(row[0])
        vectors.append(np.asarray(row[1], float))
        held += vectors[-1].nbytes
        if held >= QUERY_BYTES:
            parts += block()
            ids, vectors, held = [], [], 0
    parts += block()
    if not parts:
        return docs.sparkSession.createDataFrame([], f"{query_key} {query_kind}, rank int, {key} {kind}, score double")
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, "rank", key, "score")


def _best(docs: DataFrame, ids: list, matrix: np.ndarray, k: int, key: str, vector: str, query_key: str, kind: str, query_kind: str) -> DataFrame:
    dim = matrix.shape[1]
    id_type = to_arrow_type(StructType.fromDDL(f"q {query_kind}")[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        floor = np.full(len(ids), -np.inf)  # a score that k rows of the query have reached
        held: list[pa.Table] = []

        def merge() -> pa.Table:
            """The best k of each query, in the order of query, score and key."""
            both = pa.concat_tables([*([best] if best is not None else []), *held])
            both = both.sort_by([("q", "ascending"), ("score", "descending"), ("key", "ascending")])
            q = both.column("q").to_numpy()
            at = np.flatnonzero(np.concatenate([np.ones(1, bool), q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(at, np.diff(np.append(at, len(q))))
            full = rank == k - 1
            floor[q[full]] = both.column("score").to_numpy()[full]
            return both.filter(pa.array(rank < k))

        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            step = max(1, CELLS // len(ids))
            for at in range(0, batch.num_rows, step):
                scores = matrix @ rows[at : at + step].T
                low = floor
                if scores.shape[1] > k:
                    low = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
                q, row = np.nonzero(scores >= low[:, None])
                held.append(pa.table({"q": q, "key": batch.column(0).take(pa.array(row + at)), "score": scores[q, row]}))
                if sum(t.num_rows for t in held) > max(k * len(ids), 200_000):
                    best, held = merge(), []
        if held:
            best = merge()
        if best is not None and best.num_rows:
            names = pa.array(ids, id_type).take(best.column("q").combine_chunks())
            for out in pa.table({query_key: names, key: best.column("key"), "score": best.column("score")}).to_batches(100_000):
                yield out

    fit = docs.where(F.col(vector).isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()))
    return fit.select(key, vector).mapInArrow(run, f"{query_key} {query_kind}, {key} {kind}, score double")
