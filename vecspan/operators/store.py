"""The vector store: load documents, finalize once, then search."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize, normalized_rows
from ..schema import DOCUMENT, REJECTED, RESULT, StoreError, StoreFinalizedError
from ..sources.json_dir import read_json_dir
from .search import check_query, normalized, top_k, top_k_batch


class VectorStore:
    """Documents (id, text, metadata_json, embedding of ``dim`` floats) in one DataFrame.

    Loading comes first: documents are added one by one or from directories; ``load_dir`` finalizes. Finalizing
    normalizes every embedding and persists the table; then it can be searched, and adding is an error. Searches
    before that are empty. Ids needn't be unique. Rejected documents are in ``rejected``, with reasons.
    """

    def __init__(self, spark: SparkSession, dim: int, max_docs: int | None = None) -> None:
        if dim < 1:
            raise StoreError("dim must be positive")
        self.spark, self.dim, self.max_docs = spark, dim, max_docs
        self._buffer: list[tuple[str, str, str, list[float]]] = []
        self._tables: list[DataFrame] = []
        self._served: DataFrame | None = None
        self._count = 0
        self.rejected = spark.createDataFrame([], REJECTED)

    # loading

    def add_document(self, doc: dict) -> None:
        """Add one document; raises StoreError with the reason if it isn't valid."""
        self._must_load()
        self._buffer.append(self._checked(doc))
        if self.max_docs is not None and len(self._buffer) > self.max_docs:
            self._buffer.pop()
            raise StoreError("capacity")

    def add_documents(self, docs: DataFrame | Iterable[dict]) -> None:
        """Add many: dicts as in ``add_document``, or rows (id, text, metadata_json, embedding), of which invalid ones are rejected."""
        self._must_load()
        if not isinstance(docs, DataFrame):
            for d in docs:
                self.add_document(d)
            return
        good = F.col("id").isNotNull() & F.col("text").isNotNull() & (F.size("embedding") == self.dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        flagged = docs.withColumn("_good", F.coalesce(good, F.lit(False)))
        self._tables.append(flagged.where("_good").select("id", "text", F.coalesce("metadata_json", F.lit("{}")).alias("metadata_json"), F.col("embedding").cast("array<float>").alias("embedding")))
        bad = flagged.where("NOT _good").select(F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("int").alias("doc_index"), F.lit("bad_row").alias("reason"), F.to_json(F.struct("id", "text")).alias("raw"))
        self.rejected = self.rejected.unionByName(bad)

    def load_dir(self, path: str) -> None:
        """Add the documents of a directory's JSON files and finalize; nothing happens if the store is finalized."""
        if self.is_finalized:
            return
        valid, rejected = read_json_dir(self.spark, path, self.dim)
        self._tables.append(valid)
        self.rejected = self.rejected.unionByName(rejected)
        self.finalize()

    #: Reading strategies are the engine's choice here; these names exist for callers that used them.
    load_dir_mmap = load_dir
    load_dir_adaptive = load_dir

    def load_timed(self, path: str) -> dict:
        """``load_dir`` with its time: success, documentCount and loadTimeMs, or success and error."""
        began = time.monotonic()
        try:
            self.load_dir(path)
            return {"success": True, "documentCount": self.size(), "loadTimeMs": round((time.monotonic() - began) * 1000, 3)}
        except Exception as e:
            return {"success": False, "error": str(e)}

    def finalize(self) -> None:
        """Normalize all embeddings and serve; a second call does nothing. More documents than ``max_docs`` are an error, and none is dropped."""
        if self.is_finalized:
            return
        table = self.spark.createDataFrame(self._buffer, DOCUMENT)
        for t in self._tables:
            table = table.unionByName(t)
        served = normalized_rows(table, self.dim)
        served = served.persist(StorageLevel.MEMORY_AND_DISK)
        count = served.count()
        if self.max_docs is not None and count > self.max_docs:
            served.unpersist()
            raise StoreError(f"capacity: {count} documents, {self.max_docs} allowed")
        self._served, self._count = served, count
        self._buffer, self._tables = [], []

    normalize = finalize

    def _must_load(self) -> None:
        if self.is_finalized:
            raise StoreFinalizedError("Document add error: the store is finalized")

    def _checked(self, doc: dict) -> tuple[str, str, str, list[float]]:
        if not isinstance(doc, dict):
            raise StoreError("Document add error: not_object")
        metadata = doc.get("metadata")
        for reason, ok in (("bad_id", isinstance(doc.get("id"), str)), ("bad_text", isinstance(doc.get("text"), str)), ("bad_metadata", isinstance(metadata, dict))):
            if not ok:
                raise StoreError(f"Document add error: {reason}")
        vector = metadata.get("embedding")
        vector = vector.tolist() if hasattr(vector, "tolist") else vector
        if not isinstance(vector, (list, tuple)) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in vector):
            raise StoreError("Document add error: bad_embedding")
        if len(vector) != self.dim:
            raise StoreError("Document add error: wrong_dim")
        if not all(math.isfinite(x) and abs(x) <= 3.4028234663852886e38 for x in vector):
            raise StoreError("Document add error: non_finite")
        return doc["id"], doc["text"], json.dumps({**metadata, "embedding": list(vector)}, ensure_ascii=False), [float(x) for x in vector]

    # serving

    @property
    def is_finalized(self) -> bool:
        return self._served is not None

    @property
    def documents(self) -> DataFrame:
        """The served table, with normalized embeddings."""
        if self._served is None:
            raise StoreError("the store isn't finalized")
        return self._served

    def size(self) -> int:
        """Documents that the store accepted so far."""
        return self._count if self.is_finalized else len(self._buffer) + sum(t.count() for t in self._tables)

    def search(self, query: Sequence[float], k: int, normalize_query: bool = True) -> DataFrame:
        """(score, id, text, metadata_json) of the ``k`` nearest documents, best first; ties by id, then text.

        The score is the cosine, or the query's length times it with ``normalize_query`` False. Before ``finalize`` and
        for k = 0 the result is empty; for k above the size it has all documents.
        """
        values = check_query(query, self.dim, k)
        if self._served is None or k == 0:
            return self.spark.createDataFrame([], RESULT)
        return top_k(self._served, normalized(values) if normalize_query else values, k).select("score", "id", "text", "metadata_json")

    def search_batch(self, queries: DataFrame, k: int, normalize_query: bool = True) -> DataFrame:
        """(qid, rank, id, score) of the ``k`` nearest documents of each row (qid, embedding) of ``queries``."""
        q = queries.withColumn("embedding", normalize(F.col("embedding"))) if normalize_query else queries
        return top_k_batch(self.documents, q, k)

    def get_entry(self, doc_id: str) -> DataFrame:
        """The documents with an id, all columns."""
        return self.documents.where(F.col("id") == doc_id)

    def stats(self) -> dict:
        return {"documentCount": self.size(), "dimensions": self.dim, "isLoaded": self.is_finalized}

    def unpersist(self) -> None:
        if self._served is not None:
            self._served.unpersist()

