"""Retrieval operators on search results: thresholds, previews, code blocks, categories, sections, requests."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import StoreError
from .store import VectorStore

MAX_RESULTS = 20
MAX_FETCHED = 40
SECTION_FETCHED = 10

#: Words that place a document in a category; any of them in its id or text will do.
CATEGORY_KEYWORDS: dict[str, frozenset[str]] = {
    name: frozenset(words.split())
    for name, words in {
        "algorithms": "algorithm find reduce search sort transform",
        "concepts": "concept constraint requires template",
        "concurrency": "async atomic future lock mutex thread",
        "containers": "array container deque list map set vector",
        "io": "fstream io iostream stream stringstream",
        "memory": "allocator memory pointer shared_ptr unique_ptr weak_ptr",
        "numerics": "complex math numeric random valarray",
        "ranges": "iterator range ranges sentinel view",
        "utilities": "any optional tuple utility variant",
    }.items()
}

TOPICS = sorted(
    [
        "Move Semantics and Rvalue References",
        "Type Traits and SFINAE",
        "Concurrency (thread, mutex, async)",
        "Coroutines (C++20)",
        "Exception Handling",
        "Modules (C++20)",
        "Containers (vector, map, set, etc.)",
        "Concepts (C++20)",
        "Input/Output Streams",
        "Ranges Library (C++20)",
        "Memory Management (unique_ptr, shared_ptr)",
        "Templates and Generic Programming",
        "Iterators and Ranges",
        "Lambda Expressions",
        "Algorithms (sort, find, transform, etc.)",
    ]
)

_BLANK = r"^[\s   -     　﻿]+|[\s   -     　﻿]+$"


def trimmed(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(c, _BLANK, "")


def preview(text: Column, length: int = 500) -> Column:
    """The first ``length`` characters, trimmed; with dots if there are more."""
    return F.concat(trimmed(F.substring(text, 1, length)), F.when(F.char_length(text) > length, "...").otherwise(""))


def above_threshold(results: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Those of the results with at least this score: fewer rows than were asked for may be left."""
    return results.where(F.col("score") >= F.lit(float(threshold)))


def with_preview(results: DataFrame) -> DataFrame:
    """(id, score_text, preview): scores with four decimals and previews of 500 characters."""
    return results.select("id", F.format_string("%.4f", "score").alias("score_text"), preview(F.col("text")).alias("preview"))


def with_code(results: DataFrame, include_examples: bool = True) -> DataFrame:
    """(id, relevance, content, code): per cent with one decimal; the first fenced block, if there is one, follows a shorter preview."""
    blocks = F.regexp_extract_all("text", F.lit(r"```[\s\S]*?```"), F.lit(0))
    code = F.get(blocks, F.lit(0)) if include_examples else F.lit(None).cast("string")
    cut = lambda n: F.concat(trimmed(F.substring("text", 1, n)), F.lit("..."))
    content = F.when(code.isNotNull(), F.concat(cut(600), F.lit("\n\n**Code Example:**\n"), code)).otherwise(cut(800 if include_examples else 600))
    return results.select("id", F.format_string("%.1f%%", F.col("score") * 100).alias("relevance"), content.alias("content"), code.alias("code"))


def mentions(words: Sequence[str]) -> Column:
    """Whether any of the words is part of the lower-cased id or text."""
    found = F.lit(False)
    for w in sorted(words):
        found = found | F.lower("id").contains(w) | F.lower("text").contains(w)
    return found


class Retrieval:
    """Question answering steps on a store, with a function that embeds a text."""

    def __init__(self, store: VectorStore, embed: Callable[[str], Sequence[float]]) -> None:
        self.store, self.embed = store, embed

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def query(self, embedding: Sequence[float], k: int = 5, threshold: float = 0.0) -> DataFrame:
        if not self.store.is_finalized:
            raise StoreError("no documents are loaded")
        return above_threshold(self.store.search(embedding, k), threshold)

    def add(self, doc: dict) -> dict:
        """Add a document with an id, a text and an embedding that aren't empty."""
        if not (doc.get("id") and doc.get("text") and (doc.get("metadata") or {}).get("embedding")):
            raise StoreError("id, text and metadata.embedding are needed")
        self.store.add_document(doc)
        return {"success": True, "id": doc["id"]}

    def search(self, question: str, k: int = 5) -> DataFrame:
        return with_preview(self.store.search(self.embed(question), min(k, MAX_RESULTS)))

    def search_code(self, question: str, k: int = 5, include_examples: bool = True) -> DataFrame:
        return with_code(self.store.search(self.embed(question), min(k, MAX_RESULTS)), include_examples)

    def search_category(self, category: str, question: str, k: int = 5) -> DataFrame:
        """The first k of the 2k nearest (40 at most) that mention the category; an unknown category has none."""
        near = self.store.search(self.embed(f"{category} {question}"), min(2 * k, MAX_FETCHED))
        chosen = near.where(mentions(CATEGORY_KEYWORDS.get(category, ()))).orderBy(F.desc("score"), "id", "text").limit(k)
        return chosen.select("id", "score", F.concat(trimmed(F.substring("text", 1, 500)), F.lit("...")).alias("preview"))

    def section(self, section_id: str) -> DataFrame:
        """Of the ten nearest the first whose id contains ``section_id``, in any case; else the nearest."""
        near = self.store.search(self.embed(section_id), SECTION_FETCHED)
        match = F.lower("id").contains(section_id.lower())
        return near.withColumn("exact", match).orderBy(F.desc("exact"), F.desc("score"), "id", "text").limit(1)

    def topics(self) -> DataFrame:
        return self.spark.createDataFrame([(k, t) for k, t in enumerate(TOPICS)], "position int, topic string")

    def resource(self, uri: str) -> str:
        """The texts behind ``cpp://status`` and ``cpp://stats``."""
        if uri == "cpp://status":
            return f"Documents loaded: {self.store.size()}" if self.store.is_finalized else "No documents loaded"
        if uri == "cpp://stats":
            return json.dumps(self.store.stats())
        raise StoreError(f"no such resource: {uri}")

    def handle(self, method: str, params: dict | None = None) -> dict:
        """Answer a request; every failure is an ``error`` entry."""
        p = params or {}
        try:
            if method == "vector_search":
                rows = self.query(p["embedding"], p.get("k", 5), p.get("threshold", 0.0)).collect()
                return {"results": [r.asDict() for r in rows], "count": len(rows)}
            if method == "add_document":
                return self.add(p["document"])
            if method == "load_documents":
                return self.store.load_timed(p["path"])
            if method == "get_stats":
                return self.store.stats()
            return {"error": f"unknown method: {method}"}
        except Exception as e:
            return {"error": str(e)}
