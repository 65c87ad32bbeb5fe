"""Schemas and errors of the vector store."""

from __future__ import annotations

DOCUMENT = "id string, text string, metadata_json string, embedding array<float>"
RESULT = "score double, id string, text string, metadata_json string"
REJECTED = "source_file string, doc_index int, reason string, raw string"


class StoreError(ValueError):
    """A document or a query that the store can't take."""


class StoreFinalizedError(StoreError):
    """A document was added after the store was finalized."""
