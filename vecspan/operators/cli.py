"""A prompt on a store: ``help``, ``stats``, ``exit`` or ``quit``, or a question."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import functions as F

from .rag import Retrieval, trimmed

HELP = "Commands: help, stats, exit. Anything else is searched for."


def answer(retrieval: Retrieval, line: str, k: int = 5) -> str | None:
    """What a line is answered with; None to end."""
    command = line.strip()
    if command.lower() in ("exit", "quit"):
        return None
    if command.lower() == "help":
        return HELP
    if command.lower() == "stats":
        return str(retrieval.store.stats())
    if not command:
        return ""
    found = retrieval.store.search(retrieval.embed(command), k).select("score", "id", trimmed(F.substring("text", 1, 300)).alias("text")).collect()
    return "\n\n".join(f"{n}. {r.id} ({r.score:.4f})\n   " + r.text.replace("\n", "\n   ") for n, r in enumerate(found, 1))


def prompt(retrieval: Retrieval, lines: Iterable[str] = sys.stdin, show: Callable[[str], object] = print) -> None:
    for line in lines:
        said = answer(retrieval, line)
        if said is None:
            break
        show(said)
