"""License scan by ordered signature rules, in DataFrame operations only and without a shuffle."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import gates, rules
from .text import terms

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_PLACES = "array<struct<s: int, e: int>>"


def _places(text: str, pattern: str) -> str:
    """SQL: array of (first word, word after the last) of each match of ``pattern`` in ``text``.

    Both are SQL expressions. The text is words with single blanks around; the pattern has what is before a match as
    its first group. Words before a place are counted as blanks, in one pass over the matches.
    """
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    return f"""aggregate(
        zip_with(regexp_extract_all({text}, {pattern}, 0), regexp_extract_all({text}, {pattern}, 1), (w, b) -> named_struct('whole', w, 'before', b)),
        named_struct('seen', 0, 'out', cast(array() as {_PLACES})),
        (a, m) -> named_struct(
            'seen', a.seen + {blanks('m.whole')},
            'out', array_append(a.out, named_struct('s', a.seen + {blanks('m.before')} - 1, 'e', a.seen + {blanks('m.whole')}))),
        a -> a.out)"""


def _found(pattern: str) -> str:
    # \G ties a match to the end of the one before: without it, a failed search would begin anew at every character
    return rf"(?s)\G(.*?)(?<= )(?:{pattern})(?= )"


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, base (places of the base phrases), found and kept (rule detections) and score to ``docs``.

    ``base`` holds (s, e, label) of each place of a base phrase. ``found`` holds (s, e, priority, label) of every match
    of every rule, and ``kept`` those in no other's interval: of nested intervals the outer one stays, of equal ones
    the one of the first priority, then label. Words count from 0, ``e`` is the word after the last. ``score`` is the share of
    words that kept detections cover. Rules are data: a folded constant array that each row filters by the words it has, as every match of a
    rule holds all words of one of the rule's gates, and only rows with any such word get that far. Null and empty texts have 0 words and no detections.
    Columns of ``docs`` with these names are replaced.
    """
    table = rules()
    keywords = sorted({w for r in table for ws in gates(r[3]) for w in ws})
    literal = json.dumps([{"p": p, "label": label, "any": gates(rx), "rx": _found(rx)} for p, label, _, rx in table])
    rule_array = F.from_json(F.lit(literal), "array<struct<p: int, label: string, any: array<array<string>>, rx: string>>")
    base_pattern = _found("|".join(BASE))
    base_label = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])

    d = docs.withColumn("_words", terms(F.col(text)))
    d = d.withColumn("_keys", F.array_intersect("_words", F.array(*map(F.lit, keywords))))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("_norm", F.when(F.size("_keys") > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))).otherwise(""))
    quoted = base_pattern.replace("\\", "\\\\").replace("'", "\\'")
    d = d.withColumn("_base", F.when(F.col("_norm").rlike("|".join(f" {p} " for p in BASE)), F.expr(_places("_norm", f"'{quoted}'"))))
    named = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(base_label, F.array_join(F.slice("_words", x["s"] + 1, x["e"] - x["s"]), " ")).alias("label"))
    d = d.withColumn("base", F.coalesce(F.transform("_base", named), F.array().cast("array<struct<s: int, e: int, label: string>>")))

    d = d.withColumn("_rules", F.when(F.size("_keys") > 0, F.filter(rule_array, lambda r: F.exists(r["any"], lambda ws: F.forall(ws, lambda k: F.array_contains("_keys", k))))))
    each = f"transform({_places('_norm', 'r.rx')}, p -> named_struct('s', p.s, 'e', p.e, 'priority', r.p, 'label', r.label))"
    kind = "array<struct<s: int, e: int, priority: int, label: string>>"
    d = d.withColumn("found", F.when(F.size("_rules") > 0, F.expr(f"flatten(transform(_rules, r -> {each}))")).otherwise(F.array().cast(kind)))
    # by start, longest first, then priority: what lies in an interval comes after it, so the furthest end so far decides
    ordered = "array_sort(transform(found, d -> named_struct('s', d.s, 'n', -d.e, 'priority', d.priority, 'label', d.label)))"
    sweep = f"""aggregate({ordered}, named_struct('to', 0, 'words', 0, 'out', cast(array() as {kind})),
        (a, d) -> if(-d.n <= a.to, a, named_struct(
            'to', -d.n, 'words', a.words - d.n - greatest(a.to, d.s),
            'out', array_append(a.out, named_struct('s', d.s, 'e', -d.n, 'priority', d.priority, 'label', d.label)))))"""
    d = d.withColumn("_swept", F.when(F.size("found") > 0, F.expr(sweep)))
    d = d.withColumn("kept", F.coalesce("_swept.out", F.array().cast(kind)))
    d = d.withColumn("score", F.coalesce(F.round(F.try_divide(F.col("_swept.words").cast("double"), F.col("n_words")), 6), F.lit(0.0)))
    return d.drop("_words", "_keys", "_norm", "_base", "_rules", "_swept")


def _labels(*arrays: str | Column) -> Column:
    labels = [F.transform(a, lambda x: x["label"]) for a in arrays]
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")


def license_summary(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found, n_kept.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase, null if there is none; base labels are
    never suppressed. Repeated rows stay; other columns are ignored.
    """
    d = scan_licenses(docs.select("doc_id", "text"))
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["s"])).cast("long").alias("last_word"),
        _labels("base").alias("base_labels"),
        _labels("base", "kept").alias("labels"),
        "score",
        F.size("found").cast("long").alias("n_found"),
        F.size("kept").cast("long").alias("n_kept"),
    )
