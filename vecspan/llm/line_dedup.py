"""Delete later copies of repeated line runs, in DataFrame operations only.

Lines become 64-bit ids, and each document a sequence of ids. Prefix doubling ranks the runs of 2h lines that start at each
position by the pair of ranks of its two halves of h lines: the distinct pairs are sorted in ranges, and numbered in
that order. Positions in the order of their ranks are the suffix array; those of equal rank are an interval of it, with longest common prefixes of
at least 2h lines. Positions whose pair is nobody else's are unique suffixes from there on and leave the doubling,
which so works on repeated text alone and ends once no run repeats at the next length. Only distinct pairs are sorted, so a
line that is a third of all lines is one row there; classes are aggregated (count and first position) with partial sums before
the shuffle, and where positions meet their ranks the engine splits a skewed partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, with_row_key

MIN_LINES = 2
LONG_LINE = 200  #: characters of a line that counts as a run by itself


def _lines(keyed: DataFrame) -> DataFrame:
    """(row, doc_id, ln, at, name, chars): ``ln`` counts the lines that aren't blank, ``at`` all lines."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    solid = F.filter(numbered, lambda s: F.trim(s["x"]) != "")
    each = keyed.select(F.col("_row").alias("row"), "doc_id", F.posexplode(solid).alias("ln", "s"))
    return each.select("row", "doc_id", "ln", F.col("s.i").alias("at"), F.xxhash64("s.x").alias("name"), F.char_length("s.x").alias("chars"))


def _repeated(pairs: DataFrame) -> DataFrame:
    """Positions (row, doc_id, ln, name, next) whose pair occurs again: with its rank as ``name``, and ``later``, whether some position before has it.

    Ranks ascend with (name, next) and differ between pairs. Positions are ordered by doc_id (null first), row and line.
    """
    place = F.struct("doc_id", "row", "ln")
    classes = pairs.groupBy("name", "next").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = classes.repartitionByRange(parts, "name", "next").sortWithinPartitions("name", "next")
    # a partition's number, then the place in it: in ranges these ascend with the pairs; written, for they must not change
    ranked = materialize(in_order.select("name", "next", "first", F.monotonically_increasing_id().alias("rank")), "ranks")
    later = (F.col("first.row") != F.col("row")) | (F.col("first.ln") != F.col("ln"))
    return pairs.join(ranked, ["name", "next"]).select("row", "doc_id", "ln", F.col("rank").alias("name"), later.alias("later"))


def suffix_classes(lines: DataFrame) -> list[tuple[int, DataFrame]]:
    """[(h, classes)] for h = 1, 2, 4 and so on while any run of h lines repeats.

    ``classes`` has row, doc_id, ln, name and ``later`` of each position where a repeated run of h lines starts; names are ranks among the
    repeated runs of h lines, and equal ones an interval of the suffix array. The list is logarithmic in the longest repeated run.
    """
    out: list[tuple[int, DataFrame]] = []
    h, now = 1, materialize(_repeated(lines.select("row", "doc_id", "ln", "name", F.lit(0).cast("long").alias("next"))), "runs")
    while not now.isEmpty():
        out.append((h, now))
        left = now.select("row", "doc_id", "ln", "name")
        right = now.select(F.col("row"), (F.col("ln") - h).alias("ln"), F.col("name").alias("next"))
        h, now = 2 * h, materialize(_repeated(left.join(right, ["row", "ln"])), "runs")
    return out


def _at_length(classes: list[tuple[int, DataFrame]], lines: int) -> DataFrame | None:
    """Positions where a repeated run of exactly ``lines`` lines starts, with ``later``; None if there is none."""
    below = [(h, c) for h, c in classes if h <= lines]
    if not below or 2 * below[-1][0] <= lines:
        return None
    h, c = below[-1]
    if h == lines:
        return c.select("row", "doc_id", "ln", "later")
    shifted = c.select("row", (F.col("ln") - (lines - h)).alias("ln"), F.col("name").alias("next"))
    return _repeated(c.select("row", "doc_id", "ln", "name").join(shifted, ["row", "ln"])).select("row", "doc_id", "ln", "later")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, runs): each maximal stretch of lines that occurred before, with its longest common prefix.

    Runs have row, first, last (lines that aren't blank, from 0) and lcp, the largest power of two h such that a run
    of h lines within it occurred before. A stretch is covered by copies of at least ``min_lines`` lines or by single lines of at least
    ``long_line`` characters.
    """
    keyed = with_row_key(docs)
    lines = materialize(_lines(keyed), "lines")
    classes = suffix_classes(lines)
    none = lines.where("false").select("row", "ln", F.lit(0).alias("h"))
    spans = none
    for h, c in classes:
        if h > min_lines:
            spans = spans.union(c.where("later").select("row", "ln", F.lit(h)))
    least = _at_length(classes, min_lines)
    if least is not None:
        spans = spans.union(least.where("later").select("row", "ln", F.lit(min_lines)))
    if classes and min_lines > 1:
        long = lines.where(F.col("chars") >= long_line).select("row", "ln")
        spans = spans.union(classes[0][1].where("later").join(long, ["row", "ln"]).select("row", "ln", F.lit(1)))
    # stretches: a span that starts beyond all before it begins a new one
    order = Window.partitionBy("row").orderBy("ln", "h")
    ends = spans.withColumn("end", F.col("ln") + F.col("h") - 1)
    ends = ends.withColumn("new", (F.col("ln") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    runs = ends.withColumn("run", F.sum("new").over(order)).groupBy("row", "run").agg(F.min("ln").alias("first"), F.max("end").alias("last"), F.max("h").alias("lcp"))
    numbers = lines.select("row", "ln", "at")
    return keyed, materialize(runs.select("row", F.explode(F.sequence("first", "last")).alias("ln"), "lcp").join(numbers, ["row", "ln"]), "deleted")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, longest_run, text without later copies.

    A line goes if it lies in a run of at least ``min_lines`` lines, or is a line of at least ``long_line``
    characters, that also occurs earlier (by doc_id, then line); the first occurrence stays. Blank lines
    are no lines of a run and stay. ``longest_run`` is the largest power of two h for which a deleted run of h lines occurred
    before (0: none). Null stays null with 0 lines; an empty text is one empty line. Of repeated rows the first stays whole.
    """
    keyed, deleted = repeated_runs(docs, min_lines, long_line)
    gone = deleted.groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("gone"), F.max("lcp").alias("lcp"))
    lines = F.split("text", "\n")
    # deletions grow with the input: the same shuffled join at every size, not a broadcast while they are few
    joined = keyed.select(F.col("_row").alias("row"), "doc_id", "text").join(gone.hint("merge"), "row", "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("lcp", F.lit(0)).alias("longest_run"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")).alias("text"),
    )
