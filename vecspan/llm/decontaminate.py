"""Benchmark decontamination on a positional inverted index, in DataFrame operations only.

The index is a stored table of postings (row, term, position) of every term that the test set uses;
each row's end is the posting of a sentinel term, whose position is the row's length. The text is
read and cut into terms once. A search starts from each phrase's rarest term by the counts in the
index, shifts its postings by the term's offset in the phrase, and intersects them with the shifted
postings of the phrase's other terms in the order of their rarity. Phrases with a term that the
training data lacks end before any postings are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, small, with_row_key
from .text import terms

WINDOW = 10
END = "\x00"  #: sentinel term; no term of a text contains it
MAX_BROADCAST_TERMS = 200_000
MAX_BROADCAST_ROWS = 1_000_000


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Store the postings of ``docs`` (doc_id, text) for the terms in ``vocabulary`` (word).

    Columns: row (differs for all rows of docs), term (64-bit hash of the word), pos (from 0), and
    doc_id, set on the end posting only. Every row has an end posting; null and empty texts
    have only that, at 0. Terms outside the vocabulary aren't stored, as no search can ask for them.
    """
    known = materialize(vocabulary.select("word").distinct(), "vocabulary")
    known = small(known.union(known.sparkSession.createDataFrame([(END,)], "word string")), MAX_BROADCAST_TERMS)
    keyed = with_row_key(docs.select("doc_id", "text"))
    tokens = keyed.select(F.col("_row").alias("row"), "doc_id", F.posexplode(F.concat(terms(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
    found = tokens.join(known, "word")
    return materialize(found.select("row", F.xxhash64("word").alias("term"), "pos", F.when(F.col("word") == END, F.col("doc_id")).alias("doc_id")), "postings")


def _end() -> F.Column:
    return F.xxhash64(F.lit(END))


def item_phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, item, words): each distinct window of each item; a shorter item is one window, a wordless one none.

    ``item`` is item_id as a string (null: empty); ``phrase`` is a 64-bit hash of the window's words.
    """
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1)))
    cut = words.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), F.least(F.lit(window), F.size("w"))).alias("words"))
    return cut.select(F.xxhash64(F.array_join("words", " ")).alias("phrase"), "item", "words").distinct()


def ranked_terms(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, len, term, off, rank) of phrases whose terms all occur; rank 1 is the rarest term."""
    each = phrases.select("phrase", "words").dropDuplicates(["phrase"]).select("phrase", F.size("words").alias("len"), F.posexplode("words").alias("off", "word"))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rated = each.select("phrase", "len", "off", F.xxhash64("word").alias("term")).join(counts, "term", "left")
    all_in = Window.partitionBy("phrase")
    order = all_in.orderBy("df", "term", "off")
    return rated.withColumn("known", F.count("df").over(all_in)).where("known = len").select("phrase", "len", "term", "off", F.row_number().over(order).alias("rank"))


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """(row, phrase, start, len): where the phrases of ``phrases`` (phrase, words) occur in the index.

    With ``slop`` 0 these are exact occurrences. With a larger one they are proximity matches:
    ``start`` aligns the phrase's rarest term exactly, and each other term stands within ``slop``
    positions of its place. Phrases and texts without words match nothing.
    """
    parts = materialize(ranked_terms(index, phrases), "terms")
    postings = index.where(F.col("term") != _end()).select("row", "term", "pos")

    rarest = small(parts.where("rank = 1"), MAX_BROADCAST_ROWS)
    hits = postings.join(rarest, "term").select("row", "phrase", "len", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    for rank in (2, None):  # the second term alone thins the candidates; then all the others at once
        hits = materialize(hits, "hits")
        more = parts.where(F.col("rank") == rank if rank else F.col("rank") > 2)
        if rank:
            lists = postings.join(small(more.select("term").distinct(), MAX_BROADCAST_TERMS), "term", "left_semi")
        else:
            lists = postings.join(small(hits.select("row").distinct(), MAX_BROADCAST_ROWS), "row", "left_semi")
        probes = hits.join(small(more.select("phrase", "term", "off"), MAX_BROADCAST_ROWS), "phrase")
        if slop:
            at = F.explode(F.sequence(F.col("start") + F.col("off") - slop, F.col("start") + F.col("off") + slop)).alias("pos")
        else:
            at = (F.col("start") + F.col("off")).alias("pos")
        met = probes.select("row", "phrase", "len", "start", "off", "term", at).join(lists, ["row", "term", "pos"])
        needed = 1 if rank else F.col("len") - 2
        full = met.groupBy("row", "phrase", "len", "start").agg(F.count_distinct("off").alias("n") if slop else F.count(F.lit(1)).alias("n")).where(F.col("n") == needed)
        short = hits.where(F.col("len") < (rank or 3))
        hits = full.select("row", "phrase", "len", "start").union(short.select("row", "phrase", "len", "start"))
    return hits.select("row", "phrase", "start", "len")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, item, start, len, words): every place of every window of ``items`` in ``docs``."""
    phrases = materialize(item_phrases(items, window), "phrases")
    index = build_index(docs, phrases.select(F.explode("words").alias("word")))
    ends = index.where(F.col("term") == _end()).select("row", "doc_id")
    return search(index, phrases, slop).join(phrases, "phrase").join(ends, "row").select("doc_id", "item", "start", "len", "words")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any exact occurrence of a window of ``items`` (item_id, text). Null and
    empty texts have no words; repeated rows and doc_ids are judged row by row; an empty benchmark
    hits nothing. ``items_sha256`` is over the sorted, comma-joined ids, so the empty string's
    where there is none.
    """
    phrases = materialize(item_phrases(items, window), "phrases")
    index = build_index(docs, phrases.select(F.explode("words").alias("word")))
    found = materialize(search(index, phrases), "found")
    # overlapping places once: what each adds beyond the furthest end before it
    before = Window.partitionBy("row").orderBy("start", "len", "phrase").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("len")
    covered = found.withColumn("reached", F.coalesce(F.max(stop).over(before), F.lit(0)))
    n_hit = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), stop - F.greatest("start", "reached"))).alias("n_hit"))
    of_items = found.select("row", "phrase").distinct().join(phrases.select("phrase", "item"), "phrase").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ends = index.where(F.col("term") == _end()).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    joined = ends.join(n_hit.join(of_items, "row"), "row", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
