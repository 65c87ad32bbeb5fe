"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

``P(grade >= j) = sigmoid(w . x - t_j)`` with one weight vector for all grades and ascending thresholds t_j. Features are
the presence of words and of the first four and five characters of longer words. Labels above 1 are grades as they are. Where
all labels are 0 or 1, the toxic training texts are graded by models that don't know them: the texts are halved, each half's
binary model scores the other half, and the thirds of these scores are the grades 1 to 3. Of several labels of a document, or
of equal texts, the worst counts.
Only features that speak for toxicity are kept: with the presence of features that speak against it, long texts would
gather evidence against by their length alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, trimmed

MAX_TRAIN = 20_000  #: labelled documents that train the model, the lowest by hash; the bound of its sample
MAX_FEATURES = 4_096
MIN_TOXIC = 5  #: toxic training texts that a feature must be in
MIN_SCORE = 4.0  #: of a feature's excess among toxic texts, in standard deviations
GRADES = 3  #: that binary labels are spread over
STEPS = 400
CUT = 0.5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> set[bytes]:
    """Distinct words of a text, A-Z lower-cased, as UTF-8."""
    return set(_WORD.findall(text.encode("utf-8", "surrogatepass").lower())) if text else set()


def word_features(word: bytes) -> list[bytes]:
    """The features of a word: itself, and its first four and five characters if it is longer."""
    chars = word.decode("utf-8", "replace")
    return [word] + [b"%d:" % n + chars[:n].encode("utf-8", "replace") for n in (4, 5) if len(chars) > n]


@dataclass
class OrdinalModel:
    """Weights by feature, and ascending thresholds."""

    weights: dict[bytes, float]
    thresholds: list[float]

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1.., a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - np.array(self.thresholds)[None, :], -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    grade = F.greatest(F.lit(0), F.col("toxic").cast("int"))
    each = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    some = each.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_train)
    # at most max_train pairs of numbers: a bound that holds for any input
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "grade")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> OrdinalModel:
    """Fit the model on at most ``max_train`` labelled documents, whole texts of any length; equal texts count once.

    Features are counted over the sample in Spark, and the most telling are kept. Without any toxic label the model gives grade 0 to all.
    """

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = {f for w in words_of(text) for f in word_features(w)}
                rows.append(([*found], xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)))
            yield pa.RecordBatch.from_arrays([batch.column("grade").cast(pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.binary()))], ["grade", "id", "features"])

    each = _sample(docs, labels, max_train).mapInArrow(trimmed(featurize), "grade int, id long, features array<binary>")
    rows = materialize(each.groupBy("id").agg(F.max("grade").alias("grade"), F.first("features").alias("features")), "train")
    n = rows.count()
    if n > max_train:  # repeated ids with different texts
        rows = rows.where(F.pmod("id", F.lit(n)) < max_train)
    n, n1 = rows.agg(F.count(F.lit(1)), F.count_if(F.col("grade") > 0)).first()
    if not n1 or n1 == n:
        return OrdinalModel({}, [30.0 if not n1 else -30.0] * GRADES)
    rate = n1 / n
    counts = rows.select("grade", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("grade") > 0).alias("pos"), F.count(F.lit(1)).alias("all")).where(F.col("pos") >= MIN_TOXIC)
    scored = counts.withColumn("z", (F.col("pos") - rate * F.col("all")) / F.sqrt(rate * (1 - rate) * F.col("all"))).where(F.col("z") >= MIN_SCORE)
    chosen = sorted(bytes(r[0]) for r in scored.orderBy(F.desc("z"), "f").limit(MAX_FEATURES).select("f").collect())
    column = {f: k for k, f in enumerate(chosen)}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(column[f] for f in fs if f in column) for fs in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("id"), pa.array(hits, pa.list_(pa.int32()))], ["grade", "id", "hits"])

    data = sorted((r["id"], r["grade"], list(r["hits"])) for r in rows.mapInArrow(trimmed(narrow), "grade int, id long, hits array<int>").collect())
    hits, grades = [d[2] for d in data], np.array([d[1] for d in data])
    if grades.max() == 1:
        grades = spread_grades(hits, grades, len(chosen))
    weights, thresholds = fit_ordinal(hits, grades, len(chosen))
    return OrdinalModel({f: float(weights[k]) for f, k in column.items() if weights[k]}, [float(t) for t in thresholds])


def spread_grades(rows: list[list[int]], toxic: np.ndarray, features: int) -> np.ndarray:
    """0 for other texts; 1 to GRADES for toxic ones, in equal parts by the score that the other half's binary model gives."""
    score = np.zeros(len(rows))
    for half in (0, 1):
        own = [r for k, r in enumerate(rows) if k % 2 == half]
        w, _ = fit_ordinal(own, toxic[half::2], features) if len(own) else (np.zeros(features), None)
        score[1 - half :: 2] = [w[r].sum() for r in rows[1 - half :: 2]]
    ordered = np.sort(score[toxic > 0])
    cuts = [ordered[len(ordered) * k // GRADES] for k in range(1, GRADES)]
    return np.where(toxic > 0, 1 + np.searchsorted(cuts, score, "left"), 0)


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, features: int, steps: int = STEPS, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least regularised loss, summed over the grades' binary questions; full-batch Adam."""
    n, most = len(rows), max(1, int(grades.max()))
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    # thresholds stay ascending: the first, then logs of the gaps
    theta = np.concatenate([np.zeros(features), [2.0], np.zeros(most - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    above = grades[:, None] >= np.arange(1, most + 1)[None, :]
    for step in range(1, steps + 1):
        w, gaps = theta[:features], np.exp(theta[features + 1 :])
        cuts = theta[features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, w[col], n) if len(col) else np.zeros(n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -30, 30)))
        error = (p - above) / n
        down = -error.sum(0)
        g = np.concatenate([np.bincount(col, error.sum(1)[at], features) + l2 * w if len(col) else l2 * w, [down.sum()], [down[k + 1 :].sum() * gaps[k] for k in range(most - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:features], theta[features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[features + 1 :]))])


class Scorer:
    """Scores whole texts; remembers which features of the model a word has, up to a number of words."""

    LIMIT = 250_000

    def __init__(self, model: OrdinalModel) -> None:
        self.model = model
        self.known: dict[bytes, tuple[bytes, ...]] = {}

    def hits(self, text: str | None) -> set[bytes]:
        known, weights = self.known, self.model.weights
        found: set[bytes] = set()
        for w in words_of(text):
            fs = known.get(w)
            if fs is None:
                if len(known) >= self.LIMIT:
                    known.clear()
                known[w] = fs = tuple(f for f in word_features(w) if f in weights)
            if fs:
                found.update(fs)
        return found

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        hits = [self.hits(t.as_py()) for t in texts]  # one text at a time: a batch of long ones is large
        return np.array([sum(self.model.weights[f] for f in sorted(h)) for h in hits], float), [len(h) for h in hits]


def grade_documents(docs: DataFrame, model: OrdinalModel, cut: float = CUT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, severity, grade, p_toxic, n_features, toxic.

    ``severity`` is the expected grade (0 to the highest), ``grade`` the most likely one, ``p_toxic`` is P(grade >= 1), and ``toxic`` says
    whether that is at least ``cut``. Null and empty texts have no features, so the base rate's grade. Repeated rows
    are graded alike; other columns are ignored.
    """
    names = ["doc_id", "severity", "grade", "p_toxic", "n_features", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, n = scorer.score(batch.column("text"))
            p = model.probabilities(scores)
            exact = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.round(p.sum(1), 6)), pa.array(exact.argmax(1).astype(np.int32)), pa.array(np.round(p[:, 0], 6)), pa.array(n, pa.int64()), pa.array(p[:, 0] >= cut)], names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, severity double, grade int, p_toxic double, n_features long, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't toxic."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            if batch.num_rows:
                p = model.probabilities(scorer.score(batch.column("text"))[0])
                yield batch.filter(pa.array(p[:, 0] < cut))

    return docs.mapInArrow(trimmed(run), schema)
