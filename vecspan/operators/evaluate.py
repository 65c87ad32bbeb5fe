"""Measures of search quality and of timings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import all_zero, has_nan, magnitude, normalize


def embedding_health(docs: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, has_nan, all_zero, magnitude) of each vector."""
    v = F.col(vector)
    return docs.select(key, has_nan(v).alias("has_nan"), all_zero(v).alias("all_zero"), F.round(magnitude(v), 4).alias("magnitude"))


def topic_matches(topics: Sequence[str], *columns: str) -> Column:
    """How many of the topics are part of any of the columns, in any case."""
    hits = [F.greatest(*[F.lower(c).contains(t.lower()).cast("int") for c in columns], F.lit(0)) for t in topics]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def weighted_relevance(results: DataFrame, by: str, matches: Column, top: int = 5) -> DataFrame:
    """(by, relevance): sum of score times matches over the results of rank ``top`` or better, divided by ``top``."""
    return results.where(F.col("rank") <= top).groupBy(by).agg((F.sum(F.col("score") * matches) / top).alias("relevance"))


def category_report(results: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, mean_score, relevance_rate, n): mean score and share of scores that reach the threshold."""
    hit = (F.col("score") >= threshold).cast("double")
    return results.groupBy(by).agg(F.avg("score").alias("mean_score"), F.avg(hit).alias("relevance_rate"), F.count(F.lit(1)).alias("n"))


def timing_summary(runs: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, min, max, mean, median, stddev): the upper median, and the population's deviation.

    The median is the value of rank n / 2, from 0, by exact percentile over value counts.
    """
    n = F.count(value)
    ranked = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    return runs.groupBy(by).agg(n.alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), ranked.alias("median"), F.stddev_pop(value).alias("stddev"))


def throughput(count: Column, milliseconds: Column) -> Column:
    """Events a second."""
    return F.try_divide(count * 1000.0, milliseconds)


def metadata_value(path: str, column: str = "metadata_json") -> Column:
    """A value in the metadata, such as ``original_meta.origin.filename``."""
    return F.get_json_object(column, f"$.{path}")


def random_unit_vectors(df: DataFrame, dim: int, seed: int, key: str, out: str = "embedding") -> DataFrame:
    """Add normally distributed vectors of length 1 that depend on ``key`` and ``seed`` alone."""
    uniform = lambda k, part: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), k, F.lit(part)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    normal = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.sqrt(-2 * F.log(uniform(k, 0))) * F.cos(2 * math.pi * uniform(k, 1)))
    return df.withColumn(out, normal).withColumn(out, normalize(F.col(out)).cast("array<float>"))
