"""Mix sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The mix's tokens are cut into equal blocks. Blocks are apportioned to sources, then within each source
to its shards, by the highest quotients ``weight / (2 * seats + 1)``, which gives integer quotas. In a
shard, documents stand in a seeded order and the blocks of that order are taken from its start, from
its start again once all are taken. Shards hold a bounded number of documents, whatever a source holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, with_row_key
from .text import token_count

SHARD_DOCS = 50_000
BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
SEED = 20_240_607


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources take the weights in the order of their code points, null last, in turn. What a source
    can't take is shared by weight among the others. A source is full once the common level (target
    per unit of weight) reaches ``most * source_size / weight``; in the order of these limits
    one running sum tells which sources are full. The windows are over one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    base = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    ranked = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before, after = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # the first source that isn't full sets the level for itself and all after it
    staged = base.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return staged.withColumn("final", final).select(*sizes.columns, F.least("cap", F.coalesce(F.col("final") * F.col("w"), "cap")).alias("target"))


def apportion(df: DataFrame, group: list[str], weight: str, seats: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: Sainte-Lague seats of each row, of ``seats`` seats in its group, by ``weight``.

    Only quotients near the share of a row can decide: with n rows the common divisor moves a
    share x of H seats by at most n / 2 + 1 seats in proportion, so the seats below
    ``x - (n * x / H) - 2`` are sure and only the quotients from there to the same above are ranked,
    a few for each row on average. Ties go by ``order``. Weights of 0 get no seat.
    """
    w = Window.partitionBy(*group)
    share = F.try_divide(F.col(seats) * F.col(weight), F.sum(weight).over(w))
    slack = F.ceil(F.count(F.lit(1)).over(w) * F.col("_x") / F.greatest(F.col(seats), F.lit(1))) + 2
    near = df.withColumn("_x", F.coalesce(share, F.lit(0.0))).withColumn("_slack", slack)
    near = near.withColumn("_sure", F.when(F.col(weight) > 0, F.greatest(F.lit(0), F.floor("_x") - F.col("_slack"))).otherwise(F.lit(0)))
    near = near.withColumn("_open", F.col(seats) - F.sum("_sure").over(w))
    tries = F.when(F.col(weight) > 0, F.sequence(F.col("_sure"), F.ceil(F.col("_x")) + F.col("_slack"))).otherwise(F.array().cast("array<bigint>"))
    asked = near.withColumn("_seat", F.explode_outer(tries))
    best = Window.partitionBy(*group).orderBy(F.desc_nulls_last(F.col(weight) / (2 * F.col("_seat") + 1)), *order, "_seat")
    won = asked.withColumn("_won", ((F.row_number().over(best) <= F.col("_open")) & F.col("_seat").isNotNull()).cast("long"))
    return won.groupBy(*df.columns).agg((F.first("_sure") + F.sum("_won")).cast("long").alias(out))


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard_docs: int = SHARD_DOCS, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    Sizes are in tokens, and ``taken`` counts repeats. Null and empty texts have size 0 and are
    taken 0 times. A null source is a source, the last. Repeated rows are rows of their own. The order
    in a shard is by a seeded digest of doc_id, then doc_id and size; rows equal in these are alike to it.
    No row is taken more than ``most`` times. Other columns are ignored.
    """
    sized = materialize(docs.select("doc_id", "source", token_count(F.col("text")).alias("size")), "sizes")
    return _plan(sized, seed, block, shard_docs, weights, share, most).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix as whole documents: each row of ``docs`` 0 to ``most`` times, by ``taken`` over its size, rounded.

    Only the document at the end of a shard's quota is taken in part, so that rounding moves a
    source by less than a document for each shard. Rows without tokens stay once: they cost nothing.
    """
    keyed = with_row_key(docs)
    arguments = {"seed": SEED, "block": BLOCK, "shard_docs": SHARD_DOCS, "weights": WEIGHTS, "share": SHARE, "most": MOST} | options
    sized = materialize(keyed.select("_row", "doc_id", "source", token_count(F.col("text")).alias("size")), "sizes")
    plan = _plan(sized, **arguments)
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.try_divide("taken", "size")).cast("int"))
    copies = plan.select("_row", times.alias("_times")).where("_times > 0")
    return keyed.join(copies, "_row").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def _seeded(seed: int, use: str) -> Column:
    """Hexadecimal digits that depend on doc_id, the seed and the use."""
    return F.md5(F.concat(F.lit(f"{seed}:{use}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _plan(sized: DataFrame, seed: int, block: int, shard_docs: int, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    aims = targets(per, weights, share, most)
    one = aims.withColumn("g", F.lit(1)).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    quotas = apportion(one, ["g"], "target", "blocks", [F.col("source").asc_nulls_last()], "quota")
    quotas = quotas.select(F.col("source").alias("q_source"), "source_size", "target", "quota", F.ceil(F.col("n") / shard_docs).cast("long").alias("shards"))

    # one row per source: a plain join, for the planner to choose
    joined = sized.join(quotas, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    placed = joined.withColumn("shard", F.conv(F.substring(_seeded(seed, "shard"), 1, 8), 16, 10).cast("long") % F.col("shards"))
    parts = placed.groupBy("source", "quota", "shard").agg(F.sum("size").alias("total"))
    shares = apportion(parts, ["source"], "total", "quota", [F.col("shard")], "blocks")
    shares = shares.select(F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "total", "blocks")
    seeded = Window.partitionBy("source", "shard").orderBy(_seeded(seed, "order"), "doc_id", "size")
    laid = placed.withColumn("stop", F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, 0)))
    both = laid.join(shares, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
    start = F.col("stop") - F.col("size")
    rounds = [F.greatest(F.lit(0), F.least("stop", F.col("blocks") * block - k * F.col("total")) - start) for k in range(most)]
    return both.withColumn("taken", sum(rounds[1:], rounds[0]).cast("long"))
