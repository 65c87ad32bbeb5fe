"""From raw documents to a tokenized training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes every stage's table as
Parquet in the folder that executors share and reads it back for the next. All stages but the last
return the columns of their input.

1. toxicity: documents graded toxic go. The model is trained on ``labels`` and the ``documents`` they belong to.
2. near_duplicates: of each group that Jaccard links connect, the document of the smallest doc_id stays.
   Documents without words are in no group and stay.
3. decontamination: documents that hold a window of ``benchmark`` go.
4. mixing: each document stays 0, 1 or 2 times, so that sources come near their target weights.
5. token_ids: the mix as compressed token ids, one row per document: doc_id, start, n_tokens, ids_crc32.

Null or empty columns, repeated rows and empty tables pass through all stages as the operators define them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm import decontaminate, jaccard_join, mixing, token_store, toxicity
from vecspan.llm.storage import materialize, scratch, with_row_key

MIX_SHARE = mixing.SHARE  #: words of the mix, as a share of the words that come in


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(labelled, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = with_row_key(docs)
    groups = jaccard_join.jaccard_groups(keyed.select(F.col("_row").alias("doc_id"), "text"))
    first = groups.where("n_shingles = 0 or component_id = doc_id").select(F.col("doc_id").alias("_row"))
    return keyed.join(first, "_row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = with_row_key(docs)
    judged = decontaminate.contamination(keyed.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(judged.where("contaminated").select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, share=MIX_SHARE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    manifest = token_store.write_token_store(docs, scratch(spark, "pipeline-tokens"))
    return token_store.read_token_store(manifest, zlib.crc32, "long").withColumnRenamed("value", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("token_ids", token_ids),
]

#: A trained model and token ids aren't expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
