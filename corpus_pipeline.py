"""From documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents. Null and empty texts go
in the first stage, as do rejected documents. Rows without doc_id, and unlike
texts that share one, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sysweave.llm import bpe, decontaminate, linededup, neardup, quality
from sysweave.session import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier keeps, all columns."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that came before, ``n_chars`` counted anew where text went.

    A document of which nothing is left goes.
    """
    # Other columns under names that none of the operator's own has.
    own = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    clean = linededup.line_dedup(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())))
    columns = [
        F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(n)).alias(c)
        if c == "n_chars"
        else F.col(n).alias(c)
        for c, n in own.items()
    ]
    return clean.where("n_removed = 0 or n_removed_words < n_words").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the least doc_id; none counts as the greatest.

    Rows are told apart by a key of their own, which is written with them.
    """
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    rows = cut(docs.withColumn(key, F.monotonically_increasing_id()), "zstd")
    groups = neardup.near_duplicates(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    named = cut(rows.select(key, "doc_id").join(groups, key))
    first = named.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key)).alias("first")
    )
    others = named.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_anti")
    others = cut(others.select(F.col(key).alias("id")))
    # Only rows that the filter of the others lets through are shuffled with their texts.
    clear = neardup.passing(rows, key, others, want=False)
    rest = neardup.passing(rows, key, others).join(others, F.col(key) == F.col("id"), "left_anti")
    return clear.unionByName(rest).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.without_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return bpe.digests(bpe.round_trip(docs, bpe.public_vocabulary()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL cannot state the first four stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
