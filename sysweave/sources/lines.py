"""Text files as numbered lines, without passing a file through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, seq, line): every line of every file with its number in the file.

    A file is read in blocks. Row ids grow inside a block, so a block numbers
    its own lines, and the lines of earlier blocks are added from one count per
    block. The block size bounds what one task sorts.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("session"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
    earlier = (
        Window.partitionBy("session")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        raw.groupBy("session", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("session", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    )
    inside = Window.partitionBy("session", "block").orderBy("row")
    return (
        raw.withColumn("n", F.row_number().over(inside))
        .join(offsets, ["session", "block"])
        .select("session", (F.col("skip") + F.col("n")).alias("seq"), "line")
    )
