"""Samples over time: streams of counters and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sysweave.sources.samples import samples_from_counters


def sample_stream(stream: DataFrame, prefix: str, counters: list[str], **names) -> DataFrame:
    """Counters to samples; the same expression on a stream as on a table."""
    return samples_from_counters(stream, prefix, counters, **names)


def sample_rollup(
    samples: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Average, least and greatest value per object, metric and window of time.

    On a stream, rows later than ``late`` behind the newest are dropped.
    """
    timed = samples.withWatermark("ts", late) if samples.isStreaming else samples
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        timed.groupBy("object", "metric", window.alias("w"))
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("average"),
            F.min("value").alias("least"),
            F.max("value").alias("greatest"),
        )
        .select("object", "metric", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                "n", "average", "least", "greatest")
    )


def activity_bursts(samples: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Stretches of samples less than ``gap`` apart; an end is the last sample plus the gap.

    Samples that fall into one slot of the length of the gap always belong
    together. On a table they are combined before the shuffle, and an object is
    then ordered by its slots, whose number the time span bounds, not its samples.
    """
    if samples.isStreaming:
        return (
            samples.withWatermark("ts", late)
            .groupBy("object", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("object", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
        )
    epoch = "timestamp_seconds(0)"
    width = F.expr(f"unix_micros({epoch} + interval {gap}) - unix_micros({epoch})")
    slots = (
        samples.withColumn("at", F.unix_micros("ts"))
        .groupBy("object", F.floor(F.col("at") / width).alias("slot"))
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    in_time = Window.partitionBy("object").orderBy("slot")
    apart = F.col("lo") - F.lag("hi").over(in_time) >= width
    started = slots.withColumn("_s", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
    numbered = started.withColumn("_burst", F.sum("_s").over(in_time))
    return (
        numbered.groupBy("object", "_burst")
        .agg(
            F.timestamp_micros(F.min("lo")).alias("start"),
            F.timestamp_micros(F.max("hi") + width).alias("end"),
            F.sum("n").alias("n"),
        )
        .select("object", "start", "end", "n")
    )


def tick(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A triple per tick about a clock."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(
        F.lit("clock.Name=tick").alias("s"),
        F.lit("tick").alias("p"),
        F.col("value").cast("string").alias("o"),
        F.lit("lit").alias("o_kind"),
        F.lit("long").alias("o_type"),
        F.lit(None).cast("string").alias("ctx"),
        F.col("timestamp").alias("arrived"),
    )
