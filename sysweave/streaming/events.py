"""The event store: triples appended by feeders and drained by readers.

The store is a Parquet table with a folder per batch, so a reader that knows its
last batch reads only the folders after it. Nothing is deleted
to read: a reader keeps the last batch it has seen, so a second read is empty
and readers do not take events from each other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sysweave.model import IDENTITY, TRIPLE_COLUMNS, TRIPLE_SCHEMA, as_set

EVENT_SCHEMA = TRIPLE_SCHEMA + ", arrived timestamp, batch bigint"
KEY = [*IDENTITY, "ctx"]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store, empty before the first write."""
    try:
        return read_store(spark, path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENT_SCHEMA)


def append_batch(triples: DataFrame, path: str, batch: int) -> None:
    """Add the triples the store does not hold yet in their context.

    A batch that is written again replaces itself: its rows are left out of the
    comparison and its folder is overwritten.
    """
    spark = triples.sparkSession
    old = stored(spark, path).where(F.col("batch") != batch)
    offered = triples.select(*TRIPLE_COLUMNS).dropDuplicates(KEY)
    cond = [offered[c].eqNullSafe(old[c]) for c in KEY]
    fresh = offered.join(old, cond, "left_anti")
    fresh.withColumn("arrived", F.current_timestamp()).write.mode("overwrite").parquet(
        f"{path}/batch={batch}"
    )


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """Feed a stream of triples into the store; returns the query.

    What the stream has brought before is state of the query, so a batch costs
    what it holds and the store is not read. A batch that is written again
    replaces itself.
    """

    def write(batch_df: DataFrame, batch: int) -> None:
        batch_df.withColumn("arrived", F.current_timestamp()).write.mode("overwrite").parquet(
            f"{path}/batch={batch}"
        )

    return (
        stream.select(*TRIPLE_COLUMNS)
        .dropDuplicates(KEY)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain(
    store: DataFrame, seen: int = -1, ctx: str | None = None, every: bool = False,
    entity: str | None = None,
) -> DataFrame:
    """Triples of a context that came after batch ``seen``.

    ``every`` takes all contexts, each triple once; ``entity`` one subject.
    """
    new = store.where(F.col("batch") > seen)
    if entity is not None:
        new = new.where(F.col("s") == entity)
    elif not every:
        new = new.where(F.col("ctx").eqNullSafe(F.lit(ctx)))
    return as_set(new.select(*TRIPLE_COLUMNS))


def high_mark(store: DataFrame) -> DataFrame:
    """Number of the last batch, to be kept by the reader for its next read."""
    return store.agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("seen"))


def drain_stream(spark: SparkSession, path: str) -> DataFrame:
    """The store as a stream; the checkpoint of its query is the reader's mark."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path)


def event_counts(store: DataFrame) -> DataFrame:
    """(ctx, events) per context and, with ``total`` set, over all of them; a triple in
    two contexts counts once in the total."""
    per = store.select(*KEY).distinct().groupBy("ctx").agg(F.count(F.lit(1)).alias("events"))
    total = store.select(*IDENTITY).distinct().agg(F.count(F.lit(1)).alias("events"))
    return per.withColumn("total", F.lit(False)).unionByName(
        total.select(F.lit(None).cast("string").alias("ctx"), "events", F.lit(True).alias("total"))
    )


def clear_events(spark: SparkSession, path: str) -> None:
    empty = spark.createDataFrame([], EVENT_SCHEMA)
    empty.write.mode("overwrite").partitionBy("batch").parquet(path)
