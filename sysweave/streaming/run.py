"""Running a stream over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sysweave.session import run_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Custom state needs the RocksDB store; state then lives on disk, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Process the rows available now into a table in the shared folder and read it.

    With a ``path`` an earlier run is gone on with.
    """
    spark = stream.sparkSession
    path = path or fresh_folder(spark, "stream")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_to_end(source: DataFrame, time: str, steps) -> DataFrame:
    """Like ``run_to_table`` for ``steps(source)``, with what the watermark still holds back.

    When the rows available now are done, one more row is fed whose ``time`` is far
    ahead; it closes all windows before it and none of its own. Its other columns
    are null.
    """
    spark = source.sparkSession
    marks, path = fresh_folder(spark, "marks"), fresh_folder(spark, "stream")
    spark.createDataFrame([], source.schema).write.parquet(marks)
    stream = steps(source.unionByName(spark.readStream.schema(source.schema).parquet(marks)))
    run_to_table(stream, path)
    mark = [F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema if f.name != time]
    end = F.timestamp_seconds(F.lit(4_102_444_800)).cast(source.schema[time].dataType).alias(time)
    spark.range(1).select(end, *mark).select(source.columns).write.mode("append").parquet(marks)
    return run_to_table(stream, path)
