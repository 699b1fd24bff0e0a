"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators were planned for. A cluster sets its own sizes; AQE
# coalesces and splits partitions from there.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "sysweave", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder executors share: what ``spark.checkpoint.dir`` names, or, where that
    is unset, a folder in the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_folder(spark)}/sysweave/{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> None:
    """Delete the tables this application wrote to the shared folder.

    For the end of a run: results that were not read or written yet are lost.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table replaces the lineage, outlives lost executors, and gives
    the planner true sizes for the next round of a loop.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to ``spark.sql.files.minPartitionNum`` tasks where a session sets it, else to
    one task a core where a table's files make fewer, for costly work on tables of few files."""
    spark = df.sparkSession
    least = spark.conf.get("spark.sql.files.minPartitionNum", None)
    if least:
        return df.repartition(int(least))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
