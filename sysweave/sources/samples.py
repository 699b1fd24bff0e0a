"""Counters and monitor output to samples: (object, ts, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.functions.identity import node_text
from sysweave.model import triples
from sysweave.operators.ordered import scan


def _words(column: str) -> Column:
    return F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")


def parse_vmstat(lines: DataFrame, prefix: str = "vmstat") -> DataFrame:
    """(object, ts, seq, line) lines: headers named ``r b swpd ..``, then values.

    A values line takes the names of the header above it; lines of another
    length are dropped.
    """
    is_header = F.col("line").rlike(r"^\s*r\s+b\s")
    is_values = F.col("line").rlike(r"^\s*\d")
    named = scan(lines, ["object"], last={"header": F.when(is_header, F.col("line"))})
    zipped = F.arrays_zip(_words("header").alias("metric"), _words("line").alias("value"))
    rows = named.where(is_values & (F.size(_words("header")) == F.size(_words("line"))))
    return rows.select("object", "ts", F.explode(zipped).alias("x")).select(
        "object",
        "ts",
        F.concat(F.lit(prefix + "."), F.col("x.metric")).alias("metric"),
        F.col("x.value").cast("double").alias("value"),
    )


def parse_iostat(lines: DataFrame, prefix: str = "iostat") -> DataFrame:
    """(object, ts, seq, line) lines: ``Device:`` header, then a row per device.

    The device becomes the object; decimals may have a comma.
    """
    is_header = F.col("line").rlike(r"^Device:?\s")
    named = scan(lines, ["object"], last={"header": F.when(is_header, F.col("line"))})
    names, values = _words("header"), _words("line")
    rows = named.where(~is_header & (F.size(values) > 1) & (F.size(names) == F.size(values)))
    zipped = F.arrays_zip(names.alias("metric"), values.alias("value"))
    pairs = F.slice(zipped, F.lit(2), F.greatest(F.size(zipped) - 1, F.lit(0)))
    return rows.select(F.get(values, F.lit(0)).alias("object"), "ts", F.explode(pairs).alias("x")).select(
        "object",
        "ts",
        F.concat(F.lit(prefix + "."), F.col("x.metric")).alias("metric"),
        F.translate("x.value", ",", ".").try_cast("double").alias("value"),
    )


def parse_tcpdump(lines: DataFrame) -> DataFrame:
    """``time IP a.port > b.port: ..`` lines to edges between two endpoints."""
    pattern = r"^\S+ IP (\S*)\.([^. ]*) \S+ (\S*)\.([^. ]*).( |$)"
    hit = lines.where(F.col("line").rlike(pattern)).select(
        *[
            F.regexp_extract("line", pattern, n).alias(name)
            for n, name in enumerate(["h1", "p1", "h2", "p2"], 1)
        ]
    )
    numeric = F.col("p1").rlike(r"^\d+$") & F.col("p2").rlike(r"^\d+$")
    return triples(
        hit.where(numeric),
        endpoint_node("h1", "p1"),
        "socket_end",
        endpoint_node("h2", "p2"),
        kind="uri",
    )


def endpoint_node(host, port) -> Column:
    host = host if isinstance(host, Column) else F.col(host)
    port = port if isinstance(port, Column) else F.col(port)
    return node_text("addr", {"Id": F.concat(host, F.lit(":"), port.cast("string"))})


def samples_from_counters(
    df: DataFrame, prefix: str, counters: list[str], obj: str = "object", ts: str = "ts"
) -> DataFrame:
    """Wide counters to long samples named ``prefix.counter``."""
    cast = df.select(
        F.col(obj).alias("object"),
        F.col(ts).alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in counters],
    )
    long = cast.unpivot(["object", "ts"], counters, "metric", "value")
    return long.where("value is not null").withColumn(
        "metric", F.concat(F.lit(prefix + "."), F.col("metric"))
    )


def samples_to_triples(samples: DataFrame) -> DataFrame:
    """A sample hangs off its object as a blank node with a time and a number."""
    label = F.concat_ws(
        "|", "object", "metric", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    bnode = F.concat(F.lit("_:"), F.sha2(label, 256))
    facts = F.array(
        F.struct(
            F.col("object").alias("s"), F.col("metric").alias("p"), bnode.alias("o"),
            F.lit("bnode").alias("o_kind"), F.lit(None).cast("string").alias("o_type"),
        ),
        F.struct(
            bnode.alias("s"), F.lit("timestamp").alias("p"), F.col("ts").cast("string").alias("o"),
            F.lit("lit").alias("o_kind"), F.lit("dateTime").alias("o_type"),
        ),
        F.struct(
            bnode.alias("s"), F.lit("value").alias("p"), F.col("value").cast("string").alias("o"),
            F.lit("lit").alias("o_kind"), F.lit("double").alias("o_type"),
        ),
    )
    return samples.select(F.explode(facts).alias("t")).select(
        "t.*", F.lit(None).cast("string").alias("ctx")
    )
