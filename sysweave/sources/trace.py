"""System-call logs to structured calls.

A ``lines`` table has (session, seq, line); ``seq`` is the line number, unique
in its session. A ``calls`` table has (session, seq, pid, fn, args_text, ret,
t_start, t_end, dur, status, tracer).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sysweave.model import settled
from sysweave.operators.ordered import count_steps, scan
from sysweave.session import cut
from sysweave.sources.lines import read_lines

# How a record of the log ends, and a line that only reports an exit.
RECORD_END = (
    r"(<([0-9.eE+-]+|unfinished \.\.\.|no return \.\.\.)>$)|(^\[pid .* = \?$)|( ---$)"
    # An exit line is complete; it does not take the next record with it.
    r"|( \+\+\+$)"
)
EXIT_RESUMED = r"<\.\.\. exit(_group)? resumed>\) = \?"


def stitch_lines(lines: DataFrame) -> DataFrame:
    """Join the lines of a record that spans several.

    Lines that are records by themselves, nearly all of them, are passed on
    without being grouped.
    """
    ends = cut(lines.withColumn("_end", F.col("line").rlike(RECORD_END).cast("int")))
    marked = scan(
        ends,
        ["session"],
        previous={"_prev_end": F.col("_end")},
        sums={"_ends": F.col("_end")},
    ).withColumn("_rec", F.col("_ends") - F.col("_end"))
    alone = (F.col("_end") == 1) & (F.coalesce(F.col("_prev_end"), F.lit(1)) == 1)
    single = marked.where(alone).select("session", "seq", "line")
    pieces = F.array_sort(F.collect_list(F.struct("seq", "line")))
    several = (
        marked.where(~alone)
        .groupBy("session", "_rec")
        .agg(F.min("seq").alias("seq"), pieces.alias("_parts"))
        .select("session", "seq", F.array_join(F.col("_parts.line"), "\n").alias("line"))
    )
    return single.unionByName(several)


def function_name(raw: Column, resumed: Column, tracer: str) -> Column:
    """System calls carry ``@SYS``; library calls lose the library in front of ``->``."""
    if tracer == "strace":
        return F.concat(raw, F.lit("@SYS"))
    bare = F.regexp_replace(raw, r"^.*?->", "")
    return (
        F.when(bare == "", bare)
        .when(resumed, F.concat(bare, F.lit("@SYS")))
        .when(bare.startswith("SYS_"), F.concat(F.substr(bare, F.lit(5)), F.lit("@SYS")))
        .otherwise(bare)
    )


# Separates the parts one pattern takes out of a text; logs print such characters escaped.
MARK = "\ue000"
HEAD = r"^(?:\[pid +(\d+)\] )?(.{15}).(?s:(.*))$"
CALL = r"^(?:<\.\.\. ([^ ]*) resumed> |([^(]+)\()(?s:(.*))$"
RESULT = r"^(?s:(.*))\)\s*=\s*(?s:(.*))$"
DROPPED = r"^(?:\[pid +\d+\] )?.{16}(---|\+\+\+) "


def parts_of(text: Column, pattern: str, order: str, n: int) -> Column:
    """Groups of a pattern as an array, in one pass over the text."""
    groups = MARK.join(f"${i}" for i in order)
    return F.split(F.regexp_replace(text, pattern, groups), MARK, n)


def parse_lines(lines: DataFrame, tracer: str = "strace", top_pid=0) -> DataFrame:
    """Records of a strace or ltrace log to calls; signal and exit lines are dropped.

    Each step is a column of its own and is used by the next ones, so that a
    record is searched once per pattern.
    """
    if tracer == "pydbg":
        return parse_pydbg(lines)
    top = top_pid if isinstance(top_pid, Column) else F.lit(top_pid)
    broken = F.col("line").startswith("error:") if tracer == "ltrace" else F.col("line").rlike(
        EXIT_RESUMED
    )
    step = lines.where(~F.col("line").rlike(DROPPED)).select(
        "session",
        "seq",
        parts_of(F.regexp_replace("line", r"\n$", ""), HEAD, "123", 3).alias("h"),
        broken.alias("broken"),
    )
    step = step.select(
        "session",
        "seq",
        F.coalesce(F.col("h")[0].try_cast("long"), top).cast("long").alias("pid"),
        F.get("h", F.lit(1)).alias("t_start"),
        parts_of(F.get("h", F.lit(2)), CALL, "123", 3).alias("c"),
        "broken",
    )
    # The mark in the last angle brackets: a duration, or how the call was left.
    inner = F.get("c", F.lit(2))
    step = step.select(
        "session", "seq", "pid", "t_start", "broken",
        F.col("c")[0].alias("resumed_fn"),
        F.get("c", F.lit(1)).alias("raw_fn"),
        inner.alias("inner"),
        F.when(
            F.rtrim(inner).endswith(">"), F.regexp_replace(F.substring_index(inner, "<", -1), r">\s*$", "")
        ).alias("tail"),
    )
    words = ["unfinished ...", "no return ...", "detached ..."]
    seconds = F.col("tail").try_cast("double")
    marked = F.coalesce(seconds.isNotNull() | F.col("tail").isin(words), F.lit(False))
    body = F.when(marked, F.regexp_replace("inner", r"\s*<[^<]*$", "")).otherwise(F.col("inner"))
    step = step.select(
        "session", "seq", "pid", "t_start", "broken", "resumed_fn", "raw_fn", "tail",
        seconds.alias("seconds"),
        parts_of(body, RESULT, "12", 2).alias("r"),
    )
    resumed = F.col("resumed_fn") != ""
    left = F.col("tail").isin("unfinished ...", "no return ...")
    status = (
        F.when(F.col("broken"), "plain")
        .when(resumed, "resumed")
        .when(F.col("tail") == "unfinished ...", "unfinished")
        .when(F.col("tail") == "no return ...", "no_return")
        .otherwise("plain")
    )
    raw = F.when(resumed, F.col("resumed_fn")).otherwise(F.col("raw_fn"))
    no_fn = F.lit("" if tracer == "ltrace" else "@SYS")
    returned = F.when(~F.coalesce(left, F.lit(False)), F.trim(F.get("r", F.lit(1))))
    calls = step.select(
        "session",
        "seq",
        "pid",
        F.when(F.col("broken"), no_fn).otherwise(function_name(raw, resumed, tracer)).alias("fn"),
        F.when(F.col("broken"), "").otherwise(F.col("r")[0]).alias("args_text"),
        F.when(~F.col("broken"), returned).alias("ret"),
        "t_start",
        F.col("t_start").alias("t_end"),
        F.when(F.col("broken"), 0.0).otherwise(F.coalesce("seconds", F.lit(0.0))).alias("dur"),
        status.alias("status"),
        F.lit(tracer).alias("tracer"),
    )
    return settled(calls)


def parse_pydbg(lines: DataFrame) -> DataFrame:
    """Two words per line: process id and function."""
    words = F.split(F.trim("line"), r"\s+")
    return lines.where(F.size(words) >= 2).select(
        "session",
        "seq",
        F.get(words, F.lit(0)).cast("long").alias("pid"),
        F.get(words, F.lit(1)).alias("fn"),
        F.lit("").alias("args_text"),
        F.lit(None).cast("string").alias("ret"),
        F.lit(None).cast("string").alias("t_start"),
        F.lit(None).cast("string").alias("t_end"),
        F.lit(0.0).alias("dur"),
        F.lit("plain").alias("status"),
        F.lit("pydbg").alias("tracer"),
    )


def read_trace(spark: SparkSession, path: str, tracer: str = "strace", top_pid=0) -> DataFrame:
    lines = read_lines(spark, path)
    if tracer != "pydbg":
        lines = stitch_lines(lines)
    return parse_lines(lines, tracer, top_pid)


_MARKS = re.compile(r'\\.|"|[\[{(]|[\])}]|,', re.DOTALL)


def split_text(text: str) -> tuple[list, int]:
    """Arguments of one call, nested groups as lists, and the offset where they end."""
    limit = text.find("<unfinished ...>")
    limit = len(text) if limit < 0 else limit
    top: list = []
    current, enclosing, depth = top, [], 0
    start, quoted, closed = _skip(text, 0, limit, " "), False, False

    def add(end: int, trailing: str) -> None:
        piece = text[start:end].lstrip(' "').rstrip(trailing)
        current.append(piece[:-4] + "..." if piece.endswith('"...') else piece)

    for mark in _MARKS.finditer(text, 0, limit):
        if mark.start() < start:
            continue
        char = mark.group()
        if char == '"':
            quoted = not quoted
        elif quoted or char[0] == "\\":
            continue
        elif char in "[{" and mark.start() == start:
            enclosing.append((current, depth))
            current.append([])
            current, depth = current[-1], 0
            start = _skip(text, mark.end(), limit, " ")
        elif char in "[{(":
            depth += 1
        elif char in ")]}" and depth:
            depth -= 1
        elif char in ")]}":
            if mark.start() > start:
                add(mark.start(), '"')
            if not enclosing:
                start, closed = mark.end(), True
                break
            current, depth = enclosing.pop()
            start = _skip(text, mark.end(), limit, " ,")
        elif depth == 0:
            add(mark.start(), '"')
            start = _skip(text, mark.end(), limit, " ")
    if closed:
        return top, _skip(text, start, limit, " ")
    if start < limit:
        add(limit, ',)]} "')
    return top, limit


def _skip(text: str, at: int, limit: int, chars: str) -> int:
    while at < limit and text[at] in chars:
        at += 1
    return at


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_column(texts: pd.Series) -> pd.Series:
    def split(text):
        if text is None:
            return None
        return [a if isinstance(a, str) else json.dumps(a) for a in split_text(text)[0]]

    return texts.map(split)


def split_args(calls: DataFrame) -> DataFrame:
    """Add ``args``; nested groups are JSON text. One pass, no shuffle."""
    return calls.withColumn("args", _split_column(F.col("args_text")))


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """Side files of ``key=value`` lines, one row per file."""
    # The keys a session file holds.
    keys = ["TopProcessId", "CurrentDirectory", "CurrentDate", "CurrentHostname", "CurrentOSType"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("session"), F.trim("value").alias("line")
    )
    return session_rows(lines, keys)


def session_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(session, line) side-file lines to one row per session."""
    at = F.instr("line", "=")
    pairs = lines.where((at > 0) & ~F.col("line").startswith(";")).select(
        "session",
        F.substr("line", F.lit(1), at - 1).alias("key"),
        F.substr("line", at + 1).alias("value"),
    )
    wide = pairs.groupBy("session").pivot("key", keys).agg(F.max("value"))
    return wide.select(
        "session",
        F.col("TopProcessId").try_cast("long").alias("top_pid"),
        F.col("CurrentDirectory").alias("cwd"),
        F.col("CurrentDate").try_cast("date").alias("date"),
        F.col("CurrentHostname").alias("host"),
        F.col("CurrentOSType").alias("os"),
    )


def with_dates(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``ts``: the session's date, a day more after each backward jump over 12 h."""
    dated = calls.join(sessions.select("session", "date"), "session", "left")
    # Text times such as 23:59:59.123456 as seconds of the day.
    split = F.split("t_start", ":")
    second = (
        F.get(split, F.lit(0)).cast("double") * 3600
        + F.get(split, F.lit(1)).cast("double") * 60
        + F.get(split, F.lit(2)).cast("double")
    )
    counted = count_steps(
        dated,
        ["session"],
        "seq",
        {"second": second},
        lambda before, here: F.coalesce(before["second"] - here["second"] > 12 * 3600, F.lit(False)),
        "_days",
        first=0,
    )
    day = F.date_add("date", F.col("_days").cast("int")).cast("string")
    stamp = F.to_timestamp_ntz(F.concat_ws(" ", day, "t_start"))
    return counted.withColumn("ts", stamp).drop("_days")
