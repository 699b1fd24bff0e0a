"""Periodic runs of words, by the dictionary of basic factors.

The factors of 1, 2, 4, .. words of a text are numbered, those of a length from
pairs of the length before, so equal factors have equal numbers. On the level of
length L every factor's successor, its next occurrence, is found by one sort.
Where the successors of neighbouring places all lie d <= L words on, the
occurrences form progressions of step d, and d is proposed as the period of the
stretch they cover. Factors that occur once in their text go before the next
level, so ordinary prose is done after a few short levels.

A run of period q shows on each level of q words or more that it has room for.
It is taken on the least of them, L/2 < q <= L < 2q, where a run of three periods
or more has at least one place whose successor lies in it. There its stretch is
already extended to both ends: if the successor of one more place were q words
on, that place would belong to the run; and two periods of a stretch of at least
their sum would have a common divisor as a period, so no smaller step can hide q.
So each run is proposed exactly once.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import arrow_schema, documents, read, slices
from sysweave.llm.registry import query

#: Words lie between the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are worked on together.
TOGETHER = 1_000_000
RUNS = (
    "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"
)


class Numbers(dict):
    """Words to numbers, given out as words come up."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def runs_in(
    names: np.ndarray, least_words: int, least_periods: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence, by start and then period.

    ``names`` numbers the words of one or more texts end to end; words of two texts
    have different numbers, so no run goes over a border.
    """
    place, found, length = np.arange(len(names)), [], 1
    while len(place) > 1 and length * least_periods < 2 * len(names):
        order = np.argsort(names, kind="stable")  # by name, then place
        name, at = names[order], place[order]
        same = name[1:] == name[:-1]
        step = at[1:] - at[:-1]
        near = same & (step <= length) & (2 * step > length)
        begin, period = at[:-1][near], step[near]
        by_place = np.argsort(begin)
        begin, period = begin[by_place], period[by_place]
        fresh = np.append(True, (begin[1:] != begin[:-1] + 1) | (period[1:] != period[:-1]))[: len(begin)]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(begin))[: len(first)] - 1
        size = begin[last] - begin[first] + length + period[first]
        long = size >= np.maximum(least_words, least_periods * period[first])
        found.append((begin[first][long], size[long], period[first][long]))
        # Factors that occur again are numbered anew, in order.
        again = np.append(same, False) | np.append(False, same)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(np.append(True, ~same)) - 1
        kept = np.empty(len(order), bool)
        kept[order] = again
        place, number = place[kept], number[kept]
        after = np.searchsorted(place, place + length)
        whole = after < len(place)
        whole[whole] = place[after[whole]] == place[whole] + length
        names = number[whole] * (number.max(initial=0) + 1) + number[after[whole]]
        place = place[whole]
        length *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, size, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], size[order], period[order]


def periodic_runs(
    docs: DataFrame,
    least_words: int = 6,
    least_periods: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """RUNS of each row: its runs by start and then period, and its text without repeats.

    A run is a stretch of consecutive words (numbered from 0) with a smallest period
    of q words, of at least ``least_words`` words and ``least_periods`` periods (three
    or more), which no neighbouring word extends; runs may overlap. ``collapsed``
    has the words no run repeats, joined by a space: a word goes if any run holds it
    after that run's first period. A null or empty text has no words, no runs and an
    empty collapsed text. Rows stay apart, also repeated ones and those without an
    id, which may be null; other columns are not looked at. A very long text is
    one row: it takes memory in proportion to itself, and time by a sort for each doubling.
    """
    if least_periods < 3:
        raise ValueError("runs of under three periods are not all found on their level")

    def run(batches):
        schema, words_of = arrow_schema(RUNS), re.compile(WORD).findall
        for batch in batches:
            for part in slices(batch, rows=4096, chars=TOGETHER):
                texts = [words_of(t or "") for t in part.column(1).to_pylist()]
                counts = np.array([len(t) for t in texts])
                border = np.concatenate(([0], np.cumsum(counts)))
                words = list(itertools.chain.from_iterable(texts))
                numbers = Numbers()
                names = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                names += np.repeat(np.arange(len(texts)), counts) * len(numbers)
                start, size, period = runs_in(names, least_words, least_periods)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + size, -1)
                kept = np.cumsum(change[:-1]) == 0
                owner = np.searchsorted(border, start, "right") - 1
                split = np.searchsorted(owner, np.arange(len(texts) + 1))
                busy = set(owner.tolist())
                collapsed = [
                    " ".join(
                        itertools.compress(t, kept[border[i] : border[i + 1]].tolist()) if i in busy else t
                    )
                    for i, t in enumerate(texts)
                ]
                offsets = pa.array(split, pa.int32())
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(c))
                    for c in (start - border[owner], size, period)
                ]
                columns = [part.column(0), pa.array(counts, pa.int64()), *lists, pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

    return documents(docs, id_col, text_col).mapInArrow(run, RUNS)


def digests(runs: DataFrame) -> DataFrame:
    """Of ``periodic_runs``' rows: how many runs, the one of most periods, and digests of all."""
    each = F.arrays_zip(
        F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period")
    )
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best: Column, one: Column) -> Column:
        # By start and then period, so that the first of equal ones stays.
        more = one["length"] * best["period"] > best["length"] * one["period"]
        return F.when(best.isNull() | more, one).otherwise(best)

    lines = F.transform(
        "runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])
    )
    return (
        runs.select("doc_id", "collapsed", each.alias("runs"))
        .withColumn("best", F.aggregate("runs", none, better))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periods planted into about a tenth of the documents.

    With h the checksum of the document's number and g = floor(h / 10), a text of n
    words is rewritten where 10 divides h: from word a = g % n on, the p words there
    repeat to its end, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g = F.floor(h / 10)
    times = (F.lit(3) + g % 8).cast("int")

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / times)).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
        made = F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a))
        return F.when(n > 0, F.array_join(made, " "))

    # An array of one element, so that the words are found once.
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    new = F.element_at(F.transform(words, planted), 1)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(new, "text")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic")
def op12_periodic(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_periods(read(spark, sf_dir, "documents"))))
