"""Live logs: the stateless steps as they are, the rest with state per process.

Steps with state need a session whose state store is RocksDB (``run.keyed_state``). They take
rows as these come, or, where ``time`` names a column of event times, in the order of the log
(``InTimeOrder``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sysweave.operators.calls import NEVER_EQUAL, drop_ignored, significant_args
from sysweave.operators.match import match, solve_one, variables
from sysweave.sources.trace import parse_lines, split_args

MATCHED = (
    "session string, pid bigint, fn string, seq bigint, partner_seq bigint, "
    "args array<string>, status string"
)


def trace_stream(lines: DataFrame, tracer: str = "strace", top_pid=0) -> DataFrame:
    """Calls of a stream of log records (session, seq, line)."""
    return significant_args(drop_ignored(split_args(parse_lines(lines, tracer, top_pid))))


#: Rows of a key that wait together; of a key with more, the rows of a slot do.
FEW = 512


class InTimeOrder(StatefulProcessor):
    """Gives the rows of a key to ``settle`` in the order of ``seq``.

    With ``slot_ms``, rows wait in state until the watermark has passed the end of their slot of
    event time. Up to ``FEW`` rows of a key wait together, under one timer, so a key costs as much as
    its rows do, however many slots they are in. Of a key with more, each slot has its own entry and
    timer, which takes out that slot's rows and no others. So memory holds a slot of one key, or ``FEW``
    rows, however many rows a key or a batch has; files may come in any order
    within the watermark's delay. ``seq`` and time have to rise together between slots. A row
    without ``seq`` only moves the time on. Without ``slot_ms`` a batch's rows are
    put in order as they are, and batches have to come in order.
    """

    #: Columns of a row besides its key, ``seq`` first, and columns given out.
    takes: str
    gives: list[str]

    def __init__(self, slot_ms: int | None = None):
        self._slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._names = [c.split()[0] for c in self.takes.split(", ")]
        if self._slot_ms is not None:
            row = f"slot:bigint, {', '.join(c.replace(' ', ':', 1) for c in self.takes.split(', '))}"
            # No rows here, but a null: the key's rows are in ``slots``.
            self._few = handle.getValueState("few", f"rows array<struct<{row}>>")
            self._slots = handle.getMapState("slots", "slot bigint", f"rows array<struct<{row}>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        if self._slot_ms is None:
            batch = pd.concat(list(rows), ignore_index=True).sort_values("seq")
            self.begin()
            out = self.settle(key, batch[self._names].itertuples(index=False), timerValues)
            yield self._frame(out + self.finish(key, timerValues))
            return
        for frame in rows:
            columns = [frame[c].tolist() for c in ["slot", *self._names]]
            new = [self._plain(r) for r in zip(*columns, strict=True) if not pd.isna(r[1])]
            if new:
                self._wait(new)

    def _wait(self, new: list[tuple]) -> None:
        few = self._few.get()
        waiting = [] if few is None else few[0]
        if waiting is not None:
            new = [tuple(r) for r in waiting] + new
            if len(new) <= FEW:
                self._few.update((new,))
                self._handle.registerTimer((min(r[0] for r in new) + 1) * self._slot_ms)
                return
            self._few.update((None,))
        for slot, part in groupby(sorted(new, key=lambda r: r[0]), key=lambda r: r[0]):
            held = self._slots.getValue((slot,))
            held = [] if held is None else [tuple(r) for r in held[0]]
            self._slots.updateValue((slot,), (held + list(part),))
            self._handle.registerTimer((slot + 1) * self._slot_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ready = self._ready(int(expiredTimerInfo.getExpiryTimeInMs()), timerValues)
        if not ready:
            return
        ready.sort(key=lambda r: r[:2])
        self.begin()
        out = []
        for _, rows in groupby(ready, key=lambda r: r[0]):
            out += self.settle(key, [r[1:] for r in rows], timerValues)
        yield self._frame(out + self.finish(key, timerValues))

    def _ready(self, end: int, timerValues) -> list[tuple]:
        """The rows whose time has come, taken out of state."""
        few = self._few.get()
        if few is None:
            return []
        if few[0] is None:
            slot = end // self._slot_ms - 1
            held = self._slots.getValue((slot,))
            if held is None:
                return []
            self._slots.removeKey((slot,))
            if not self._slots.exists():
                self._few.clear()
            return [tuple(r) for r in held[0]]
        end = max(end, int(timerValues.getCurrentWatermarkInMs()) - 1)
        ready, rest = [], []
        for r in few[0]:
            (ready if (r[0] + 1) * self._slot_ms <= end else rest).append(tuple(r))
        if rest:
            self._few.update((rest,))
            self._handle.registerTimer((min(r[0] for r in rest) + 1) * self._slot_ms)
        else:
            self._few.clear()
        return ready

    def begin(self) -> None:
        """Takes what ``settle`` goes on with from state."""

    def settle(self, key, rows, timerValues) -> list[tuple]:
        """The rows to give out for rows that come in order."""
        raise NotImplementedError

    def finish(self, key, timerValues) -> list[tuple]:
        """Puts into state what is open after the last ``settle``; the rows to give out then."""
        return []

    def close(self) -> None:
        pass

    @staticmethod
    def _plain(row) -> tuple:
        return tuple(v.tolist() if hasattr(v, "tolist") else v for v in row)

    def _frame(self, rows) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=self.gives)
        if "partner_seq" in self.gives:
            frame["partner_seq"] = frame["partner_seq"].astype("Int64")
        return frame


def slot_of(time: str | None, slot: str) -> int | None:
    """Milliseconds of a slot like ``1 hour``."""
    return None if time is None else max(1, int(pd.Timedelta(slot).total_seconds() * 1000))


def in_time(calls: DataFrame, time: str | None, late: str, slot: str, *columns: str) -> DataFrame:
    """The columns, and the event time with its watermark, and its slot, if there is one. Rows
    without a time are in a slot before all others."""
    if time is None:
        return calls.select(*columns)
    length = slot_of(time, slot)
    number = F.floor(F.unix_millis(time) / length).cast("bigint")
    number = F.coalesce(number, F.lit(-(2**63) // length).cast("bigint"))
    calls = calls.withWatermark(time, late)
    return calls.select(*columns, F.col(time).alias("event_time"), number.alias("slot"))


def flow_counts_stream(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session", "pid").agg(F.count(F.lit(1)).alias("calls"))


class PendingCalls(InTimeOrder):
    """Unfinished calls of one (session, pid, fn), resumed last in first out.

    Pending calls are a map state, so a process with very many of them does not
    become one value.
    """

    takes = "seq bigint, args array<string>, status string"
    gives = ["session", "pid", "fn", "seq", "partner_seq", "args", "status"]

    def __init__(self, slot_ms: int | None, wait_ms: int | None):
        super().__init__(slot_ms)
        self._wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._depth = handle.getValueState("depth", "n int")
        self._calls = handle.getMapState("calls", "level int", "seq bigint, args array<string>")

    def begin(self) -> None:
        held = self._depth.get()
        # Calls that were pending before stay in state, those that begin now are a list.
        self._before, self._begun = 0 if held is None else held[0], []

    def settle(self, key, rows, timerValues):
        out = []
        for seq, args, status in rows:
            seq, args = int(seq), list(args)
            if status == "unfinished":
                self._begun.append((seq, args))
                out.append((*key, seq, None, args, "unfinished"))
                continue
            if self._begun:
                call, before = self._begun.pop()
            elif self._before:
                call, before = self._calls.getValue((self._before,))
                self._calls.removeKey((self._before,))
                self._before -= 1
            else:
                out.append((*key, seq, None, args, "resumed"))
                continue
            out.append((*key, int(call), seq, list(before), "matched"))
            out.append((*key, seq, int(call), list(before) + args, "merged"))
        return out

    def finish(self, key, timerValues):
        for level, call in enumerate(self._begun, self._before + 1):
            self._calls.updateValue((level,), call)
        depth = self._before + len(self._begun)
        self._depth.update((depth,))
        if depth and self._wait_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            self._handle.registerTimer(now + self._wait_ms)
        return []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._wait_ms is None:
            yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
            return
        self._calls.clear()
        self._depth.update((0,))
        yield self._frame([])


def match_interrupted_stream(
    calls: DataFrame,
    wait_ms: int | None = None,
    time: str | None = None,
    late: str = "10 minutes",
    slot: str = "1 hour",
) -> DataFrame:
    """Halves of interrupted calls of a live log, joined; see ``PendingCalls``.

    A call is given out as ``unfinished`` when it begins and once more as
    ``matched`` when it is resumed, so nothing is held back at the end of a run;
    ``settled_halves`` keeps the last row of each. With ``wait_ms`` calls not
    resumed in that time are forgotten, and the query keeps waking up for that. With ``time``
    calls are taken in the order of the log (``InTimeOrder``), instead of that.
    """
    if time is not None and wait_ms is not None:
        raise ValueError("calls are taken by event time or forgotten by processing time, not both")
    halves = in_time(calls, time, late, slot, "session", "pid", "fn", "seq", "args", "status")
    halves = halves.where(F.col("status").isin("unfinished", "resumed") | F.col("seq").isNull())
    return halves.groupBy("session", "pid", "fn").transformWithStateInPandas(
        statefulProcessor=PendingCalls(slot_of(time, slot), wait_ms),
        outputStructType=MATCHED,
        outputMode="Append",
        timeMode="EventTime" if time else "None" if wait_ms is None else "ProcessingTime",
    )


def settled_halves(rows: DataFrame) -> DataFrame:
    """One row for each half that ``match_interrupted_stream`` gave out."""
    last = F.max_by(F.struct("partner_seq", "args", "status"), F.col("partner_seq").isNotNull())
    return rows.groupBy("session", "pid", "fn", "seq").agg(last.alias("x")).select(
        "session", "pid", "fn", "seq", "x.*"
    )


RUNS = (
    "session string, pid bigint, seq bigint, fn string, sig array<string>, occurrences bigint, "
    "last_seq bigint"
)


class OpenRun(InTimeOrder):
    """The run of equal calls one flow is in; a run is given out when it ends and with every batch, or timer, that leaves it open."""

    takes = "seq bigint, fn string, sig array<string>"
    gives = ["session", "pid", "seq", "fn", "sig", "occurrences", "last_seq"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._run = handle.getValueState(
            "run", "seq bigint, fn string, sig array<string>, n bigint, last bigint"
        )

    def begin(self) -> None:
        held = self._run.get()
        self._open = None if held is None else list(held)

    def settle(self, key, rows, timerValues):
        run, out = self._open, []
        for seq, fn, sig in rows:
            seq, sig = int(seq), list(sig)
            if run and run[1] == fn and list(run[2]) == sig and fn not in NEVER_EQUAL:
                run[3], run[4] = run[3] + 1, seq
            else:
                if run:
                    out.append((*key, *run))
                run = [seq, fn, sig, 1, seq]
        self._open = run
        return out

    def finish(self, key, timerValues):
        if not self._open:
            return []
        self._run.update(tuple(self._open))
        return [(*key, *self._open)]


def squeeze_stream(
    calls: DataFrame, time: str | None = None, late: str = "10 minutes", slot: str = "1 hour"
) -> DataFrame:
    """Runs of equal calls of a live log; see ``OpenRun``. The row of a run with the most
    ``occurrences`` is its last one (``settled_runs``). With ``time`` calls are taken in the
    order of the log (``InTimeOrder``)."""
    return (
        in_time(calls, time, late, slot, "session", "pid", "seq", "fn", "sig")
        .groupBy("session", "pid")
        .transformWithStateInPandas(
            statefulProcessor=OpenRun(slot_of(time, slot)),
            outputStructType=RUNS,
            outputMode="Append",
            timeMode="EventTime" if time else "None",
        )
    )


def settled_runs(rows: DataFrame) -> DataFrame:
    """One row for each run that ``squeeze_stream`` gave out."""
    last = F.max_by(F.struct("fn", "sig", "occurrences", "last_seq"), "occurrences")
    return rows.groupBy("session", "pid", "seq").agg(last.alias("x")).select(
        "session", "pid", "seq", "x.*"
    )


LATEST = "object string, attribute string, value string, seq bigint"


class LatestValue(InTimeOrder):
    """The last value of one attribute of an object; changes are given out."""

    takes = "seq bigint, value string"
    gives = ["object", "attribute", "value", "seq"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._last = handle.getValueState("last", "value string")

    def begin(self) -> None:
        self._known = self._last.get()

    def settle(self, key, rows, timerValues):
        out = []
        for seq, value in rows:
            if self._known is None or value != self._known[0]:
                out.append((*key, value, int(seq)))
                self._known = (value,)
        return out

    def finish(self, key, timerValues):
        if self._known is not None:
            self._last.update(tuple(self._known))
        return []


def changes_stream(
    facts: DataFrame, time: str | None = None, late: str = "10 minutes", slot: str = "1 hour"
) -> DataFrame:
    """(object, attribute, value, seq) rows that tell something new. With ``time`` rows
    are taken in order (``InTimeOrder``)."""
    return (
        in_time(facts, time, late, slot, "object", "attribute", "value", "seq")
        .groupBy("object", "attribute")
        .transformWithStateInPandas(
            statefulProcessor=LatestValue(slot_of(time, slot)),
            outputStructType=LATEST,
            outputMode="Append",
            timeMode="EventTime" if time else "None",
        )
    )


def standing_match(stream: DataFrame, static: DataFrame, live, patterns) -> DataFrame:
    """Solutions of a pattern whose triple ``live`` streams and the rest is a table."""
    subjects = {p[0][1:] for p in [live, *patterns] if str(p[0]).startswith("?")}
    moving = solve_one(stream, live, subjects, False)
    known = match(static, patterns)
    shared = [v for v in variables([live]) if v in known.columns]
    if not shared:
        raise ValueError("the live pattern shares no variable with the others")
    names = variables([live, *patterns])
    return moving.join(known, shared).select(*names)


def standing_pair(
    one: DataFrame,
    first,
    two: DataFrame,
    second,
    within: str,
    late: str = "10 minutes",
    static: DataFrame | None = None,
    patterns=(),
) -> DataFrame:
    """Solutions of two patterns that both stream, and of ``patterns`` over a table.

    ``one`` and ``two`` are streams of triples with their time ``ts``. The triple of
    ``second`` has to come at the time of ``first``'s or up to ``within`` later; the
    times are the columns ``first_ts`` and ``second_ts``. Both sides have a watermark, so
    triples whose time to meet has passed leave the state. A null never equals anything;
    repeated triples repeat their solutions.
    """
    subjects = {p[0][1:] for p in [first, second, *patterns] if str(p[0]).startswith("?")}
    left = solve_one(one.withWatermark("ts", late), first, subjects, False, {"ts": "first_ts"})
    right = solve_one(two.withWatermark("ts", late), second, subjects, False, {"ts": "second_ts"})
    shared = [c for c in left.columns if c in right.columns]
    if not [c for c in shared if not c.endswith("__kind")]:
        raise ValueError("the two live patterns share no variable")
    right = right.select(*(F.col(c).alias(f"{c}__right" if c in shared else c) for c in right.columns))
    met = F.expr(f"second_ts >= first_ts and second_ts <= first_ts + interval {within}")
    for c in shared:
        met = met & (F.col(c) == F.col(f"{c}__right"))
    found = left.join(right, met)
    names = variables([first, second])
    if static is not None:
        known = match(static, patterns)
        both = [v for v in names if v in known.columns]
        if not both:
            raise ValueError("the live patterns share no variable with the others")
        found = found.join(known, both)
        names = variables([first, second, *patterns])
    return found.select(*names, "first_ts", "second_ts")
