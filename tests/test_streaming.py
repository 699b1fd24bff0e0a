"""Streams against their batch twins."""

import glob
import os
import random

import pytest

from pyspark.sql import functions as F

from sysweave.model import TRIPLE_SCHEMA
from sysweave.operators import calls as c
from sysweave.operators.flows import squeeze_repeats
from sysweave.operators.objects import changes_only
from sysweave.sources.trace import parse_lines, split_args
from sysweave.streaming import events as ev
from sysweave.streaming import samples as st
from sysweave.streaming import trace as live
from sysweave.streaming.run import run_to_end


def as_stream(spark, df, tmp_path, name, files=3):
    path = str(tmp_path / name)
    df.repartitionByRange(files, *df.columns[:2]).write.parquet(path)
    # A stream takes the oldest files first: give them the order of their rows.
    for n, file in enumerate(sorted(glob.glob(f"{path}/part-*.parquet"))):
        os.utime(file, (1_700_000_000 + 10 * n, 1_700_000_000 + 10 * n))
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    )


def run(spark, stream, tmp_path, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"{name}-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    return spark.table(name)


def key(row):
    return tuple(map(str, row))


def test_trace_stream(spark, tmp_path):
    lines = spark.createDataFrame(
        [("s", n, f"[pid {n % 3}] 10:00:00.{n:06d} read({n}</f{n % 4}>, \"x\", 9) = 9 <0.1>") for n in range(30)]
        + [("s", 31, "[pid 1] 10:00:01.000000 brk(NULL) = 0 <0.1>")],
        "session string, seq bigint, line string",
    )
    stream = live.trace_stream(as_stream(spark, lines, tmp_path, "lines"))
    got = run(spark, stream.select("seq", "pid", "fn", "sig"), tmp_path, "t_trace").collect()
    batch = c.significant_args(c.drop_ignored(split_args(parse_lines(lines)))).select("seq", "pid", "fn", "sig")
    assert sorted(map(key, got)) == sorted(map(key, batch.collect()))
    counts = run(spark, live.flow_counts_stream(live.trace_stream(as_stream(spark, lines, tmp_path, "l2"))), tmp_path, "t_counts", "complete")
    assert {(r.pid, r.calls) for r in counts.collect()} == {(0, 10), (1, 10), (2, 10)}


def test_interrupted_stream(spark, tmp_path):
    rnd = random.Random(3)
    data = [
        ("s", n, n % 2, "read@SYS", [str(n)], rnd.choice(["unfinished", "resumed"])) for n in range(60)
    ]
    df = spark.createDataFrame(
        data, "session string, seq bigint, pid bigint, fn string, args array<string>, status string"
    )
    stream = live.match_interrupted_stream(as_stream(spark, df, tmp_path, "halves"))
    got = live.settled_halves(run(spark, stream, tmp_path, "t_halves")).collect()
    batch = c.match_interrupted(df).collect()
    assert sorted((r.seq, r.status, str(r.partner_seq), tuple(r.args)) for r in got) == sorted(
        (r.seq, r.status, str(r.partner_seq), tuple(r.args)) for r in batch
    )


def test_squeeze_stream(spark, tmp_path):
    rnd = random.Random(6)
    data = [("s", n % 2, n, rnd.choice(["f", "g", "clone@SYS"]), [rnd.choice("xy")], "t", "t") for n in range(80)]
    df = spark.createDataFrame(
        data, "session string, pid bigint, seq bigint, fn string, sig array<string>, t_start string, t_end string"
    ).select("session", "seq", "pid", "fn", "sig", "t_start", "t_end")
    stream = live.squeeze_stream(as_stream(spark, df, tmp_path, "calls"))
    got = live.settled_runs(run(spark, stream, tmp_path, "t_runs")).collect()
    batch = squeeze_repeats(df).collect()
    assert sorted((r.pid, r.seq, r.fn, r.occurrences) for r in got) == sorted(
        (r.pid, r.seq, r.fn, r.occurrences) for r in batch
    )


def test_calls_nobody_resumes_are_given_out(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", 1, 7, "read@SYS", ["3"], "unfinished")],
        "session string, seq bigint, pid bigint, fn string, args array<string>, status string",
    )
    stream = live.match_interrupted_stream(as_stream(spark, df, tmp_path, "late", 1), wait_ms=1)
    query = (
        stream.writeStream.format("memory").queryName("t_late").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "late-ckpt")).start()
    )
    try:
        for _ in range(60):
            if query.awaitTermination(1) or spark.table("t_late").count():
                break
    finally:
        query.stop()
    assert [(r.seq, r.status) for r in spark.table("t_late").collect()] == [(1, "unfinished")]


def test_changes_stream(spark, tmp_path):
    rnd = random.Random(4)
    data = [("x" if n % 3 else "y", n, "c", "a", rnd.choice("pq")) for n in range(40)]
    df = spark.createDataFrame(data, "object string, seq bigint, cls string, attribute string, value string")
    got = run(spark, live.changes_stream(as_stream(spark, df, tmp_path, "facts")), tmp_path, "t_changes").collect()
    batch = changes_only(df).where("o_kind = 'lit'").collect()
    assert sorted((r.object, r.value, r.seq) for r in got) == sorted((r.s, r.o, r.seq) for r in batch)


def test_rollup_stream(spark, tmp_path):
    base = 1_700_000_000
    df = spark.createDataFrame(
        [("h", base + 60 * n, float(n)) for n in range(90)], "object string, at bigint, load double"
    ).withColumn("ts", F.timestamp_seconds("at"))
    samples = st.sample_stream(as_stream(spark, df, tmp_path, "counters"), "vm", ["load"])
    got = run(spark, st.sample_rollup(samples, "10 minutes", late="1 minute"), tmp_path, "t_roll").collect()
    batch = st.sample_rollup(st.sample_stream(df, "vm", ["load"]), "10 minutes").collect()
    # Windows the watermark has closed; the newest ones are still open.
    assert set(map(key, got)) <= set(map(key, batch))
    assert len(got) >= len(batch) - 2


def triples_of(spark, names, ctx):
    return spark.createDataFrame([(n, "p", "1", "lit", "string", ctx) for n in names], TRIPLE_SCHEMA)


def test_event_store(spark, tmp_path):
    store = str(tmp_path / "store")
    first = triples_of(spark, ["a", "b", "a"], "c1").unionByName(triples_of(spark, ["a"], "c2"))
    ev.append_batch(first, store, 0)
    ev.append_batch(triples_of(spark, ["b", "d"], "c1"), store, 1)
    ev.append_batch(triples_of(spark, ["b", "d"], "c1"), store, 1)  # the same batch again
    table = ev.stored(spark, store)
    assert {(r.ctx, r.events, r.total) for r in ev.event_counts(table).collect()} == {
        ("c1", 3, False), ("c2", 1, False), (None, 3, True),
    }
    assert sorted(r.s for r in ev.drain(table, ctx="c1").collect()) == ["a", "b", "d"]
    mark = ev.high_mark(table).first().seen
    assert ev.drain(table, seen=mark, ctx="c1").isEmpty()
    assert sorted(r.s for r in ev.drain(table, seen=0, ctx="c1").collect()) == ["d"]
    assert sorted(r.s for r in ev.drain(table, every=True).collect()) == ["a", "b", "d"]
    ev.clear_events(spark, store)
    assert ev.stored(spark, store).isEmpty()


def test_append_stream_and_drain_stream(spark, tmp_path):
    rows = triples_of(spark, [f"n{i % 7}" for i in range(20)], None)
    query = ev.append_events(
        as_stream(spark, rows, tmp_path, "feed"), str(tmp_path / "events"), str(tmp_path / "ck")
    )
    assert query.awaitTermination(90)
    assert ev.stored(spark, str(tmp_path / "events")).count() == 7
    seen = run(spark, ev.drain_stream(spark, str(tmp_path / "events")).select("s"), tmp_path, "t_drain")
    assert seen.count() == 7


def test_standing_match(spark, tmp_path):
    moving = spark.createDataFrame(
        [(f"u{n % 4}", "did", str(n), "lit", "string", None) for n in range(12)], TRIPLE_SCHEMA
    )
    static = spark.createDataFrame(
        [("u1", "in", "g1", "uri", None, None), ("u2", "in", "g2", "uri", None, None)], TRIPLE_SCHEMA
    )
    joined = live.standing_match(
        as_stream(spark, moving, tmp_path, "moving"), static, ("?u", "did", "?k"), [("?u", "in", "?g")]
    )
    got = run(spark, joined, tmp_path, "t_stand").collect()
    assert sorted((r.u, r.k, r.g) for r in got) == sorted(
        (f"u{n % 4}", str(n), f"g{n % 4}") for n in range(12) if n % 4 in (1, 2)
    )


def test_tick(spark):
    assert st.tick(spark).isStreaming


def in_files(df, tmp_path, name, order, n=6):
    """``df`` as a stream of one file a batch; ``order`` sorts the slices of time."""
    import os

    folder = tmp_path / name
    rows = df.orderBy("seq").collect()
    size = -(-len(rows) // n)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    for place, i in enumerate(order(range(len(parts)))):
        path = folder / f"part-{i}"
        df.sparkSession.createDataFrame(parts[i], df.schema).coalesce(1).write.parquet(str(path))
        for f in path.iterdir():
            os.utime(f, (1_700_000_000 + 60 * place, 1_700_000_000 + 60 * place))
    files = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return files.option("recursiveFileLookup", "true").parquet(str(folder))


def shuffled(numbers):
    numbers = list(numbers)
    random.Random(8).shuffle(numbers)
    assert numbers != sorted(numbers)
    return numbers


def with_time(df):
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60))


def test_streams_in_event_time_order(spark, tmp_path):
    """Files out of order, one a batch, give what the batch operators give on all rows."""
    rnd = random.Random(5)
    data = [("s", n % 3 and 1, n, rnd.choice(["f", "g", "clone@SYS"]), [rnd.choice("xy")], "t", "t") for n in range(150)]
    calls = spark.createDataFrame(
        data, "session string, pid bigint, seq bigint, fn string, sig array<string>, t_start string, t_end string"
    )
    stream = in_files(with_time(calls), tmp_path, "calls", shuffled)
    rows = run_to_end(stream, "ts", lambda e: live.squeeze_stream(e, "ts", "3 hours", "7 minutes"))
    got = live.settled_runs(rows).collect()
    assert sorted((r.pid, r.seq, r.fn, r.occurrences) for r in got) == sorted(
        (r.pid, r.seq, r.fn, r.occurrences) for r in squeeze_repeats(calls).collect()
    )

    data = [("s", n, n % 2, "read@SYS", [str(n)], rnd.choice(["unfinished", "resumed"])) for n in range(120)]
    halves = spark.createDataFrame(
        data, "session string, seq bigint, pid bigint, fn string, args array<string>, status string"
    )
    stream = in_files(with_time(halves), tmp_path, "halves", shuffled)
    rows = run_to_end(
        stream, "ts", lambda e: live.match_interrupted_stream(e, time="ts", late="3 hours", slot="11 minutes")
    )
    got = live.settled_halves(rows).collect()
    assert sorted((r.seq, r.status, str(r.partner_seq), tuple(r.args)) for r in got) == sorted(
        (r.seq, r.status, str(r.partner_seq), tuple(r.args)) for r in c.match_interrupted(halves).collect()
    )

    data = [("x" if n % 3 else "y", n, "c", "a", rnd.choice("pq")) for n in range(90)]
    facts = spark.createDataFrame(data, "object string, seq bigint, cls string, attribute string, value string")
    stream = in_files(with_time(facts), tmp_path, "facts", shuffled)
    got = run_to_end(stream, "ts", lambda e: live.changes_stream(e, "ts", "3 hours", "5 minutes")).collect()
    batch = changes_only(facts).where("o_kind = 'lit'").collect()
    assert sorted((r.object, r.value, r.seq) for r in got) == sorted((r.s, r.o, r.seq) for r in batch)


def test_a_slot_at_a_time(spark, tmp_path, monkeypatch):
    """Rows leave state by slots: what one call of ``settle`` gets is a slot of a key at most."""

    class Watched(live.InTimeOrder):
        takes = "seq bigint, value string"
        gives = ["object", "attribute", "value", "seq"]

        def settle(self, key, rows, timerValues):
            rows = list(rows)
            return [(*key, str(len(rows)), int(rows[0][0]))]

    monkeypatch.setattr(live, "LatestValue", Watched)
    data = [("one", n, "a", "v") for n in range(200)]
    facts = spark.createDataFrame(data, "object string, seq bigint, attribute string, value string")
    stream = in_files(with_time(facts), tmp_path, "slots", sorted, n=2)
    rows = run_to_end(stream, "ts", lambda e: live.changes_stream(e, "ts", "1 minute", "10 minutes")).collect()
    seen = [int(r.value) for r in rows]
    assert sum(seen) == 200 and max(seen) <= 10


def test_two_live_patterns(spark, tmp_path):
    """Both sides stream, a file a batch; what can meet no more leaves the state."""
    rnd = random.Random(9)
    data = [(f"u{rnd.randrange(5)}", rnd.choice(["sees", "buys"]), str(n), "lit", "string", n) for n in range(240)]
    data += [(None, "sees", "1", "lit", "string", 3), ("u1", "sees", None, "lit", "string", 4)]
    facts = with_time(spark.createDataFrame(data, "s string, p string, o string, o_kind string, o_type string, seq bigint"))
    static = spark.createDataFrame([(f"u{i}", "in", f"g{i}", "uri", None, None) for i in range(4)], TRIPLE_SCHEMA)
    stream = in_files(facts, tmp_path, "facts", sorted, n=8)
    pair = live.standing_pair(
        stream, ("?u", "sees", "?x"), stream, ("?u", "buys", "?y"), "5 minutes", "2 minutes", static, [("?u", "in", "?g")]
    )
    query = (
        pair.writeStream.format("memory").queryName("t_pair").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "pair-ckpt")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    want = sorted(
        (a[0], a[2], b[2], "g" + a[0][1:])
        for a in data for b in data
        if a[0] and a[0] == b[0] != "u4" and a[1] == "sees" and b[1] == "buys" and a[2] and 0 <= b[5] - a[5] <= 5
    )
    assert sorted((r.u, r.x, r.y, r.g) for r in spark.table("t_pair").collect()) == want and want
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) < 120 and held[-1] < 40
    with pytest.raises(ValueError):
        live.standing_pair(stream, ("?u", "sees", "?x"), stream, ("?w", "buys", "?y"), "5 minutes")


def test_a_key_of_few_rows_is_one_entry(spark, tmp_path):
    """State grows with the keys, not with the slots their rows are in."""
    data = [(f"o{n % 10}", n, "a", str(n // 70)) for n in range(400)]
    facts = spark.createDataFrame(data, "object string, seq bigint, attribute string, value string")
    stream = in_files(with_time(facts), tmp_path, "few", sorted, n=2)
    query = (
        live.changes_stream(stream, "ts", "1 day", "10 minutes").writeStream.format("memory").queryName("t_few")
        .option("checkpointLocation", str(tmp_path / "few-ckpt")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert 10 <= max(held) <= 60


def test_keys_of_few_and_of_many_rows(spark, tmp_path):
    """A key with more rows than wait together gives what the others give."""
    rnd = random.Random(11)
    few = live.FEW
    data = [("x" if n % 9 else "y", n, "c", "a", rnd.choice("pq")) for n in range(2 * few)]
    facts = spark.createDataFrame(data, "object string, seq bigint, cls string, attribute string, value string")
    stream = in_files(with_time(facts), tmp_path, "facts", shuffled, n=4)
    got = run_to_end(stream, "ts", lambda e: live.changes_stream(e, "ts", "5 days", "2 hours")).collect()
    batch = changes_only(facts).where("o_kind = 'lit'").collect()
    assert sorted((r.object, r.value, r.seq) for r in got) == sorted((r.s, r.o, r.seq) for r in batch)
