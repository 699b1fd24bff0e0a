"""Flow steps against naive Python over lists, on random flows cut into small pieces."""

import json
import random
from collections import Counter

import pytest

from sysweave.operators import calls as c
from sysweave.operators import flows as f


def random_calls(seed, n=90, flows=2, fns="abc", args="xy"):
    rnd = random.Random(seed)
    out = []
    for seq in sorted(rnd.sample(range(n * 3), n)):
        out.append(("s", rnd.randrange(flows), seq, rnd.choice(fns), [rnd.choice(args)] if args else [], "t", "t"))
    return out


SCHEMA = "session string, pid bigint, seq bigint, fn string, sig array<string>, t_start string, t_end string"


def by_pid(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_interrupted_calls_are_a_stack(spark, small_pieces, seed):
    rnd = random.Random(seed)
    data = []
    for seq in sorted(rnd.sample(range(800), 250)):
        status = rnd.choice(["unfinished", "resumed", "plain"])
        data.append(("s", rnd.randrange(2), seq, rnd.choice(["read@SYS", "wait4@SYS"]), [str(seq)], status))
    df = spark.createDataFrame(
        data, "session string, pid bigint, seq bigint, fn string, args array<string>, status string"
    )
    got = {r.seq: (r.status, r.partner_seq, r.args) for r in c.match_interrupted(df).collect()}
    want, stacks = {}, {}
    for _, pid, seq, fn, args, status in data:
        stack = stacks.setdefault((pid, fn), [])
        if status == "unfinished":
            stack.append(seq)
            want[seq] = ("unfinished", None, args)
        elif status == "resumed" and stack:
            call = stack.pop()
            want[call] = ("matched", seq, [str(call)])
            want[seq] = ("merged", call, [str(call), str(seq)])
        else:
            want[seq] = (status, None, args)
    assert got == want


def naive_squeeze(rows):
    out = []
    for r in rows:
        if out and out[-1][0] == (r[3], tuple(r[4])):
            out[-1][1] += 1
        else:
            out.append([(r[3], tuple(r[4])), 1])
    return [(k, n) for k, n in out]


def test_squeeze(spark, small_pieces):
    data = random_calls(3, fns="ab", args="x")
    got = f.squeeze_repeats(spark.createDataFrame(data, SCHEMA)).orderBy("pid", "seq").collect()
    for pid, rows in by_pid(data).items():
        mine = [((r.fn, tuple(r.sig)), r.occurrences) for r in got if r.pid == pid]
        assert mine == naive_squeeze(rows)


def test_creating_calls_never_merge(spark):
    data = [("s", 1, i, "clone@SYS", ["5"], "t", "t") for i in range(4)]
    assert f.squeeze_repeats(spark.createDataFrame(data, SCHEMA)).count() == 4


def naive_pass(items, least):
    """items: [fn, args, occurrences]; one left-to-right pass over frequent pairs."""
    def name(x):
        return x[0] + ":" + "&".join(x[1])

    counts = Counter((name(a), name(b)) for a, b in zip(items, items[1:]))
    out, i, changed, previous = [], 0, 0, None
    while i < len(items):
        pair = items[i : i + 2]
        if len(pair) == 2 and counts[(name(pair[0]), name(pair[1]))] > least:
            args = list(dict.fromkeys(pair[0][1] + pair[1][1]))
            made = ["(" + pair[0][0] + "+" + pair[1][0] + ")", args, 1]
            if previous and previous[:2] == made[:2]:
                previous[2] += 1
            else:
                out.append(made)
                previous = made
            i += 2
            changed += 1
        else:
            out.append(list(items[i]))
            previous = None
            i += 1
    return out, changed


@pytest.mark.parametrize("seed", [5, 6])
def test_bigram_clusters(spark, small_pieces, seed):
    data = random_calls(seed, n=120, flows=2, fns="ab", args="")
    got = f.cluster_bigrams(spark.createDataFrame(data, SCHEMA), min_count=3).orderBy("pid", "seq").collect()
    for pid, rows in by_pid(data).items():
        items = [[r[3], list(r[4]), 1] for r in rows]
        while True:
            items, changed = naive_pass(items, 3)
            if not changed:
                break
        mine = [[r.fn, list(r.sig), r.occurrences] for r in got if r.pid == pid]
        assert mine == items


def test_cluster_by_args_whatever_the_pieces(spark):
    data = [("s", 1, i, "fg"[i % 2], ["x"], f"a{i:02d}", f"b{i:02d}") for i in range(12)]
    data += [("s", 1, 20, "f", [], "t", "t"), ("s", 1, 21, "g", [], "t", "t"), ("s", 1, 22, "f", ["z"], "t", "t")]
    data += [(d[0], d[1] + 7, *d[2:]) for d in random_calls(9, n=60, flows=3)]
    df = spark.createDataFrame(data, SCHEMA)
    whole = sorted(f.cluster_by_args(df).collect(), key=lambda r: (r.pid, r.seq))
    for chunk in (3, 5):
        assert sorted(f.cluster_by_args(df, chunk).collect(), key=lambda r: (r.pid, r.seq)) == whole
    first = whole[0]
    assert (first.fn, first.calls) == ("(" + "+".join("fg" * 6) + ")", 12)
    assert (first.t_start, first.t_end) == ("a00", "b11")
    assert [(r.fn, r.style) for r in whole if r.pid == 1][1:] == [("f", "Orig"), ("g", "Orig"), ("f", "Orig")]


def test_duration_over_midnight(spark):
    from pyspark.sql import functions as F

    rows = [("2020-05-17 23:59:59.5", "2020-05-18 00:00:01.25")]
    df = spark.createDataFrame(rows, "a string, b string").select(
        F.col("a").cast("timestamp").alias("t_start"), F.col("b").cast("timestamp").alias("t_end")
    )
    assert f.sequence_duration(df).first().duration == 1.75


def naive_periods(symbols, longest):
    """Greedy tandem repeats, length by length, on [label, times] blocks."""
    level = [([s], 1) for s in symbols]

    def label(block):
        items, times = block
        if times == 1 and len(items) == 1:
            return items[0]
        return json.dumps(items, separators=(",", ":")) + f"*{times}"

    for k in range(1, longest + 1):
        labels, out, i = [label(b) for b in level], [], 0
        while i < len(labels):
            block, times = labels[i : i + k], 1
            while len(block) == k and labels[i + times * k : i + (times + 1) * k] == block:
                times += 1
            if times > 1:
                out.append((block, times))
                i += times * k
            else:
                out.append(([labels[i]], 1))
                i += 1
        level = out
    return level


@pytest.mark.parametrize("seed", [7, 8])
def test_periods(spark, small_pieces, seed):
    rnd = random.Random(seed)
    flows = {s: [rnd.choice("ab") for _ in range(40)] for s in range(4)}
    flows[9] = list("abcabcabcd") * 2
    data = [(s, i * 2, sym) for s, syms in flows.items() for i, sym in enumerate(syms)]
    df = spark.createDataFrame(data, "seq_id bigint, pos bigint, symbol string")
    levels = f.squeeze_levels(df, 3)
    got = levels[-1].orderBy("seq_id", "pos").collect()
    back = f.inflate(levels).orderBy("seq_id", "pos", "order").collect()
    for s, syms in flows.items():
        mine = [(list(r.block), r.times) for r in got if r.seq_id == s]
        assert mine == naive_periods(syms, 3)
        assert sum(r.width for r in got if r.seq_id == s) == len(syms)
        assert [r.symbol for r in back if r.seq_id == s] == syms


def test_principal_period(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("abab",), ("aaa",), ("abc",), ("a",)], "s string")
    got = [r.p for r in df.select(f.principal_period(F.col("s")).alias("p")).collect()]
    assert got == [2, 1, -1, -1]


def test_principal_periods_of_rows(spark, small_pieces):
    rnd = random.Random(17)
    flows = {}
    for i in range(60):
        root = [rnd.choice(["a", "b", None]) for _ in range(rnd.randint(1, 12))]
        flows[i] = (root * rnd.randint(1, 12))[: rnd.choice([10_000, 10_000, 17])]
    rows = [(k, 3 * j, x) for k, symbols in flows.items() for j, x in enumerate(symbols)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "flow bigint, seq bigint, symbol string")
    got = {r.flow: (r.n, r.period) for r in f.principal_periods(df, ["flow"], "seq", "symbol").collect()}
    for k, w in flows.items():
        turns = [d for d in range(1, len(w)) if w[d:] + w[:d] == w]
        assert got[k] == (len(w), turns[0] if turns else -1)
    assert f.principal_periods(df.limit(0), ["flow"], "seq", "symbol").isEmpty()
