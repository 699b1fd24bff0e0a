"""Piecewise scans against plain Python over whole flows."""

import random

from pyspark.sql import functions as F

from sysweave.operators.ordered import islands, numbered, scan, with_pieces


def rows(seed, n=120, flows=3):
    rnd = random.Random(seed)
    seqs = rnd.sample(range(n * 4), n)
    return [
        (rnd.randrange(flows), s, rnd.choice([None, "a", "b"]), rnd.choice([1, -1])) for s in seqs
    ]


def test_scan_matches_whole_flow(spark, small_pieces):
    data = rows(1)
    df = spark.createDataFrame(data, "k int, seq bigint, v string, d int")
    got = {
        (r.k, r.seq): r
        for r in scan(
            df,
            ["k"],
            previous={"prev": F.col("v")},
            following={"next": F.col("seq")},
            sums={"run": F.col("d")},
            last={"last": F.col("v")},
            last_before={"before": F.col("v")},
            depth={"depth": F.col("d")},
        ).collect()
    }
    assert len(got) == len(data)
    for k in range(3):
        flow = sorted([r for r in data if r[0] == k], key=lambda r: r[1])
        run = depth = 0
        last = prev = None
        for i, (_, seq, v, d) in enumerate(flow):
            run += d
            r = got[(k, seq)]
            assert r.depth_before == depth
            depth = max(0, depth + d)
            assert r.prev == prev
            assert r.next == (flow[i + 1][1] if i + 1 < len(flow) else None)
            assert r.run == run
            assert r.depth == depth
            assert r.before == last
            last = v if v is not None else last
            assert r["last"] == last
            prev = v


def test_islands(spark, small_pieces):
    data = rows(2)
    df = spark.createDataFrame(data, "k int, seq bigint, v string, d int")
    got = {(r.k, r.seq): r.island for r in islands(df, ["k"], {"v": F.col("v")}).collect()}
    for k in range(3):
        flow = sorted([r for r in data if r[0] == k], key=lambda r: r[1])
        number, was = 0, object()
        for _, seq, v, _ in flow:
            number += v != was
            was = v
            assert got[(k, seq)] == number


def test_pieces_are_bounded(spark, small_pieces):
    """No window partition of a scan holds more rows than a piece."""
    df = spark.range(100).select(F.lit(0).alias("k"), F.col("id").alias("seq"))
    out = scan(df, ["k"], sums={"n": F.lit(1)}, keep_piece=True)
    assert out.groupBy("_piece").count().agg(F.max("count")).first()[0] <= 5
    assert out.agg(F.max("n")).first()[0] == 100


def spread_numbers():
    """Flows whose numbers are even, clustered, doubling, negative, and few."""
    rnd = random.Random(3)
    flows = {
        "even": [i * 10**9 + i * i % 997 for i in range(300)],
        "clusters": [c + i for c in (0, 10**15, 10**15 + 10**6) for i in range(90)],
        "doubling": [2**i for i in range(61)],
        "negative": rnd.sample(range(-(10**17), 10**17), 200),
        "few": [5, 10**18],
    }
    rows = [(k, s, rnd.choice(["a", "b"])) for k, numbers in flows.items() for s in numbers]
    rnd.shuffle(rows)
    return flows, rows


def test_pieces_by_rows(spark):
    flows, rows = spread_numbers()
    df = spark.createDataFrame(rows, "k string, seq bigint, v string")
    got = with_pieces(df, ["k"], chunk=10).collect()
    assert sorted((r.k, r.seq, r.v) for r in got) == sorted(rows)
    for k, numbers in flows.items():
        pieces = {}
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.seq):
            pieces.setdefault(r["_piece"], []).append(r.seq)
        assert max(map(len, pieces.values())) <= 20
        # A piece for each chunk and round, where even numbers and clusters take few, and
        # pieces follow each other.
        assert len(pieces) <= (len(numbers) if k == "doubling" else max(1, 4 * len(numbers) / 10))
        ends = [(p, min(s), max(s)) for p, s in sorted(pieces.items())]
        assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


def test_sparse_numbers_change_nothing(spark):
    flows, rows = spread_numbers()
    df = spark.createDataFrame(rows, "k string, seq bigint, v string")
    got = {(r.k, r.was): r.seq for r in numbered(df, ["k"], was="was", chunk=10).collect()}
    want = {(k, s): i for k, numbers in flows.items() for i, s in enumerate(sorted(numbers))}
    assert got == want
    by_rows = islands(with_pieces(df, ["k"], chunk=10), ["k"], {"v": F.col("v")}).collect()
    dense = islands(numbered(df, ["k"], was="was", chunk=10), ["k"], {"v": F.col("v")}, chunk=10)
    assert {(r.k, r.seq): r.island for r in by_rows} == {(r.k, r.was): r.island for r in dense.collect()}


def test_numbers_absent_or_shared(spark):
    df = spark.createDataFrame([(1, None)] * 30 + [(1, 7)] * 30, "k int, seq bigint")
    assert {r["_piece"] for r in with_pieces(df, ["k"], chunk=10).collect()} == {0}
    assert numbered(df.limit(0), ["k"]).collect() == []
    assert numbered(df.where("seq is null"), ["k"]).collect() == []
