import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sysweave.llm import negatives

ROWS = "vec_id long, label long, embedding array<float>"


def plain(rows, every=100, n_positives=5, n_negatives=10):
    """The rows FOUND, anchor by anchor in Python integers."""
    good = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good)  # noqa: B905
        first = [(j, -s) for s, j, m in scored if m == label and j != i][:n_positives]
        for j, p in first:
            window = [(k, -s) for s, k, m in scored if m != label and 30 * p <= -100 * s <= 90 * p]
            out += [(i, j, r + 1, k, p, s) for r, (k, s) in enumerate(window[:n_negatives])]
    return sorted(out)


def made(rng, n, dims, scale=1.0):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[rng.randrange(6)]
        rows.append((i, rng.randrange(3), [scale * (x + rng.gauss(0, 0.7)) / dims**0.5 for x in c]))
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("dims,scale", [(1, 1.0), (16, 1.0), (40, 3000.0), (3, 1e6)])
def test_against_integers(spark, rng, dims, scale, monkeypatch):
    monkeypatch.setattr(negatives, "PACK_ROWS", 37)
    rows = made(rng, 300, dims, scale)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    want = plain(rows, 20)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)) == want
    assert want


def test_many_groups_of_anchors(spark, rng, monkeypatch):
    monkeypatch.setattr(negatives, "PACK_ROWS", 16)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 300)
    rows = made(rng, 200, 8)
    df = spark.createDataFrame(rows, ROWS).repartition(2)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)) == plain(rows, 10)


def test_ties_and_copies(spark, rng):
    """A third of all rows is one vector; equal scores go by the smaller id."""
    rows = made(rng, 200, 6)
    rows = [(i, m, rows[0][2] if i % 3 == 0 else v) for i, m, v in rows]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 25 == 0)) == plain(rows, 25)


def test_odd_rows(spark, rng):
    rows = made(rng, 120, 4)
    rows += [(None, 1, rows[5][2]), (100, None, rows[6][2]), (200, 1, None), (300, 1, [1.0, None, 0.0, 0.0])]
    rows += [(400, 1, [float("nan")] * 4), (500, 2, [float("inf")] * 4), (600, 1, []), (700, 1, [0.5]), (7, 2, rows[8][2])]
    rows += [rows[0], rows[0], rows[21]]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as key", "2 as n", "3 as rank").repartition(3)
    padded = [(i, m, v if v is None else v + [0.0] * (4 - len(v))) for i, m, v in rows]
    assert got(negatives.hard_negatives(df)) == plain(padded)
    assert got(negatives.hard_negatives(df.limit(0))) == []
    assert got(negatives.hard_negatives(df.where("vec_id % 100 <> 0"))) == []
    huge = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30])], ROWS)
    with pytest.raises(OverflowError):
        negatives.hard_negatives(huge)


def test_scores_are_exact(rng):
    """Products of residues put together, next to Python's integers."""
    for dims, top in ((1, 10), (64, 200), (64, 2**28), (5000, 2**20), (9000, 3)):
        x, y = (np.array([[rng.randint(-top, top) for _ in range(dims)] for _ in range(n)]) for n in (4, 5))
        bound = int(max((m.astype(float) ** 2).sum(1).max() for m in (x, y))) + 1
        primes = negatives.primes_for(dims, bound)
        found = negatives.scores(negatives.residues(x, primes), negatives.residues(y, primes), primes)
        assert found.tolist() == [[sum(a * b for a, b in zip(r, s, strict=True)) for s in y.tolist()] for r in x.tolist()]
        assert len(primes) > 1


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, (m + 1) % 10 if i % 7 == 0 else m, v) for i, m, v in rows]
    assert got(negatives.op13_negatives(spark, sf)) == plain(rows)
