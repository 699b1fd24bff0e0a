import hashlib
import re
import zlib

import pytest

from sysweave.llm import periodic

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=6, times=4):
    """(start, length, period) of all runs, period by period."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            smaller = any(q % d == 0 and w[i : i + size - d] == w[i + d : i + size] for d in range(1, q))
            if size >= max(least, times * q) and not smaller:
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def got_runs(row):
    return list(zip(row["starts"], row["lengths"], row["periods"], strict=True))


def made(rng):
    rows = []
    for n in range(400):
        w = [rng.choice("ab" if n % 2 else "abcdef") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            root = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
            w += (root * rng.randint(2, 9))[: rng.randint(1, 90)]
            w += [rng.choice("abcdef") for _ in range(rng.randint(0, 5))]
        rows.append(" ".join(w))
    return list(enumerate(rows))


@pytest.mark.parametrize("least,times", [(6, 4), (1, 3), (20, 5)])
def test_against_every_period(spark, rng, least, times):
    rows = made(rng)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in periodic.periodic_runs(df, least, times).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = plain_words(text)
        want = plain_runs(w, least, times)
        assert got_runs(got[i]) == want, text
        assert got[i]["n_words"] == len(w)
        assert got[i]["collapsed"] == collapsed(w, want)


def test_under_three_periods_is_refused(spark):
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 2, 2)


def test_query(spark):
    """Planting, runs and digests of the given documents, in plain Python."""
    got = {r["doc_id"]: r.asDict() for r in periodic.op12_periodic(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for i, text in rows:
        w = plain_words(text)
        if len(w) > 3000:
            continue
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
            planted += 1
        runs = plain_runs(w)
        best = None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        start, length, period = best or (None, None, None)
        assert got[i] == {
            "doc_id": i,
            "n_runs": len(runs),
            "start": start,
            "length": length,
            "period": period,
            "exponent_milli": best and 1000 * length // period,
            "runs_sha256": sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)),
            "collapsed_sha256": sha(collapsed(w, runs)),
        }
    assert planted > 5


def test_ties_go_to_the_first(spark):
    text = " ".join(["a"] * 8 + ["b"] + ["c"] * 8 + ["x"] + ["d", "e"] * 8)
    df = spark.createDataFrame([(3, text), (3, text), (4, None), (None, "")], "doc_id long, text string")
    rows = periodic.digests(periodic.periodic_runs(df)).collect()
    assert [(r["start"], r["length"], r["period"], r["n_runs"]) for r in rows if r["doc_id"] == 3] == [(0, 8, 1, 3)] * 2
    assert [(r["start"], r["exponent_milli"], r["n_runs"]) for r in rows if r["doc_id"] != 3] == [(None, None, 0)] * 2
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["runs_sha256"], r["collapsed_sha256"]) for r in rows if r["doc_id"] != 3} == {(empty, empty)}


def test_odd_documents(spark, odd_documents):
    got = periodic.digests(periodic.periodic_runs(odd_documents)).collect()
    assert len(got) == odd_documents.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_runs"] == 0 and by[i]["start"] is None for i in (1, 2, 3, 4, 7, 8, None))
    assert (by[6]["start"], by[6]["length"], by[6]["period"]) == (0, 100, 5)
    assert periodic.digests(periodic.periodic_runs(odd_documents.limit(0))).collect() == []
    assert len(periodic.digests(periodic.periodic_runs(periodic.with_periods(odd_documents))).collect()) == len(got)


def test_a_very_long_run(spark):
    text = "u v w " * 300_000 + "end"
    (row,) = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got_runs(row) == [(0, 900_000, 3)] and row["collapsed"] == "u v w end"
