import random
import re

from sysweave.llm import pii

KINDS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    twice = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in twice) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [
                True,
                all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True,
                14 <= len(digits) <= 19 and luhn(digits),
                10 <= len(digits) <= 15,
            ][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    for _ in range(30_000):
        text = "".join(rng.choice("0123456789..@a-  +()éA42") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("9" * 10**5, "@" * 10**5, "a@" * 10**5, "1." * 10**5, "+1" * 10**5, "1 " * 10**5, "1:" * 10**5):
        base = pii.base_spans(text)
        pii.wide_spans(text, base)


TRICKY = [
    (1, "call me at 415-555-2671 or (415) 555-2671 now"),
    (2, "build 555-123-4567x version 1.2.3.4"),
    (3, "mail joe (at) example (dot) com please"),
    (4, "from fe80:0:0:0:202:b3ff:fe1e:8329 today"),
    (5, None),
    (5, ""),
]


def test_added_spans(spark):
    documents = pii.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    some = spark.createDataFrame([(10**6 + i, t) for i, t in TRICKY], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_private(documents.union(some)).collect()}
    assert got[10**6 + 1]["spans"] == "phone:11:23,phone:27:41"
    assert "phone" not in got[10**6 + 2]["spans"]
    assert got[10**6 + 3]["spans"] == "email:5:31"
    assert got[10**6 + 4]["spans"] == "ip:5:34"
    for row in documents.collect():
        base = plain(row["text"])
        r = got[row["doc_id"]]
        assert r["base_spans"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [[k for _, k, _ in base].count(i) for i in range(4)]
        assert set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(","))


def test_odd_documents(odd_documents):
    got = pii.find_private(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert {r["spans"] for r in got} == {""}
    assert pii.find_private(odd_documents.limit(0)).collect() == []
