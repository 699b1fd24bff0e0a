import duckdb
from llm_texts import prose

from sysweave.llm import rules


def test_against_sql(spark, rng):
    texts = [prose(rng, rng.randrange(200), rng.choice([5, 40, 4000])) for _ in range(150)]
    texts += [t + "\n" + t[: len(t) // 2] for t in texts[:40]]
    texts += [None, "", " \n ", "\n".join(["x y"] * 40), "a " * 60, "é # ß " * 50, "a\r\nb\r\na\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = df.toPandas()
    want = duckdb.connect().execute(rules.rules_sql())
    names = [d[0] for d in want.description]
    got = rules.rules(df)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
    assert len(documents) == len(texts)


def test_equal_hashes_are_told_apart(monkeypatch):
    texts = ["a b c d e a b c x y z", "q a b c q a b c"]
    want = rules.measure([1, 2], texts)
    monkeypatch.setattr(rules, "mixed", lambda x: x * 0 + 1)
    got = rules.measure([1, 2], texts)
    assert [list(c) for c in got] == [list(c) for c in want]


def test_odd_documents(odd_documents):
    got = rules.rules(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(r["base_failed"] and not r["kept"] for r in got if (r["doc_id"] or 0) < 6)
    assert [r["kept"] for r in got if r["doc_id"] == 7] == [True]
    assert rules.rules(odd_documents.limit(0)).collect() == []
