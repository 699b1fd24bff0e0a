import numpy as np
import pytest
from llm_texts import prose

from sysweave.llm import decontaminate as d


def plain_align(item, passage):
    """The best local score, cell by cell."""
    best, above = 0, [0] * (len(passage) + 1)
    for w in item:
        row = [0]
        for j, p in enumerate(passage, 1):
            row.append(max(0, above[j - 1] + (d.EQUAL if w == p else d.OTHER), above[j] + d.GAP, row[-1] + d.GAP))
        best, above = max(best, *row), row
    return best


def test_alignment(rng):
    for _ in range(300):
        item = np.array([rng.randrange(6) for _ in range(rng.randint(1, 12))])
        passage = np.array([rng.randrange(6) for _ in range(rng.randint(1, 25))])
        score, first, last = d.align(item, passage)
        assert score == plain_align(item, passage)
        if score:
            assert plain_align(item, passage[first : last + 1]) == score


@pytest.fixture
def planted(spark, rng):
    """Items, and documents with copies of them, edited ones, and none."""
    items = [(i, prose(rng, 40, 5000)) for i in range(12)]
    rows, want = [], set()
    for doc in range(60):
        text = prose(rng, 120, 5000)
        if doc % 3:
            i = rng.randrange(12)
            words = [f"new{rng.randrange(99)}" if rng.random() < 0.15 * (doc % 3 - 1) else w for w in items[i][1].split()]
            text = f"{text} {' '.join(words).upper()} {prose(rng, 30, 5000)}"
            want.add((doc, i))
        rows.append((doc, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(items, "item_id long, text string"), want, dict(rows)


def test_planted(planted):
    docs, items, want, texts = planted
    got = d.copies_of(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for r in got:
        assert texts[r["doc_id"]][r["first_char"] : r["end_char"]] == r["passage"]
    left = d.without_copies(docs, items)
    assert {r["doc_id"] for r in left.collect()} == set(texts) - {doc for doc, _ in want}


def test_blocks_change_nothing(planted):
    docs, items, *_ = planted
    key = lambda rows: sorted((r["doc_id"], r["item_id"], r["first_char"], r["end_char"]) for r in rows)
    assert key(d.copies_of(docs, items).collect()) == key(d.copies_of(docs, items, block_words=100).collect())


def test_part_quoted_often(spark, rng):
    """A part of an item that far more documents have than the rest of it."""
    words = prose(rng, 40, 5000).split()
    part = " ".join(words[20:36])
    rows = [(0, f"{prose(rng, 50, 5000)} {' '.join(words)}")]
    rows += [(i, f"{prose(rng, 50, 5000)} {part} {prose(rng, 50, 5000)}") for i in range(1, 101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in d.copies_of(docs, items).collect()}
    assert set(got) == set(range(101)) and min(got.values()) >= 0.4
    assert d.without_copies(docs, items).count() == 0


def test_each_window_has_a_seed(rng):
    for _ in range(300):
        counts = np.array([rng.choice([1, 3, 50, 1000, 10**6]) for _ in range(rng.randint(1, 60))])
        kept = counts <= d.seed_limits(counts)
        words = len(counts) + d.GRAM - 1
        need = next(w for w in range(1, words + 1) if w / words >= d.LEAST)
        width = max(1, need - d.GRAM + 1)
        assert all(kept[i : i + width].any() for i in range(len(counts) - width + 1))


def test_odd_documents(spark, odd_documents):
    rows = [(1, None), (None, "said twice by a row"), (3, ""), (4, "said twice"), (5, "naïve café, 漢字 🙂"), (5, "x")]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = d.copies_of(odd_documents, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(6, 5)}
    assert d.without_copies(odd_documents, items).count() == odd_documents.count() - 1
    assert d.copies_of(odd_documents, items.limit(0)).collect() == []
    assert d.copies_of(odd_documents.limit(0), items).collect() == []
    assert d.without_copies(odd_documents, items).columns == odd_documents.columns
