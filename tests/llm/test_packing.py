import itertools
import zlib

import numpy as np
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from sysweave.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.public_vocabulary()


def ids_of(text, theirs=tokenizers.Tokenizer.from_file(PATH)):  # noqa: B008
    return [*theirs.encode(text or "", add_special_tokens=False).ids, 0]


def checked(rows, docs, window):
    """Holds pieces against the documents; returns (padding, tokens)."""
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    wanted = {}
    for i, text in docs:
        wanted.setdefault(i, []).append(ids_of(text))
    assert set(by) == set(wanted)
    for i, texts in wanted.items():
        if len(texts) > 1:  # repeated rows: each token as often as it is there
            assert sum(r["length"] for r in by[i]) == sum(map(len, texts))
            continue
        pieces, at = sorted(by[i], key=lambda r: r["start"]), 0
        for r in pieces:
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(texts[0])
            some = np.array(texts[0][at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(some)
            at += r["length"]
        assert at == len(texts[0])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(r["length"] for r in rows)


def packed(docs, **options):
    pieces = packing.pack(docs, PATH, **options)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()


@pytest.mark.parametrize("window", [64, 100, 1024])
def test_every_token_once_and_little_padding(spark, rng, monkeypatch, window):
    monkeypatch.setattr(packing, "BLOCK", 3000)
    rows = [(i, prose(rng, rng.randint(1, 700))) for i in range(120)] + [(900, "word" * 20_000), (901, " " * 9000)]
    rows += [(902, "a<|endoftext|>b"), (903, None), (904, ""), (905, "漢字。" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    padding, total = checked(packed(df, window=window), rows, window)
    print(window, padding, total)
    assert window < 1024 or padding < 0.015 * total


def plain_cost(place, penalty, costs, at=0, known=None):
    """The least cost by trying every next end."""
    known = {} if known is None else known
    if at == place[-1]:
        return 0
    if at not in known:
        known[at] = min(
            (costs.sequence + costs.padding(x - at) + p + plain_cost(place, penalty, costs, x, known)
             for x, p in zip(place, penalty, strict=True) if at < x <= at + costs.window),
        )
    return known[at]


def test_least_costs_against_every_cut(rng, monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 1)
    monkeypatch.setattr(packing, "LONG", 5)
    for _ in range(300):
        costs = packing.Costs(rng.choice([8, 16, 20]), rng.randint(0, 4), rng.randint(0, 9), rng.randint(0, 3))
        size = rng.randint(1, 60)
        ends = np.array(sorted({rng.randint(1, size) for _ in range(rng.randint(1, 12))} | {size}))
        doc_ends = np.array(sorted({int(e) for e in ends if rng.random() < 0.4} | {size}))
        place, penalty = packing.places(size, doc_ends, ends, costs)
        cost, _ = packing.least_costs(place, penalty, costs)
        assert cost[-1] == plain_cost(place, penalty, costs)
        found = packing.cuts(place, penalty, costs, True)
        assert found == sorted(set(found)) and found[-1] == size
        assert all(b - a <= costs.window for a, b in itertools.pairwise([0, *found]))


def test_cuts_keep_documents_and_sentences(spark):
    """Where all fits, sequences end with documents; else mostly with sentences."""
    df = spark.createDataFrame([(i, "one two three four. " * 12) for i in range(64)], "doc_id long, text string").coalesce(1)
    rows = packed(df, window=128, inside=500, sentence=100)
    assert all(r["start"] == 0 and r["length"] == r["doc_tokens"] for r in rows)
    rows = packed(df, window=40, inside=500)
    ends = [r for r in rows if r["start"] + r["length"] < r["doc_tokens"]]
    assert ends and all((r["start"] + r["length"]) % 5 == 0 for r in ends)


def test_odd_documents(spark, odd_documents):
    rows = packed(odd_documents)
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    checked(rows, docs, 1024)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * len(ids_of("said twice"))
    assert packed(odd_documents.limit(0)) == []


def test_a_very_long_text_of_blanks(spark):
    text = " " * 2_000_000 + "x" + "\n" * 500_000
    checked(packed(spark.createDataFrame([(1, text)], "doc_id long, text string")), [(1, text)], 1024)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    padding, total = checked(packing.op11_packing(spark, sf).collect(), docs, 1024)
    print(padding, total)
    assert padding < 0.02 * total
