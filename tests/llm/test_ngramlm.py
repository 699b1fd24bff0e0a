import pytest
import collections
import math
import zlib

import numpy as np
from llm_texts import prose
from pyspark.sql import functions as F

from sysweave.llm import ngramlm


def words(text):
    return (text or "").encode().lower().split()


class Plain:
    """The model from dictionaries."""

    def __init__(self, texts):
        pairs = collections.Counter()
        for t in texts:
            seq = [b"<s>", *words(t), b"</s>"]
            pairs.update(zip(seq, seq[1:], strict=False))
        self.pairs, self.raw = pairs, collections.Counter()
        self.alone, self.total = collections.Counter(), collections.Counter()
        self.follow = collections.defaultdict(lambda: [0, 0, 0, 0])
        for (u, w), n in pairs.items():
            self.raw[w] += n
            self.alone[w] += 1
            self.total[u] += n
            self.follow[u][min(n, 3)] += 1
        count = lambda vs: [sum(v == k for v in vs) for k in (1, 2, 3, 4)]
        self.d2 = ngramlm.discounts(count(pairs.values()))
        self.d1 = ngramlm.discounts(count(self.alone.values()))
        spent = sum(self.d1[min(n, 3)] for n in self.alone.values())
        self.rest = spent / len(pairs) if pairs else 1.0

    def p1(self, w):
        n = self.alone[w]
        return max(n - self.d1[min(n, 3)], 0) / max(1, len(self.pairs)) + self.rest / (len(self.raw) + 1)

    def p2(self, u, w):
        if not self.total[u]:
            return self.p1(w)
        n = self.pairs[(u, w)]
        rest = sum(d * f for d, f in zip(self.d2, self.follow[u], strict=True)) / self.total[u]
        return max(n - self.d2[min(n, 3)], 0) / self.total[u] + rest * self.p1(w)

    def score(self, text):
        seq = [b"<s>", *words(text), b"</s>"]
        return sum(math.log10(self.p2(u, w)) for u, w in zip(seq, seq[1:], strict=False))


def test_against_dictionaries(spark, rng, monkeypatch):
    monkeypatch.setattr(ngramlm, "TOGETHER", 500)
    rows = [(i, prose(rng, rng.randrange(80), 60).upper() if i % 3 else None) for i in range(120)]
    rows += [(200, "É é E unseen"), (201, ""), (202, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = F.col("doc_id") >= 100
    model = ngramlm.train(df.where(~held))
    plain = Plain([t for i, t in rows if i < 100])
    assert model.tokens == sum(plain.raw.values()) and model.distinct == len(plain.raw)
    for row in ngramlm.scores(df, model).collect():
        text = dict(rows)[row["doc_id"]]
        seq = [*words(text), b"</s>"]
        assert row["n_tokens"] == len(seq)
        assert row["n_known"] == sum(plain.raw[w] > 0 for w in seq)
        base = sum(math.log10((plain.raw[w] + 0.1) / (model.tokens + 0.1 * (model.distinct + 1))) for w in seq)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        assert math.isclose(row["score"], plain.score(text), rel_tol=1e-9)
    total = sum(plain.p2(b"w0", w) for w in plain.raw) + plain.p2(b"w0", b"never")
    assert math.isclose(total, 1, rel_tol=1e-9)


def test_words_across_blocks(monkeypatch):
    data = ("aé b  ccc\n" * 5000 + "z" * 9000 + " end").encode()
    whole = ngramlm.word_hashes(data)
    monkeypatch.setattr(ngramlm, "BLOCK", 1000)
    cut = ngramlm.word_hashes(data)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    found = [data[a:b] for a, b in zip(*cut[1:], strict=True)]
    assert found == data.split()
    assert len(set(zip(found, cut[0].tolist(), strict=True))) == len(set(found))


def test_packing():
    arrays = [np.array([1, 5, 9], np.uint64), np.zeros(0, np.uint32), np.arange(7, dtype=np.int64) - 3]
    back = ngramlm.unpacked(ngramlm.packed(*arrays), np.uint64, np.uint32, np.int64)
    assert all(np.array_equal(a, b) for a, b in zip(arrays, back, strict=True))
    assert np.array_equal(np.cumsum(ngramlm.steps(arrays[0])), arrays[0])


def test_held_out_texts_are_more_likely_than_by_words_alone(spark):
    got = ngramlm.op10_ngramlm(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_odd_documents(odd_documents):
    model = ngramlm.train(odd_documents)
    assert ngramlm.scores(odd_documents, model).count() == odd_documents.count()
    empty = ngramlm.train(odd_documents.limit(0))
    assert {r["score"] for r in ngramlm.scores(odd_documents.limit(3), empty).collect()} == {0.0}
    assert ngramlm.scores(odd_documents.limit(0), model).collect() == []


def test_absent_arrays_are_an_error(spark, tmp_path):
    """A worker or driver that does not see the arrays fails; words do not become unknown."""
    texts = spark.createDataFrame([("a b a c",), ("b b",)], "text string")
    model = ngramlm.train(texts)
    assert model.word_parts.sum() > 0 and model.pair_parts.sum() > 0
    assert model.score(["a b"])[1].tolist() == [3]
    model.folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        model.score(["a b"])
    with pytest.raises(OSError, match="is it shared"):
        ngramlm.written(str(tmp_path), "words", 12, 1)
    nothing = ngramlm.train(texts.limit(0))
    assert not nothing.word_parts.any() and nothing.score(["a b"])[1].tolist() == [0]
