import hashlib

import corpus_pipeline
import pytest
from llm_texts import prose
from pyspark.sql import functions as F
from test_linededup import plain as plain_lines
from test_neardup import plain as plain_groups

from sysweave.llm import bpe, decontaminate, quality
from sysweave.session import cut

SF = "/root/testdata/sf0.01"
tokenizers = pytest.importorskip("tokenizers")


def test_stages_against_plain_versions(spark):
    """Each stage on what the stage before kept, the classifier's verdicts taken as given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(cut(stage(spark, steps[-1], SF)))
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in steps[:-1]]
    assert all(d.columns == columns for d in steps[:-1])

    judged = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept")
    assert texts[1] == {r["doc_id"]: texts[0][r["doc_id"]] for r in judged.collect()}

    lines = plain_lines(list(texts[1].items()), 50)
    assert texts[2] == {i: r[0] for i, r in lines.items() if not r[2] or r[4] < r[3]}
    assert steps[2].where(F.length("text") != F.col("n_chars")).count() == 0

    groups = plain_groups(list(texts[2].items()), 5)
    assert texts[3] == {i: t for i, t in texts[2].items() if groups[i][1] == i}

    items = decontaminate.Items(*zip(*spark.read.parquet(f"{SF}/benchmark.parquet").collect(), strict=True))
    whole = {i for i, t in texts[3].items() if any(holds(t, w) for w in items.words)}
    assert whole and not whole & set(texts[4])
    assert set(texts[4]) <= set(texts[3])
    lost = set(texts[3]) - set(texts[4]) - whole
    assert all(next(items.matches(decontaminate.words_of(texts[3][i].encode())[0]), None) for i in lost)

    theirs = tokenizers.Tokenizer.from_file(bpe.public_vocabulary())
    last = {r["doc_id"]: r for r in steps[5].collect()}
    assert set(last) == set(texts[4])
    for i, text in texts[4].items():
        ids = theirs.encode(text, add_special_tokens=False).ids
        coded = b"".join(n.to_bytes(4, "little") for n in ids)
        assert last[i]["n_tokens"] == len(ids)
        assert last[i]["ids_sha256"] == hashlib.sha256(coded).hexdigest()
        assert last[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    run = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == last


def holds(text, item):
    """Whether the words of an item stand in a text one after the other."""
    words = decontaminate.words_of(text.encode())[0].tolist()
    item = item.tolist()
    return any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1))


def test_near_duplicates_by_row(spark, rng):
    """Unlike texts stay without a doc_id and with one they share; of like ones the least doc_id does."""
    a, b, c, e, f = (prose(rng, 60, 5000) for _ in range(5))
    rows = [(None, a), (None, b), (4, c), (4, e), (4, c), (9, f), (2, f), (None, f), (7, a), (8, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row_key").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(7, a), (None, b), (4, c), (4, e), (2, f), (8, ""), (None, "")]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=key) == sorted(want, key=key)


def test_odd_documents(spark, odd_documents):
    for docs in (odd_documents.withColumn("n_chars", F.length("text").cast("long")), odd_documents.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, cut(stage(spark, docs, SF))
            if stage is not corpus_pipeline.tokens:
                assert docs.columns == columns
                clashing = docs.select("ids", "kept", "node", "runs", "others", "part", "score", "n_words")
                assert {tuple(r) for r in clashing.collect()} <= {(7,) * 8}
        docs.collect()
