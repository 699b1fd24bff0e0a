import random

import pytest

from sysweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = bpe.public_vocabulary()
    return bpe.Encoder(path), tokenizers.Tokenizer.from_file(path)


def same(pair, text):
    mine, theirs = pair
    ids = theirs.encode(text, add_special_tokens=False).ids
    made = mine.encode(text)
    assert [int.from_bytes(made[i : i + 4], "little") for i in range(0, len(made), 4)] == ids
    assert mine.decode(made) == theirs.decode(ids, skip_special_tokens=False)


def test_random_texts(pair):
    rng = random.Random(3)
    letters = "aeiotnsrh thing \n\t'sré123!!$$<|endoftext|>zq\u3000漢字🙂"
    for n in range(3000):
        same(pair, "".join(rng.choice(letters) for _ in range(n % 60)))
        same(pair, "".join(rng.choice("eationsr") for _ in range(n % 200)))


def test_every_kind_of_character(pair):
    for code in [*range(0x3000), *range(0x3000, 0x30000, 61)]:
        if not 0xD800 <= code < 0xE000:
            same(pair, f"a{chr(code)} b{chr(code) * 2} 1{chr(code)}")


def test_special_token_and_long_pieces(pair):
    same(pair, "<|endoftext|>a <|endoftext|> <|endoftext|><|endoftext|")
    for text in ("a" * 20_000, " " * 20_000, "ab" * 10_000, "é" * 10_000):
        same(pair, text)


def test_forgetting_changes_nothing(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    enc = bpe.Encoder(bpe.public_vocabulary())
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join("".join(rng.choice("theangiro") for _ in range(9)) for _ in range(20))
        assert enc.encode(text) == pair[0].encode(text)


def test_odd_documents(spark, odd_documents):
    path = bpe.public_vocabulary()
    whole = bpe.round_trip(odd_documents, path).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in whole) == sorted(
        (r["doc_id"] or 0, r["text"] or "") for r in odd_documents.collect()
    )
    again = bpe.decode(bpe.encode(odd_documents, path), path)
    assert sorted(r["text"] for r in again.collect()) == sorted(r["decoded"] for r in whole)
    assert bpe.digests(bpe.round_trip(odd_documents.limit(0), path)).collect() == []
