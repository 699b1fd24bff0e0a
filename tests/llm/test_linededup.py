import re

import pytest

from sysweave.llm import linededup


def lines_of(data):
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out, line = [], []
    for i, (a, b) in enumerate(words):
        line.append((a, b))
        after = words[i + 1][0] if i + 1 < len(words) else len(data)
        if data[b - 1 : b] in (b".", b"!", b"?") or b"\n" in data[b:after] or i + 1 == len(words):
            out.append(line)
            line = []
    return out


def plain(rows, min_words):
    """{doc_id: (text, lines, lines deleted, words, words deleted)} by the wording."""
    first, hashes, out = {}, {}, {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        lines = lines_of(data)
        keys = hashes[doc] = [tuple(data[a:b].lower() for a, b in line) for line in lines]
        gone, repeated = set(), {}
        for i in range(len(keys)):
            n, j = 0, i
            while j < len(keys) and n < min_words:
                n, j = n + len(keys[j]), j + 1
            if n < min_words:
                break
            place = first.setdefault(tuple(keys[i:j]), (doc, i))
            if place != (doc, i):
                gone.update(range(i, j))
                repeated[i] = (j, *place)
        for i, (j, earlier, at) in repeated.items():
            if i + 1 not in repeated:
                other, y = hashes[earlier], at + j - i
                while j < len(keys) and y < len(other) and keys[j] == other[y]:
                    gone.add(j)
                    j, y = j + 1, y + 1
        edges = [line[0][0] for line in lines] + [len(data)]
        kept = [data[: edges[0]]] + [data[edges[i] : edges[i + 1]] for i in range(len(lines)) if i not in gone]
        counts = len(lines), len(gone), sum(map(len, keys)), sum(len(keys[i]) for i in gone)
        out[doc] = ((b"".join(kept) if gone else data).decode(), *counts)
    return out


def check(df, rows, min_words, gram_words):
    want = plain(rows, min_words)
    for r in linededup.line_dedup(df, min_words, gram_words).collect():
        made = (r["text"] or "", r["n_lines"], r["n_removed"], r["n_words"], r["n_removed_words"])
        assert made == want[r["doc_id"]]


@pytest.mark.parametrize(("min_words", "gram_words"), [(50, 16), (20, 8), (16, 16), (1, 1)])
def test_against_the_wording(spark, rng, min_words, gram_words):
    sentences = [
        " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 30))) + rng.choice([".", "", "!", "?"])
        for _ in range(40)
    ]
    rows = []
    for doc in range(120):
        text = ""
        for _ in range(rng.randint(0, 10)):
            at = rng.randrange(36)
            text += rng.choice(["\n", " ", "\n\n"]) + rng.choice(["\n", " "]).join(sentences[at : at + rng.randint(1, 5)])
        rows.append((doc, text))
    rows += [(200, "x y z. " * 100), (201, None), (202, " \n "), (203, "a " * 60), (204, "a " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(df, rows, min_words, gram_words)


def test_given_documents(spark):
    df = linededup.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    check(df, [tuple(r) for r in df.collect()], 50, 16)


def test_odd_documents(spark, odd_documents):
    made = linededup.line_dedup(odd_documents)
    assert made.columns == [c for c in odd_documents.columns if c != "n_words"] + [
        "n_lines", "n_removed", "n_words", "n_removed_words",
    ]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in made.collect()) == sorted(
        (r["doc_id"] or 0, r["text"] or "") for r in odd_documents.collect()
    )
    assert linededup.line_dedup(odd_documents.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "a. " * 60), (3, "b. " * 60), (3, "b. " * 60)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in linededup.line_dedup(twice).collect())
    assert got == [(0, 0), (3, 59), (3, 59)]
    with pytest.raises(ValueError, match="window"):
        linededup.line_dedup(twice, 10, 11)
