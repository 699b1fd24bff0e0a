"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs.

Pairs are counted in Spark. A task counts the pairs of some texts in numpy and
sends them on by ranges of the pair's hash; a range's counts are added up and
written as a sorted hash array. What a range knows of its words (as contexts and
as continuations) is sent on by ranges of the word's hash and written the same
way. Workers map the arrays into memory to score.
"""

from __future__ import annotations

import functools
import os
import re
import urllib.parse
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import arrow_schema, documents, read, slices
from sysweave.llm.registry import query
from sysweave.session import run_folder

#: Bytes of training text for each range of pairs.
RANGE_BYTES = 16_000_000
#: Pairs a task collects before it counts and sends them on.
TOGETHER = 3_000_000
#: Bytes hashed at a time.
BLOCK = 1 << 20

ODD = 0x9E3779B97F4A7C15
START, END = np.uint64(1), np.uint64(2)
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD to the power of 0, 1, .. and of 0, -1, .., modulo 2 to the 64."""
    out = []
    for base in (ODD, pow(ODD, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of ``data``, between the six ASCII blanks.

    A word's hash is a polynomial of its bytes, taken from running sums over the
    whole block, then mixed; words are never cut out one by one.
    """
    hashes, firsts, lasts, at = [], [], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not BLANKS[data[end]]:
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        up, down = powers(max(2 * BLOCK, 1 << len(part).bit_length()))
        blank = np.concatenate(([True], BLANKS[part], [True]))
        edge = blank[1:] != blank[:-1]
        first = np.flatnonzero(edge & blank[:-1])
        last = np.flatnonzero(edge & ~blank[:-1])
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[last] - sums[first]) * down[first]
        hashes.append(mixed(h + (last - first).astype(np.uint64) * np.uint64(ODD)))
        firsts.append(first + at)
        lasts.append(last + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token before, token, number of its text) for the words of each text and its end."""
    coded = [(t or "").encode().lower() for t in texts]
    begins = np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1]
    hashes, places, _ = word_hashes(b"\n".join(coded))
    owner = np.searchsorted(begins, places, "right") - 1
    counts = np.bincount(owner, minlength=len(texts)) + 1
    token = np.full(len(hashes) + len(texts), END)
    token[np.arange(len(hashes)) + owner] = hashes
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(counts) - counts] = START
    return before, token, np.repeat(np.arange(len(texts)), counts)


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(ODD) + token)


def range_of(key: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of 64-bit numbers; greater keys are in later ranges."""
    return ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pieces(key: np.ndarray, n: int):
    """(range, first, last) of the sorted ``key`` by range."""
    ranges = range_of(key, n)
    edges = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True])))
    if len(key):
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            yield int(ranges[first]), first, last


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: first all lowest bytes of an array, then the next."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(sizes.tobytes() + b"".join(planes), 3)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, np.int64, len(kinds)), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * width
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    """The first of some ordered numbers and the differences that follow; undone by cumsum."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def summed(key: np.ndarray, *values: np.ndarray):
    """The distinct keys in order, an index of each one's first row, and sums of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
    return key[first], order[first], [
        np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values
    ]


PAIRS = "part long, data binary"


def count_pairs(texts: DataFrame, ranges: int) -> DataFrame:
    """(part, data): counted pairs of words in (text), by range of the pair's key."""

    def flush(found):
        before, token = (np.concatenate(x) for x in zip(*found, strict=True))
        key, at, (n,) = summed(pair_key(before, token), np.ones(len(token), np.int64))
        before, token = before[at], token[at]
        for part, first, last in pieces(key, ranges):
            # Words repeat: send each once, and the pairs as numbers of words.
            words, numbers = np.unique(
                np.concatenate((before[first:last], token[first:last])), return_inverse=True
            )
            one, two = numbers[: last - first], numbers[last - first :]
            order = np.argsort(one * len(words) + two)
            columns = steps(one[order]), two[order], n[first:last][order]
            yield part, packed(steps(words), *[c.astype(np.uint32) for c in columns])

    def run(batches):
        schema, found, size = arrow_schema(PAIRS), [], 0

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*flush(found), strict=True), schema, strict=True)],
                schema=schema,
            )

        for batch in batches:
            for part in slices(batch, rows=2048, chars=2_000_000):
                before, token, _ = tokens_of(part.column(0).to_pylist())
                found.append((before, token))
                size += len(token)
                if size >= TOGETHER:
                    yield rows()
                    found, size = [], 0
        if size:
            yield rows()

    return texts.mapInArrow(run, PAIRS)


WORD_COLUMNS = 6  # as context: all, followers seen once, twice, more; as continuation: pairs, all


def counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


def add_pairs(table: pa.Table, folder: str, word_ranges: int):
    """Add up a range's pairs, write them, and say what they tell of their words."""
    parts = []
    for data in table["data"].to_pylist():
        words, one, two, n = unpacked(data, np.uint64, np.uint32, np.uint32, np.uint32)
        words = np.cumsum(words, dtype=np.uint64)
        parts.append((words[np.cumsum(one, dtype=np.int64)], words[two], n.astype(np.int64)))
    before, token, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, at, (n,) = summed(pair_key(before, token), n)
    before, token = before[at], token[at]
    part = table["part"][0].as_py()
    save(folder, f"pairs-{part}", key, n.astype(np.uint32) if n.max(initial=0) < 2**32 else n)
    one = np.ones_like(n)
    context, _, as_context = summed(before, n, one * (n == 1), one * (n == 2), one * (n > 2))
    follower, _, as_follower = summed(token, one, n)
    words = np.union1d(context, follower)
    known = np.zeros((WORD_COLUMNS, len(words)), np.int64)
    known[:4, np.searchsorted(words, context)] = as_context
    known[4:, np.searchsorted(words, follower)] = as_follower
    for word_part, first, last in pieces(words, word_ranges):
        yield word_part, packed(steps(words[first:last]), known[:, first:last].ravel()), None
    yield 0, None, counts_of_counts(n).tolist()


def add_words(table: pa.Table, folder: str):
    """Add up a range's words, write them, and give the numbers the whole model needs."""
    parts, pairs = [], np.zeros(4, np.int64)
    for data, counts in zip(table["data"].to_pylist(), table["counts"].to_pylist(), strict=True):
        if data is None:
            pairs += counts
        else:
            words, known = unpacked(data, np.uint64, np.int64)
            parts.append((np.cumsum(words, dtype=np.uint64), known.reshape(WORD_COLUMNS, -1)))
    if not parts:
        return [*pairs, *[0] * 7, len(table), 0]
    words = np.concatenate([w for w, _ in parts])
    known = np.concatenate([k for _, k in parts], 1)
    words, _, known = summed(words, *known)
    save(folder, f"words-{table['part'][0].as_py()}", words, np.stack(known, 1))
    pairs_in, all_in = known[4], known[5]
    return [
        *pairs,
        *counts_of_counts(pairs_in[pairs_in > 0]),
        pairs_in.sum(),
        all_in.sum(),
        (all_in > 0).sum(),
        len(table) - len(parts),
        1,
    ]


def save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write under a name of its own and then rename: a task run twice leaves one whole file."""
    for i, a in enumerate(arrays):
        own = f"{folder}/{name}.{i}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, a)
        os.replace(own, f"{folder}/{name}.{i}.npy")


def written(folder: str, name: str, ranges: int, n: int) -> np.ndarray:
    """For each range whether it has arrays; an error unless there are ``n``, as the tasks said."""
    out = np.zeros(ranges, bool)
    whole = re.compile(re.escape(name) + r"-(\d+)\.0\.npy")
    with os.scandir(folder) as files:
        for part in (whole.fullmatch(f.name) for f in files):
            if part:
                out[int(part[1])] = True
    if out.sum() != n:
        raise OSError(f"{n} ranges of {name} were written, {out.sum()} are in {folder}; is it shared?")
    return out


def local_path(folder: str) -> str:
    """The path all workers reach ``folder`` by; memory-mapping needs one."""
    url = urllib.parse.urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model's arrays need a shared folder that is mounted, not {folder}")
    return url.path


def discounts(counts) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of 0, 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0, *(min(max(d, 0.05), k) for k, d in enumerate(found, 1))])


class Model:
    """Where the arrays are, which ranges have any, and the numbers that hold for all of them."""

    def __init__(self, folder: str, ranges: int, word_ranges: int, totals: np.ndarray):
        self.folder = folder
        self.pair_parts = written(folder, "pairs", ranges, totals[11])
        self.word_parts = written(folder, "words", word_ranges, totals[12])
        self.pair_discount = discounts(totals[:4])
        self.word_discount = discounts(totals[4:8])
        self.pairs, self.tokens, self.distinct = (int(x) for x in totals[8:11])
        n1, n2 = totals[4], totals[5]
        more = self.distinct - n1 - n2
        self.word_rest = (
            float(np.dot(self.word_discount[1:], [n1, n2, more])) / self.pairs if self.pairs else 1.0
        )

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """The WORD_COLUMNS numbers of each of the sorted ``words``, zeros if unknown."""
        out = np.zeros((len(words), WORD_COLUMNS), np.int64)
        look_up(self.folder, "words", self.word_parts, words, out)
        return out

    def of_pairs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        look_up(self.folder, "pairs", self.pair_parts, keys, out)
        return out

    def score(self, texts: list) -> list:
        """[tokens, known tokens, base score, score] of some texts, as columns."""
        before, token, owner = tokens_of(texts)
        words, at = np.unique(np.concatenate((before, token)), return_inverse=True)
        known = self.of_words(words)
        context, follower = at[: len(token)], at[len(token) :]
        pairs, at = np.unique(pair_key(before, token), return_inverse=True)
        n = self.of_pairs(pairs)[at]
        # Words by the different words before them, over all words and an unknown one.
        alone = known[:, 4]
        by_word = np.maximum(alone - self.word_discount[np.minimum(alone, 3)], 0) / max(1, self.pairs)
        by_word = by_word + self.word_rest / (self.distinct + 1)
        total = np.maximum(known[:, 0], 1)
        rest = np.where(known[:, 0] > 0, known[:, 1:4] @ self.pair_discount[1:] / total, 1.0)
        p = np.maximum(n - self.pair_discount[np.minimum(n, 3)], 0) / total[context]
        p = p + rest[context] * by_word[follower]
        c = known[follower, 5]
        base = np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))
        size = len(texts)
        return [
            np.bincount(owner, minlength=size),
            np.bincount(owner[c > 0], minlength=size),
            np.bincount(owner, base, size),
            np.bincount(owner, np.log10(p), size),
        ]


@functools.lru_cache(maxsize=4096)
def mapped(path: str):
    return np.load(path, mmap_mode="r")


def look_up(folder: str, name: str, parts: np.ndarray, keys: np.ndarray, out: np.ndarray) -> None:
    """Fill ``out`` with the rows of the sorted ``keys`` that the arrays have. A range that has
    arrays and whose files a worker does not see is an error, not unknown words."""
    for part, first, last in pieces(keys, len(parts)):
        if not parts[part]:
            continue
        there = mapped(f"{folder}/{name}-{part}.0.npy")
        values = mapped(f"{folder}/{name}-{part}.1.npy")
        at = np.minimum(np.searchsorted(there, keys[first:last]), len(there) - 1)
        hit = there[at] == keys[first:last]
        out[first:last][hit] = values[at[hit]]


def train(texts: DataFrame) -> Model:
    """A model of the pairs of words in (text); the end of a text is a word too.

    Every text counts. Ranges follow the amount of text, so a task adds up about
    as much at every size. The arrays stay in the shared folder.
    """
    spark = texts.sparkSession
    folder = f"{local_path(run_folder(spark))}/lm-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(24, -(-size // RANGE_BYTES))
    word_ranges = max(12, ranges // 2)
    found_schema = "part long, data binary, counts array<long>"
    done_schema = "totals array<long>"

    def pairs(table: pa.Table) -> pa.Table:
        columns = zip(*add_pairs(table, folder, word_ranges), strict=True)
        schema = arrow_schema(found_schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def words(table: pa.Table) -> pa.Table:
        totals = [int(x) for x in add_words(table, folder)]
        return pa.table([pa.array([totals], pa.list_(pa.int64()))], schema=arrow_schema(done_schema))

    rows = (
        count_pairs(texts.select("text"), ranges)
        .groupBy("part")
        .applyInArrow(pairs, found_schema)
        .groupBy("part")
        .applyInArrow(words, done_schema)
        .select([F.col("totals")[i].alias(f"t{i}") for i in range(13)])
        .agg(*[F.sum(f"t{i}") for i in range(13)])
        .first()
    )
    return Model(folder, ranges, word_ranges, np.array([x or 0 for x in rows], np.int64))


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row, in log10.

    A null text is an empty one, whose only token is its end. Repeated rows give
    repeated rows, other columns are not looked at.
    """

    def run(batches):
        schema = arrow_schema(SCORED)
        for batch in batches:
            for part in slices(batch, rows=2048, chars=4_000_000):
                columns = [part.column(0), *model.score(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) else pa.array(c, f.type)
                        for c, f in zip(columns, schema, strict=True)
                    ],
                    schema=schema,
                )

    return documents(docs, id_col, text_col).mapInArrow(run, SCORED)


def is_held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text, modulo 10, is 0, or there is no id."""
    left = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 10 == 0
    return F.coalesce(left, F.lit(True))


@query("op10_ngramlm")
def op10_ngramlm(spark, sf_dir: str) -> DataFrame:
    docs = documents(read(spark, sf_dir, "documents"))
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    return scores(docs, model).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
