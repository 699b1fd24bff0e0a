"""Benchmark decontamination: rare n-gram seeds and local alignment.

The n-grams of the test items are counted over all documents, and each item
keeps those as seeds that are not far more common than its usual ones, or than
the rarest of some stretch around them that is long enough to count as a copy.
So each such stretch has seeds, however often it is quoted. Where a document has a seed, the
passage around it is aligned with the item (Smith and Waterman), so that copies
with words changed, dropped or put in are found too. Test items are taken in
blocks of bounded size; each block goes through all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import arrow_schema, documents, filter_rows, read, slices
from sysweave.llm.ngramlm import ODD, mixed, word_hashes
from sysweave.llm.registry import query

#: Words in a seed.
GRAM = 3
#: An n-gram is a seed if it occurs in at most so many times as many documents, and so
#: many more, as the item's middle n-gram or the rarest of a stretch that counts as a copy.
TIMES, MORE = 4, 16
#: Least share of an item's best possible alignment score that counts as a copy.
LEAST = 0.3
#: Scores of an equal word, another word, and a word on one side only.
EQUAL, OTHER, GAP = 2, -1, -1
#: Words of test items in a block; a block is what one task gets whole.
BLOCK_WORDS = 500_000

#: A-Z to a-z, ASCII punctuation to blanks.
PLAIN = bytes(
    32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of each word, punctuation aside."""
    return word_hashes(data.translate(PLAIN))


def grams_of(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - GRAM + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(GRAM):
        rolled = rolled * np.uint64(ODD) + words[j : j + n]
    return mixed(rolled)


def over_windows(best, values: np.ndarray, width: int) -> np.ndarray:
    """``best``, np.minimum or np.maximum, of each ``width`` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def seed_limits(counts: np.ndarray) -> np.ndarray:
    """The greatest count that makes a seed of each n-gram of an item, from their counts in order.

    The least words in a row whose score is LEAST make a window; each window's
    rarest n-gram is a seed.
    """
    words = len(counts) + GRAM - 1
    width = max(1, math.ceil(LEAST * words - 1e-9) - GRAM + 1)
    least = np.pad(over_windows(np.minimum, counts, width), width - 1)
    usual = np.sort(counts)[(len(counts) - 1) // 2]
    return TIMES * np.maximum(over_windows(np.maximum, least, width), usual) + MORE


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last) of the best local alignment: the words of the passage it spans.

    Rows are words of the item. Gaps in the passage are a running maximum, so a
    row is a few operations on whole arrays.
    """
    n = len(passage)
    step = -GAP * np.arange(n + 1)
    table = np.zeros((len(item) + 1, n + 1), np.int64)
    for i, word in enumerate(item, 1):
        row = np.maximum(table[i - 1] + GAP, 0)
        np.maximum(row[1:], table[i - 1][:-1] + np.where(passage == word, EQUAL, OTHER), out=row[1:])
        table[i] = np.maximum.accumulate(row + step) - step
    i, j = np.unravel_index(np.argmax(table), table.shape)
    score, last = int(table[i, j]), int(j) - 1
    while i and j and table[i, j]:
        if table[i, j] == table[i - 1, j - 1] + (EQUAL if item[i - 1] == passage[j - 1] else OTHER):
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, int(j), last


class Items:
    """A block of test items: their words, and which items have which n-gram where."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.words = [words_of(t.encode())[0] for t in texts]
        grams = [grams_of(w) for w in self.words]
        item = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        gram = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.lexsort((place, item, gram))
        self.item, self.place = item[order], place[order]
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.stop = np.append(self.first[1:], len(order))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions whose n-gram the block has, its number)."""
        if not len(self.gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        found = np.flatnonzero(self.gram[at] == grams)
        return found, at[found]

    def keep_rare(self, counts: np.ndarray) -> None:
        """Keep of each item the n-grams that are rare for it or for a stretch of it."""
        if not len(self.item):
            return
        owner = np.repeat(np.arange(len(self.gram)), self.stop - self.first)
        n = counts[owner]
        rare = np.zeros(len(self.item), bool)
        order = np.lexsort((self.place, self.item))
        starts = np.flatnonzero(np.append(True, self.item[order][1:] != self.item[order][:-1]))
        for group in np.split(order, starts[1:]):
            rare[group] = n[group] <= seed_limits(n[group])
        self.item, self.place, owner = self.item[rare], self.place[rare], owner[rare]
        kept, self.first = np.unique(owner, return_index=True)
        self.gram, self.stop = self.gram[kept], np.append(self.first[1:], len(owner))

    def matches(self, words: np.ndarray):
        """(item, score as a share, first word, last word) of the copies among ``words``."""
        found, which = self.hits(grams_of(words))
        # Where each item would begin if the seed is part of an unchanged copy.
        begins: dict[int, list[int]] = {}
        for at, gram in zip(found.tolist(), which.tolist(), strict=True):
            for k in range(self.first[gram], self.stop[gram]):
                begins.setdefault(int(self.item[k]), []).append(at - int(self.place[k]))
        for item, starts in sorted(begins.items()):
            wanted = self.words[item]
            slack = len(wanted) // 2 + GRAM
            starts = sorted(set(starts))
            first = 0
            while first < len(starts):
                last = first  # seeds of one passage begin near each other
                while last + 1 < len(starts) and starts[last + 1] - starts[last] <= slack:
                    last += 1
                low = max(0, starts[first] - slack)
                high = min(len(words), starts[last] + len(wanted) + slack)
                while low < high:  # a long stretch of seeds in overlapping pieces
                    piece = words[low : min(high, low + 8 * (len(wanted) + slack))]
                    score, a, b = align(wanted, piece)
                    share = score / (EQUAL * len(wanted))
                    if share >= LEAST:
                        yield item, share, low + a, low + b
                        low += b + 1
                    elif low + len(piece) >= high:
                        break
                    else:
                        low += len(piece) - len(wanted) - slack
                    if high - low < GRAM:
                        break
                first = last + 1


def gram_counts(docs: DataFrame, items, n: int) -> np.ndarray:
    """In how many rows of (doc_id, text) each n-gram of a block occurs."""

    def run(batches):
        block, counts = items.value, np.zeros(n, np.int64)
        for batch in batches:
            for part in slices(batch):
                for text in part.column(1).to_pylist():
                    _, which = block.hits(grams_of(words_of((text or "").encode())[0]))
                    counts[np.unique(which)] += 1
        some = np.flatnonzero(counts)
        schema = arrow_schema("gram int, n long")
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], schema=schema
        )

    counts = np.zeros(n, np.int64)
    for row in docs.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[row[0]] = row[1]
    return counts


MATCHES = "doc_id long, item_id long, score double, first_char long, end_char long, passage string"


def blocks_of(docs: DataFrame, benchmark: DataFrame, block_words: int):
    """The test items (doc_id, text) in blocks, each broadcast with its seeds chosen.

    Items are dealt to blocks by a hash of their id, so a block has about
    ``block_words`` words at most, whatever the number of items.
    """
    items = benchmark.where("doc_id is not null and text is not null")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n_blocks = -(-size // block_words)
    context = docs.sparkSession.sparkContext
    for number in range(n_blocks):
        rows = (
            items.where(F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)) == number)
            .orderBy("doc_id", "text")
            .collect()
        )
        block = Items([r["doc_id"] for r in rows], [r["text"] for r in rows])
        block.keep_rare(gram_counts(docs, context.broadcast(block), len(block.gram)))
        yield context.broadcast(block)


MATCHES = "doc_id long, item_id long, score double, first_char long, end_char long, passage string"


def copies_of(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, score, first_char, end_char, passage): copies of test items.

    ``score`` is the alignment's share of a whole copy's, LEAST or more; places
    are code points, the end exclusive. A document may hold an item more than
    once. Null texts have no words; items of fewer than GRAM words match
    nothing; rows without item_id are left out. Repeated rows of either side
    count each. Other columns are not looked at.
    """
    docs = documents(docs, id_col, text_col)
    found = docs.sparkSession.createDataFrame([], MATCHES)
    for block in blocks_of(docs, documents(benchmark, item_col, item_text_col), block_words):
        found = found.unionByName(aligned(docs, block))
    return found


def without_copies(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no copy of a test item."""
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    for block in blocks_of(texts, documents(benchmark, item_col, item_text_col), block_words):

        def make(block=block):
            items = block.value
            return lambda texts: [
                next(items.matches(words_of((t or "").encode())[0]), None) is None for t in texts
            ]

        docs = filter_rows(docs, [text_col], make)
    return docs


def aligned(docs: DataFrame, items) -> DataFrame:
    """MATCHES of (doc_id, text) with a block whose n-grams are its seeds."""

    def run(batches):
        block, schema = items.value, arrow_schema(MATCHES)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = (text or "").encode()
                    words, firsts, lasts = words_of(data)
                    for item, share, a, b in block.matches(words):
                        start = len(data[: firsts[a]].decode())
                        passage = data[firsts[a] : lasts[b]].decode()
                        rows.append((doc, block.ids[item], share, start, start + len(passage), passage))
                if rows:
                    columns = zip(zip(*rows, strict=True), schema, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=schema)

    return docs.mapInArrow(run, MATCHES)


@query("op4_decontaminate")
def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return copies_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
