"""Documents packed into sequences of one length, in their order.

The tokens of a task's documents follow each other as one stream. Dynamic
programming chooses where sequences end: at the ends of documents, which costs
nothing, of sentences, or, in long sentences only, between. The cost of a way to
cut the stream is its padding, a penalty for each document or sentence cut apart, and
a charge for each sequence; the least cost at a place comes from one of the places
up to a sequence before it, whose minimum a monotone queue hands on, or from a power
of two before it, where a sequence has no padding. So each place takes constant time.

The stream is worked on in blocks. What follows the cheapest place of a block's
last sequence goes over into the next block, so only a task's last sequence is
shorter than its place in the order asks for.
"""

from __future__ import annotations

import functools
import json
import re
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sysweave.llm import bpe
from sysweave.llm.batches import arrow_schema, documents, read, slices
from sysweave.llm.registry import query

#: Tokens of a block.
BLOCK = 1 << 20
#: Sentences of more tokens may be cut every so many tokens.
LONG = 64
#: Texts with so much white space in one place are encoded another way.
BLANKS = 2000
#: The least power of two that a sequence may have without padding; a task's last tokens may go below.
LEAST = 32
#: Sequences of a task are numbered from its partition's number times this on.
NUMBERS = 1 << 40

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Token ids of texts for a byte-level vocabulary file, and where sentences may end."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = bpe.byte_letters()
        vocab, special = made["model"]["vocab"], {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        words = {
            bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special
        }
        merges = [m if isinstance(m, str) else " ".join(m) for m in made["model"]["merges"]]
        ranks = [vocab[m.replace(" ", "")] for m in merges]
        own = functools.partial(bpe.encoder, path)  # made where it is needed
        if ranks == sorted(ranks) and min(ranks, default=256) >= max(words[bytes([b])] for b in range(256)):
            fast = tiktoken.Encoding(path, pat_str=bpe.PIECES, mergeable_ranks=words, special_tokens={})
            blanks = re.compile(rf"\s{{{BLANKS}}}").search

            def plain(text: str):
                # That library's stack does not hold very long white space.
                return np.frombuffer(own().encode(text), "<u4") if blanks(text) else fast.encode_ordinary(text)

            self.plain = plain
        else:  # ids that do not follow the merges
            self.plain = lambda text: np.frombuffer(own().encode(text), "<u4")
        self.special = special
        self.cut_special = regex.compile(
            "(" + "|".join(regex.escape(k) for k in sorted(special, key=len, reverse=True)) + ")"
        )
        size = max([*words.values(), *special.values()]) + 1
        self.ends, self.stops, self.opens = (np.zeros(size, bool) for _ in range(3))
        for word, i in words.items():
            text = word.decode("utf-8", "replace")
            self.ends[i] = "\n" in text or bool(re.search("[。！？]", text))
            self.stops[i] = bool(re.search("[.!?…][\"')\\]»”’]*$", text))
            self.opens[i] = text[:1].isspace()

    def ids(self, text: str) -> np.ndarray:
        if not any(k in text for k in self.special):
            return np.array(self.plain(text), "<u4")
        parts = [
            [self.special[part]] if part in self.special else self.plain(part)
            for part in self.cut_special.split(text)
        ]
        return np.concatenate([np.array(p, "<u4") for p in parts])

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """The places after which a sentence of ``ids`` ends."""
        return np.flatnonzero(self.ends[ids[:-1]] | (self.stops[ids[:-1]] & self.opens[ids[1:]])) + 1


@functools.lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


class Costs:
    """Sequences of ``window`` tokens; what it costs to end one inside a document after a
    sentence, or inside a sentence, and what a sequence costs by itself, all in tokens of padding."""

    def __init__(self, window: int, sentence: int, inside: int, sequence: int):
        self.window, self.sentence, self.inside, self.sequence = window, sentence, inside, sequence
        self.powers = [1 << i for i in range(window.bit_length()) if 1 << i < window]

    def padding(self, length: int) -> int:
        return 0 if length & (length - 1) == 0 else self.window - length


def places(size: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, costs: Costs) -> tuple[list, list]:
    """(place, penalty) of every place of ``size`` tokens where a sequence may end, in order."""
    ends = np.unique(np.concatenate((doc_ends, sentence_ends, [size])))
    penalty = np.full(len(ends), costs.inside)
    penalty[np.isin(ends, sentence_ends)] = costs.sentence
    penalty[np.isin(ends, doc_ends)] = 0
    step = min(LONG, costs.window)
    before = np.concatenate(([0], ends[:-1]))
    more = (ends - before - 1) // step
    within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    extra = np.repeat(before, more) + step * within
    ends, penalty = np.concatenate((ends, extra)), np.concatenate((penalty, np.full(len(extra), costs.inside)))
    order = np.argsort(ends, kind="stable")
    return ends[order].tolist(), penalty[order].tolist()


def least_costs(place: list, penalty: list, costs: Costs) -> tuple[list, list]:
    """(cost, place before) of the cheapest way to end a sequence at place 0 and at each further place."""
    window, charge = costs.window, costs.sequence
    powers = [p for p in costs.powers if p >= LEAST]
    at = [0, *place]
    number = {x: i for i, x in enumerate(at)}
    cost, back = [0], [-1]
    queue = deque([(0, 0, 0)])  # (cost + place, place, number): costs rise from left to right
    for j in range(1, len(at)):
        x = at[j]
        while queue[0][1] < x - window:
            queue.popleft()
        sum_, _, i = queue[0]
        best = sum_ + window - x
        for p in powers:
            k = number.get(x - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += charge + penalty[j - 1]
        cost.append(best)
        back.append(i)
        key = best + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, x, j))
    return cost, back


def cuts(place: list, penalty: list, costs: Costs, last: bool) -> list[int]:
    """The ends of sequences, in order: of all the tokens if they are the ``last``, else up
    to the cheapest place that is at most a sequence from the end."""
    cost, back = least_costs(place, penalty, costs)
    at = [0, *place]
    end, tail = at[-1], []
    near = [i for i in range(len(at)) if end - costs.window <= at[i] < end]
    if last:
        # The rest may end in powers of two, cut anywhere.
        def in_powers(i: int) -> int:
            n = (end - at[i]).bit_count()
            return cost[i] + n * costs.sequence + (n - 1) * costs.inside

        best = min(near, key=in_powers)
        if in_powers(best) < cost[-1]:
            for p in reversed(costs.powers):
                if (end - at[best]) & p:
                    tail.append((tail[-1] if tail else at[best]) + p)
        else:
            best = len(at) - 1
    else:
        best = min(near, key=lambda i: (cost[i], -at[i]))
    out = []
    while best > 0:
        out.append(at[best])
        best = back[best]
    return out[::-1] + tail


class Packer:
    """Packs the documents of one task."""

    def __init__(self, tokens: Tokens, costs: Costs, end: int, number: int):
        self.tokens, self.costs, self.number = tokens, costs, number
        self.end = np.array([end], "<u4")
        self.block = max(BLOCK, 2 * costs.window)
        self.schema = arrow_schema(PIECES)
        self.rows: deque = deque()  # (doc_id, its tokens before these, tokens, all its tokens)
        self.waiting = 0

    def add(self, doc_id, text: str) -> None:
        ids = np.concatenate((self.tokens.ids(text), self.end))
        self.rows.append((doc_id, 0, ids, len(ids)))
        self.waiting += len(ids)

    def full(self):
        """The pieces of whole blocks."""
        while self.waiting >= self.block:
            yield self.pack()

    def rest(self):
        yield from self.full()
        if self.waiting:
            yield self.pack(last=True)

    def pack(self, last: bool = False) -> pa.RecordBatch:
        rows, size = [], 0
        while self.rows and size < self.block:
            doc_id, before, ids, total = self.rows.popleft()
            if size + len(ids) > self.block:
                self.rows.appendleft((doc_id, before + self.block - size, ids[self.block - size :], total))
                ids = ids[: self.block - size]
            rows.append((doc_id, before, ids, total))
            size += len(ids)
        doc_ids, before, parts, total = zip(*rows, strict=True)
        before, total, sizes = np.array(before), np.array(total), np.array([len(p) for p in parts])
        ids, part_ends = np.concatenate(parts), np.cumsum(sizes)
        doc_ends = part_ends[before + sizes == total]
        place, penalty = places(size, doc_ends, self.tokens.sentence_ends(ids), self.costs)
        ends = np.array(cuts(place, penalty, self.costs, last))
        packed = int(ends[-1])
        borders = np.concatenate(([0], np.union1d(ends, part_ends[part_ends < packed])))
        begin = borders[:-1]
        doc, sequence = np.searchsorted(part_ends, begin, "right"), np.searchsorted(ends, begin, "right")
        offsets = pa.py_buffer((4 * borders).astype(np.int32).tobytes())
        columns = [
            pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()),
            pa.array(begin - (part_ends - sizes)[doc] + before[doc]),
            pa.array(np.diff(borders)),
            pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(ids[:packed].tobytes())]),
            pa.array(total[doc]),
            pa.array(self.number + sequence),
            pa.array(begin - np.concatenate(([0], ends))[sequence]),
        ]
        self.number += len(ends)
        self.waiting -= packed
        for d in range(len(rows) - 1, int(np.searchsorted(part_ends, packed, "right")) - 1, -1):
            doc_id, first, part, all_ = rows[d]
            gone = max(0, packed - int(part_ends[d] - sizes[d]))
            self.rows.appendleft((doc_id, first + gone, part[gone:], all_))
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def pack(
    docs: DataFrame,
    path: str,
    window: int = 1024,
    end: int = 0,
    sentence: int = 4,
    inside: int = 32,
    sequence: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """PIECES: the documents' tokens in sequences of at most ``window``, in the order of the rows.

    A document's tokens are its text's ids, by the byte-level vocabulary file
    ``path``, and the id ``end``. A piece is a stretch of one document's tokens
    in one sequence: ``start`` counts the document's tokens before it, ``offset`` the
    sequence's; ``ids`` are little-endian unsigned 32-bit integers. Sequences are padded to
    ``window`` unless their length is a power of two. ``sentence`` and ``inside`` are
    the penalties for a sequence that ends inside a document, after a sentence or inside one,
    and ``sequence`` the charge for each sequence, in tokens of padding; among equal
    costs the earlier cut is taken.

    Each partition of ``docs`` is a stream of its own. Null and empty texts are the one
    token ``end``. Repeated rows and rows without an id are documents of their own, packed
    like others; other columns are not looked at. A very long text is encoded as one
    value and cut like any stretch of the stream.
    """
    costs = Costs(window, sentence, inside, sequence)

    def run(batches):
        tokens, task = tokens_of(path), TaskContext.get()
        packer = Packer(tokens, costs, end, (task.partitionId() if task else 0) * NUMBERS)
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    packer.add(doc_id, text or "")
                    yield from packer.full()
        yield from packer.rest()

    return documents(docs, id_col, text_col).mapInArrow(run, PIECES)


@query("op11_packing")
def op11_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), bpe.public_vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
