"""Byte-pair encoding and decoding.

The encoder does not replay merges. It walks a text left to right, takes the
longest token that starts at its position (found by an Aho-Corasick automaton
over the vocabulary) and keeps it if the pair with the token before it is one
that merging would leave apart; else it tries the next shorter token, and with
none left it steps back over the token before. Each position is given up at
most once, so the walk is linear in the text, and the result is the one the
merge rules give. Decoding gathers bytes by an offset table.
"""

from __future__ import annotations

import functools
import json

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import documents, map_rows, read
from sysweave.llm.registry import query

#: How byte-level BPE cuts a text before merging (a fixed value of the vocabulary).
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Distinct pieces and pairs a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Longer pieces are encoded each time.
LONGEST_KEPT = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable bytes stand for themselves; the others take the code points from
    256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Pieces of text to their token ids, as little-endian 32-bit bytes.

    A dictionary that fills itself: looking up a piece encodes it.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = byte_letters()
        vocab = made["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
        special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in word)
        # Ranks: single bytes first, then merges in order. Ids need not be ranks.
        self.rank_of, self.id_of, self.halves, self.merged = {}, [], [], {}
        for word, i in vocab.items():
            if len(word) == 1:
                self._rank(i, None)
        for a, b in merges:
            if a + b in vocab and vocab[a + b] not in self.rank_of:
                pair = (self.rank_of[vocab[a]], self.rank_of[vocab[b]])
                self.merged[pair] = self._rank(vocab[a + b], pair)
        self.length = [len(self.tokens[i]) for i in self.id_of]
        self.packed = [i.to_bytes(4, "little") for i in self.id_of]
        automaton = ahocorasick.Automaton()
        for rank, i in enumerate(self.id_of):
            automaton.add_word(self.tokens[i].decode("latin-1"), rank)
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = [self._prefix(self.tokens[i].decode("latin-1")) for i in self.id_of]
        self.compatible: dict[int, bool] = {}
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in special.items()}
        for k, i in special.items():
            self.tokens[i] = k.encode()
        self.cut_special = (
            regex.compile("(" + "|".join(regex.escape(k) for k in sorted(special, key=len, reverse=True)) + ")")
            if special
            else None
        )
        self.cut = regex.compile(PIECES).findall
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _rank(self, token_id: int, pair) -> int:
        rank = len(self.id_of)
        self.rank_of[token_id] = rank
        self.id_of.append(token_id)
        self.halves.append(pair or (rank, rank))
        return rank

    def _prefix(self, word: str) -> int:
        """The longest token that is a proper beginning of ``word``, or -1."""
        for n in range(len(word) - 1, 0, -1):
            found = self.automaton.get(word[:n], -1)
            if found >= 0:
                return found
        return -1

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves token ``a`` followed by token ``b`` as they are.

        Undo the later of the two merges again and again, and look whether the
        tokens at the seam would have merged before that.
        """
        key = a << 32 | b
        limit, ok = len(self.id_of), True
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < limit:
                ok = False
                break
            if a > b:
                limit = a
                left = self.halves[a][1]
                if left != a:
                    a = left
                    continue
                limit, right = b + 1, self.halves[b][0]
                if right == b:
                    break
                b = right
            else:
                limit = b + 1
                right = self.halves[b][0]
                if right != b:
                    b = right
                    continue
                limit, left = a, self.halves[a][1]
                if left == a:
                    break
                a = left
        if len(self.compatible) >= REMEMBERED:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def longest(self, text: str) -> list[int]:
        """For each position of ``text`` the longest token that starts there, by one scan."""
        best, length = [0] * len(text), self.length
        for end, rank in self.automaton.iter(text):  # a later end is a longer token
            best[end + 1 - length[rank]] = rank
        return best

    def walk(self, text: str) -> list[int]:
        """Ranks of the tokens of one piece, its bytes written as Latin-1 letters."""
        whole = self.automaton.get(text, -1)
        if whole >= 0:
            return [whole]
        best, length, shorter = self.longest(text), self.length, self.shorter
        compatible, size = self.compatible, len(text)
        given_up: set[int] = set()
        out: list[int] = []
        pos, token, last = 0, best[0], -1
        while True:
            end = pos + length[token]
            if end not in given_up:
                fits = last < 0 or compatible.get(last << 32 | token)
                if fits is None:
                    fits = self.apart(last, token)
                if fits:
                    out.append(token)
                    if end == size:
                        return out
                    pos, last, token = end, token, best[end]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                given_up.add(pos)
                token = out.pop()
                pos -= length[token]
                last = out[-1] if out else -1

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join([self.packed[r] for r in self.walk(piece.encode().decode("latin-1"))])
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.cut_special is None or not any(k in text for k in self.special):
            return b"".join(map(self.__getitem__, self.cut(text)))
        parts = self.cut_special.split(text)
        return b"".join(
            self.special[part]
            if part in self.special
            else b"".join(map(self.__getitem__, self.cut(part)))
            for part in parts
        )

    def decode(self, ids: bytes) -> str:
        """The text of token ids: each id's span of the byte table, end to end."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        starts = self.offsets[tokens]
        lengths = self.offsets[tokens + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        return self.blob[at].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a vocabulary file in a Python worker."""
    return Encoder(path)


def public_vocabulary() -> str:
    """Where the installed package of public tokenizers keeps its byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids as little-endian unsigned 32-bit integers.

    A null text is an empty one. Repeated rows give repeated rows; other
    columns are not looked at. ``path`` names a byte-level vocabulary file that
    every worker can open.
    """

    def make():
        enc = encoder(path)
        return lambda ids, texts: (ids, [enc.encode(t or "") for t in texts])

    return map_rows(documents(docs, id_col, text_col), make, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``encode``'s rows; null ids are no tokens."""

    def make():
        enc = encoder(path)
        return lambda ids, tokens: (ids, [enc.decode(t or b"") for t in tokens])

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` in one pass over the texts."""

    def make():
        enc = encoder(path)

        def both(ids, texts):
            encoded = [enc.encode(t or "") for t in texts]
            return ids, encoded, [enc.decode(t) for t in encoded]

        return both

    return map_rows(
        documents(docs, id_col, text_col), make, "doc_id long, ids binary, decoded string"
    )


def digests(trips: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``'s rows."""
    return trips.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op3_bpe")
def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(round_trip(read(spark, sf_dir, "documents"), public_vocabulary()))
