"""Line dedup by winnowing.

Lines are hashed. Every window of lines with at least ``min_words`` words gives
the least of its line-gram hashes as a fingerprint, so any run of that many
words that occurs twice has a fingerprint in both places. Fingerprints that
occur once are dropped; the windows of the others are joined by their whole
hash with the place where they came first. Matched windows that follow each
other make a run, which cannot reach further back (the window a line earlier
would match as well) and is extended line by line forwards; the later copy of
the run is deleted.

A line ends at a line feed and also where a sentence ends, as copies often lose
their line feeds. Lines are compared by their words, A-Z as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sysweave.llm.batches import arrow_schema, documents, read, slices
from sysweave.llm.ngramlm import ODD, mixed, powers, word_hashes
from sysweave.llm.registry import query
from sysweave.session import cut

#: Least words in a run that counts as repeated.
MIN_WORDS = 50
#: Least words in the line gram whose hash is a fingerprint.
GRAM_WORDS = 16
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?"]] = True


def hash_spans(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each span of ``values``: polynomials from running sums."""
    up, down = powers(1 << max(21, len(values).bit_length()))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    return mixed(h + (stop - start).astype(np.uint64) * np.uint64(ODD))


class Lines:
    """The lines of one text: first bytes, words and hashes, and spans of them."""

    def __init__(self, data: bytes):
        hashes, firsts, lasts = word_hashes(data.lower())
        coded = np.frombuffer(data, np.uint8)
        feeds = np.concatenate(([0], np.cumsum(coded == 10)))
        n = len(hashes)
        after = np.append(firsts[1:], len(data)) if n else firsts
        ends = (feeds[after] > feeds[lasts]) | (ENDS[coded[lasts - 1]] if n else False)
        if n:
            ends[-1] = True
        #: Number of the word after each line's last.
        self.stop = np.flatnonzero(ends) + 1
        self.start = np.concatenate(([0], self.stop[:-1])) if n else self.stop
        self.first_byte = firsts[self.start] if n else firsts
        self.hash = hash_spans(hashes, self.start, self.stop)

    def words(self) -> np.ndarray:
        return self.stop - self.start

    def reaching(self, words: int) -> np.ndarray:
        """For each line the first line by whose end ``words`` words have passed."""
        return np.searchsorted(self.stop, self.start + words)

    def windows(self, min_words: int, gram_words: int):
        """(first line, last line, hash, fingerprint, its line) of each window."""
        last = self.reaching(min_words)
        first = np.flatnonzero(last < len(self.stop))
        last = last[first]
        if not len(first):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64), none
        gram_last = self.reaching(gram_words)
        n_grams = int(np.searchsorted(gram_last, len(self.stop)))
        at = np.arange(n_grams)
        grams = hash_spans(self.hash, at, gram_last[:n_grams] + 1)
        # The last gram that ends in the window; a window holds one at least.
        until = np.searchsorted(gram_last[:n_grams], last, "right")
        # The least hash with its line in the low bits, so that ties go to the first.
        bits = np.uint64(max(1, n_grams.bit_length()))
        ranked = np.append(grams >> bits << bits | at.astype(np.uint64), np.uint64(2**64 - 1))
        pairs = np.stack((first, until), 1).ravel()
        least = np.minimum.reduceat(ranked, pairs)[::2]
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        return first, last, hash_spans(self.hash, first, last + 1), grams[place], place


PRINTS = "doc_id long, line int, print long, first array<int>, last array<int>, hash array<long>"


def prints_of(docs: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """A row for each fingerprint of (doc_id, text) with the windows it stands for, and
    one with line -1 for each document, whose ``hash`` has its lines and ``print`` its words."""

    def of_text(text: str | None):
        """(line, print, number of windows, number of hashes) of each row; first, last; hashes."""
        lines = Lines((text or "").encode())
        first, last, whole, gram, line = lines.windows(min_words, gram_words)
        # Windows of one fingerprint follow each other.
        start = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else line
        n = np.diff(np.append(start, len(line)))
        return (
            np.append(-1, line[start]),
            np.append(np.int64(lines.words().sum()), gram[start].view(np.int64)),
            np.append(0, n),
            np.append(len(lines.hash), n),
            first,
            last,
            np.concatenate((lines.hash, whole)).view(np.int64),
        )

    def lists(sizes: np.ndarray, values: np.ndarray, kind) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

    def run(batches):
        schema = arrow_schema(PRINTS)
        for batch in batches:
            for part in slices(batch):
                made = [of_text(t) for t in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
                line, gram, windows, hashes, first, last, whole = (
                    np.concatenate(c) for c in zip(*made, strict=True)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)),
                        pa.array(line, pa.int32()),
                        pa.array(gram),
                        lists(windows, first, pa.int32()),
                        lists(windows, last, pa.int32()),
                        lists(hashes, whole, pa.int64()),
                    ],
                    schema=schema,
                )

    return docs.mapInArrow(run, PRINTS)


def run_end(lines: np.ndarray, earlier: np.ndarray, shift: int, last: int) -> int:
    """The last line of a run of ``lines`` that has matched up to ``last`` with the lines
    ``shift`` places before them in ``earlier``."""
    n = max(0, min(len(lines), len(earlier) + shift) - last - 1)
    differs = lines[last + 1 : last + 1 + n] != earlier[last + 1 - shift : last + 1 - shift + n]
    return last + (int(np.argmax(differs)) if differs.any() else n)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_words, runs) of each document in (doc_id, text): first and last
    line of each run to delete, null if there is none."""
    found = cut(prints_of(docs, min_words, gram_words))
    prints = found.where("line >= 0 and doc_id is not null")
    # Written, so that a join with a hot key on one side can be split.
    repeated = cut(
        prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    )
    windows = cut(
        prints.join(repeated, "print")
        .select("doc_id", F.explode(F.arrays_zip("first", "last", "hash")).alias("w"))
        .select("doc_id", "w.first", "w.last", "w.hash")
    )
    place = F.struct("doc_id", "first")
    leads = cut(
        windows.groupBy("hash")
        .agg(F.min(place).alias("lead"), F.max(place).alias("end"))
        .where("lead <> end")
        .select("hash", "lead")
    )
    matches = (
        windows.join(leads, "hash")
        .where(place > F.col("lead"))
        .select(
            "doc_id",
            "first",
            "last",
            F.col("lead.doc_id").alias("earlier"),
            (F.col("first") - F.col("lead.first")).alias("shift"),
        )
    )
    # Runs of matched windows: where one begins, carried on to where it ends.
    along = Window.partitionBy("doc_id").orderBy("first")
    begins = F.col("first") - F.lag("first", 1, -2).over(along) > 1
    chains = (
        cut(matches)
        .select(
            "*",
            F.lead("first", 1, -2).over(along).alias("next"),
            F.when(begins, F.col("first")).alias("begins"),
        )
        .withColumn("start", F.max("begins").over(along))
        .where("next < 0 or next > first + 1")
        .select("doc_id", "start", "last", "earlier", "shift")
    )
    lines = (
        found.where("line < 0 and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("hash").alias("lines"), F.min("print").alias("n_words"))
    )
    others = lines.select(F.col("doc_id").alias("earlier"), F.col("lines").alias("others"))
    both = (
        cut(chains)
        .join(lines.select("doc_id", "lines"), "doc_id")
        .join(others, "earlier")
        .select("doc_id", "start", "last", "shift", "lines", "others")
    )

    def run(batches):
        schema = arrow_schema("doc_id long, run array<int>")
        for batch in batches:
            for part in slices(batch):
                starts, lasts, shifts = (part.column(c).to_pylist() for c in (1, 2, 3))
                runs = [
                    [a, run_end(np.asarray(x.values), np.asarray(y.values), shift, b)]
                    for a, b, shift, x, y in zip(
                        starts, lasts, shifts, part.column(4), part.column(5), strict=True
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(runs, schema[1].type)], schema=schema
                )

    runs = (
        both.mapInArrow(run, "doc_id long, run array<int>")
        .groupBy("doc_id")
        .agg(F.flatten(F.collect_set("run")).alias("runs"))
    )
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "n_words").join(
        runs, "doc_id", "left"
    )


def without_runs(text: str, runs: list[int]) -> tuple[str, int, int, int, int]:
    """(text without the runs of lines, lines, lines deleted, words, words deleted)."""
    data = text.encode()
    lines = Lines(data)
    words = lines.words()
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, np.minimum(runs[::2], len(words)).astype(np.int64), 1)
    np.add.at(gone, np.minimum(np.array(runs[1::2], np.int64) + 1, len(words)), -1)
    gone = np.cumsum(gone[:-1]) > 0
    if gone.any():
        edges = np.concatenate((lines.first_byte, [len(data)]))
        kept = [data[: edges[0]], *(data[edges[i] : edges[i + 1]] for i in np.flatnonzero(~gone))]
        text = b"".join(kept).decode()
    return text, len(words), int(gone.sum()), int(words.sum()), int(words[gone].sum())


CLEANED = "text string, n_lines long, n_removed long, n_words long, n_removed_words long"


def line_dedup(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    gram_words: int = GRAM_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with repeated runs of lines taken out of the texts, and four counts more.

    A window is a line and those after it until ``min_words`` words have passed.
    It is repeated if it occurs at an earlier place, places being ordered by
    doc_id and line. Deleted are repeated windows, and after the last of
    repeated windows that begin line after line also the lines that follow as
    they do at that window's first place. Rows that share a doc_id are one
    document; rows without one are kept as they are. A null text stays null.
    Other columns are passed through; those named like the four counts are
    replaced.
    """
    if gram_words > min_words:
        raise ValueError("a line gram must fit a window")
    counts = [part.split()[0] for part in CLEANED.split(", ")][1:]
    docs = docs.drop(*counts)
    runs = repeated_runs(documents(docs, id_col, text_col), min_words, gram_words)
    others = [c for c in docs.columns if c != text_col]
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
    ).join(runs, "doc_id", "left")

    def run(batches):
        for batch in batches:
            schema = pa.schema([batch.schema.field("others"), *arrow_schema(CLEANED)])
            for part in slices(batch):
                made = []
                rows = zip(*(part[c].to_pylist() for c in ("text", "n_lines", "n_words", "runs")), strict=True)
                for text, n_lines, n_words, some in rows:
                    if some or n_lines is None:
                        clean = without_runs(text or "", some or [])
                        made.append((None if text is None else clean[0], *clean[1:]))
                    else:
                        made.append((text, n_lines, 0, n_words, 0))
                columns = zip(zip(*made, strict=True), list(schema)[1:], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part["others"], *[pa.array(c, f.type) for c, f in columns]], schema=schema
                )

    made_of = T.StructType([wide.schema["others"], *T.StructType.fromDDL(CLEANED).fields])
    cleaned = wide.select("others", "text", "n_lines", "n_words", "runs").mapInArrow(run, made_of)
    return cleaned.select(
        *[
            F.col("text").alias(c) if c == text_col else F.col("others").getField(c).alias(c)
            for c in docs.columns
        ],
        *counts,
    )


@query("op2_linededup")
def op2_linededup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "n_words", "n_removed_words", "text")
