"""Hard negatives of vectors, scored exactly in a residue number system.

Vectors become whole numbers. Scores are inner products of whole numbers, and
wanted exactly, while matrices are multiplied fastest in float32, which has
24 bits. So components are taken modulo several small primes, each so small that
a product of the matrices of residues stays under 2^24 and is exact; Chinese
remaindering puts the signed scores together again. How many primes it takes
follows from the greatest length of a vector (Cauchy-Schwarz).

Rows travel in packs, as matrices. Anchors are dealt into groups that fit a
task's memory and packs into parts; in a cell, one group meets one part: the
group is loaded, the packs pass by one at a time, and only the best rows of each
anchor are kept. Two passes are made: one for the positives of each anchor, one for
the negatives in the window of scores under each positive.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sysweave.llm.batches import arrow_schema, read, slices
from sysweave.llm.registry import query
from sysweave.session import cut

#: Rows of a pack, and bytes of components it is made from.
PACK_ROWS, PACK_BYTES = 4096, 8_000_000
#: Bytes of an anchor group's residues.
GROUP_BYTES = 64_000_000
#: Anchors and rows of a tile of scores.
TILE = 512, 1024
#: Dimensions that are summed in float32 at once.
SUMMED = 4096
#: Cells for each core, so that uneven ones even out.
CELLS = 3

PACKS = (
    "n int, n_anchors int, dims int, width int, norm double, ids binary, labels binary, chosen binary, parts binary"
)
ANCHORS = "id long, label long, width int, parts binary"


def quantised(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole components, rows that are whole, squared lengths) of an array of vectors.

    A component x is floor(scale * x); a row without a vector, or with a component
    that is null or not finite, is not whole. Shorter vectors end in zeros.
    """
    lengths = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    finite = np.isfinite(values)
    whole = vectors.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    whole &= np.bincount(owner[~finite], minlength=len(lengths)) == 0
    with np.errstate(over="ignore", invalid="ignore"):
        steps = np.floor(scale * np.where(finite, values, 0))
        made = np.zeros((len(lengths), int(lengths.max(initial=0))))
        made[owner, column] = steps
        norms = (made * made).sum(1)
    return np.clip(made, -(2.0**62), 2.0**62).astype(np.int64), whole, norms


def packed(rows: DataFrame, scale: float) -> DataFrame:
    """PACKS of the rows (id, label, chosen, vector) that take part."""

    def run(batches):
        schema = arrow_schema(PACKS)
        for batch in batches:
            for part in slices(batch, PACK_ROWS, PACK_BYTES):
                parts, whole, norms = quantised(part.column(3), scale)
                for c in (0, 1):
                    whole &= part.column(c).is_valid().to_numpy(zero_copy_only=False).astype(bool)
                if not whole.any():
                    continue
                ids, labels = (part.column(c).fill_null(0).to_numpy()[whole] for c in (0, 1))
                chosen = part.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)[whole]
                parts = parts[whole]
                width = 2 if np.abs(parts).max(initial=0) < 2**15 else 8
                row = [len(ids), int(chosen.sum()), parts.shape[1], width, float(norms[whole].max())]
                row += [x.tobytes() for x in (ids, labels, chosen, parts.astype(f"<i{width}"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema
                )

    return rows.mapInArrow(run, PACKS)


def matrix(parts: list[bytes], widths: list[int], rows: list[int], dims: int) -> np.ndarray:
    """The whole numbers of packs or anchors as one matrix of ``dims`` columns."""
    out = np.zeros((sum(rows), dims), np.int64)
    at = 0
    for data, width, n in zip(parts, widths, rows, strict=True):
        some = np.frombuffer(data, f"<i{width}").reshape(n, -1)
        out[at : at + n, : some.shape[1]] = some
        at += n
    return out


def anchors_of(packs: DataFrame) -> DataFrame:
    """ANCHORS, a row for each chosen row of the packs."""

    def run(batches):
        schema = arrow_schema(ANCHORS)
        for batch in batches:
            for row in slices(batch, rows=1):
                n, dims, width, ids, labels, chosen, parts = (c[0].as_py() for c in row.columns)
                at = np.flatnonzero(np.frombuffer(chosen, np.uint8))
                some = np.frombuffer(parts, f"<i{width}").reshape(n, dims)[at]
                columns = [
                    pa.array(np.frombuffer(ids, np.int64)[at]),
                    pa.array(np.frombuffer(labels, np.int64)[at]),
                    pa.array(np.full(len(at), width, np.int32)),
                    pa.array([x.tobytes() for x in some], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    wanted = packs.where("n_anchors > 0").select("n", "dims", "width", "ids", "labels", "chosen", "parts")
    return wanted.mapInArrow(run, ANCHORS)


@functools.lru_cache(maxsize=16)
def primes_for(dims: int, bound: int) -> tuple[int, ...]:
    """Primes whose products of residues are exact in float32 and that tell scores up to ``bound`` apart.

    Residues lie in -(p - 1) / 2 .. (p - 1) / 2, so ``dims`` products of two sum to
    under 2^24. The largest such primes are taken, two at least.
    """
    half = math.isqrt((2**24 - 1) // max(1, min(dims, SUMMED)))
    found, size = [], 1
    for p in range(2 * half + 1, 2, -2):
        if all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            size *= p
            if len(found) > 1 and size > 2 * bound + 1:
                return tuple(found)
    raise ValueError(f"no primes for scores up to {bound} in {dims} dimensions")


def residues(x: np.ndarray, primes) -> list[np.ndarray]:
    """The components modulo each prime, next to zero, in float32."""
    out = []
    for p in primes:
        r = np.remainder(x, p)
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Whole float64 numbers modulo an odd ``p``, next to zero."""
    return x - p * np.rint(x / p)


def product(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """x times y transposed modulo ``p``, next to zero, by products in float32."""
    total = 0.0
    for at in range(0, max(1, x.shape[1]), SUMMED):
        total = total + centred((x[:, at : at + SUMMED] @ y[:, at : at + SUMMED].T).astype(np.float64), p)
    return centred(total, p)


def scores(x: list[np.ndarray], y: list[np.ndarray], primes) -> np.ndarray:
    """Exact inner products of the rows whose residues are ``x`` and ``y``, as 64-bit integers.

    Chinese remaindering in mixed radix: a score is d0 + d1 p0 + d2 p0 p1 + .., and each
    digit, next to zero, follows from a residue and the digits before it.
    """
    digits: list[np.ndarray] = []
    out, radix = None, 1
    for a, b, p in zip(x, y, primes, strict=True):
        digit = product(a, b, p)
        if digits:
            known, weight = 0.0, 1
            for d, q in zip(digits, primes, strict=False):
                known = known + d * (weight % p)
                weight *= q
            digit = centred(centred(digit - known, p) * pow(weight, -1, p), p)
        digits.append(digit)
        whole = digit.astype(np.int64)
        out = whole if out is None else out + whole * radix
        radix *= p
    return out


class Best:
    """The ``k`` best rows of each of ``n`` lists: greatest score first, then least id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.floor = np.full(n, np.iinfo(np.int64).min)
        self.list, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        lists, score, ids = (
            np.concatenate(c)
            for c in zip((self.list, self.score, self.id), (lists, score, ids), strict=True)
        )
        order = np.lexsort((ids, -score, lists))
        lists, score, ids = lists[order], score[order], ids[order]
        rank = np.arange(len(lists)) - np.searchsorted(lists, lists)
        top = rank < self.k
        self.list, self.score, self.id = lists[top], score[top], ids[top]
        last = rank == self.k - 1
        self.floor[lists[last]] = score[last]


def tiles(n: int, size: int):
    return (slice(at, min(n, at + size)) for at in range(0, n, size))


CELL = "a int, r int, side int, key long, ids binary, labels binary, width int, parts binary"


def dealt(packs: DataFrame, anchors: DataFrame, groups: int, parts: int, *more: str) -> DataFrame:
    """CELL and the anchors' ``more`` columns, cell by cell, the anchors of a cell before its packs."""
    ends = F.sequence(F.lit(0), F.lit(groups - 1)), F.sequence(F.lit(0), F.lit(parts - 1))
    as_bytes = [F.lit(None).cast("binary").alias(c) for c in ("ids", "labels")]
    one = anchors.select(
        F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("a"),
        F.explode(ends[1]).alias("r"),
        F.lit(0).alias("side"), "key", "id", "label", *as_bytes, "width", "parts", *more,
    )
    none = F.lit(None).cast("long")
    two = packs.select(
        F.explode(ends[0]).alias("a"),
        F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("r"),
        F.lit(1).alias("side"), "key", none.alias("id"), none.alias("label"),
        "ids", "labels", "width", "parts",
        *(F.lit(None).cast("array<long>").alias(c) for c in more),
    )
    cells = one.unionByName(two).repartition(groups * parts, "a", "r")
    return cells.sortWithinPartitions("a", "r", "side", "key")


def over_cells(cells: DataFrame, ddl: str, dims: int, primes, start, see, end) -> DataFrame:
    """The columns ``ddl`` that ``end`` gives for each cell.

    ``start(keys, ids, labels, more)`` makes the state of a cell from its anchors;
    ``see(state, anchors, score, ids, labels)`` takes a tile of scores: a slice of
    anchors by some rows.
    """

    def run(batches):
        schema = arrow_schema(ddl)
        cell, group, state = None, [], None

        def closed():
            if state is not None:
                columns = end(state[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

        for batch in batches:
            for part in slices(batch, rows=1024, chars=32_000_000):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if row[:2] != cell:
                        yield from closed()
                        cell, group, state = row[:2], [], None
                    if row[2] == 0:
                        group.append(row[3:])
                        continue
                    if not group:
                        continue  # no anchor fell into this group
                    if state is None:
                        keys, ids, labels, _, _, width, data, *more = map(list, zip(*group, strict=True))
                        made = matrix(data, width, [1] * len(data), dims)
                        made = residues(made, primes)
                        state = start(keys, np.array(ids), np.array(labels), more), made
                        group = [None]
                    _, _, _, _, _, _, ids, labels, width, data, *_ = row
                    ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                    rows = residues(matrix([data], [width], [len(ids)], dims), primes)
                    for x in tiles(len(state[1][0]), TILE[0]):
                        left = [m[x] for m in state[1]]
                        for y in tiles(len(ids), TILE[1]):
                            see(state[0], x, scores(left, [m[y] for m in rows], primes), ids[y], labels[y])
        yield from closed()

    return cells.mapInArrow(run, ddl)


def first_of(df: DataFrame, by: list[str], score: str, other: str, n: int) -> DataFrame:
    """The first ``n`` rows by greatest score and least id, numbered in ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


POSITIVES = "key long, positive_id long, positive_score long"
NEGATIVES = "key long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def positives_in(cells: DataFrame, dims: int, primes, k: int) -> DataFrame:
    """POSITIVES: the ``k`` best other rows of its label, for each anchor and cell."""

    def start(keys, ids, labels, _):
        return np.array(keys), ids, labels, Best(len(ids), k)

    def see(state, x, score, ids, labels):
        _, own, label, best = state
        good = (label[x, None] == labels) & (own[x, None] != ids) & (score >= best.floor[x, None])
        a, b = np.nonzero(good)
        best.add(a + x.start, score[a, b], ids[b])

    def end(state):
        keys, _, _, best = state
        return keys[best.list], best.id, best.score

    return over_cells(cells, POSITIVES, dims, primes, start, see, end)


def negatives_in(cells: DataFrame, dims: int, primes, most: int, k: int, low: int, high: int) -> DataFrame:
    """NEGATIVES: the ``k`` best rows of other labels in the window under each of an
    anchor's positives, ``most`` at most, for each cell."""

    def start(keys, ids, labels, more):
        positive, score = more
        n = np.array([len(p) for p in positive])
        filled = np.zeros((2, most, len(ids)), np.int64)
        for i, both in enumerate(zip(positive, score, strict=True)):
            for to, values in zip(filled, both, strict=True):
                to[: len(values), i] = values
        # 100 * s within low * p and high * p, by whole numbers that stay small
        hundreds, rest = np.divmod(filled[1], 100)
        least, greatest = low * hundreds - (-low * rest // 100), high * hundreds + high * rest // 100
        greatest[np.arange(most)[:, None] >= n] = np.iinfo(np.int64).min
        return np.array(keys), ids, labels, filled, least, greatest, [Best(len(ids), k) for _ in range(most)]

    def see(state, x, score, ids, labels):
        _, _, label, _, least, greatest, best = state
        other = label[x, None] != labels
        for j, found in enumerate(best):
            from_, to = np.maximum(least[j, x], found.floor[x]), greatest[j, x]
            if (from_ > to).all():
                continue
            a, b = np.nonzero(other & (score >= from_[:, None]) & (score <= to[:, None]))
            if len(a):
                found.add(a + x.start, score[a, b], ids[b])

    def end(state):
        keys, own, _, filled, _, _, best = state
        columns = [
            (keys[f.list], own[f.list], np.full(len(f.list), j), filled[0, j, f.list], filled[1, j, f.list], f.id, f.score)
            for j, f in enumerate(best)
        ]
        return [np.concatenate(c) for c in zip(*columns, strict=True)]

    return over_cells(cells, NEGATIVES, dims, primes, start, see, end)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """FOUND: for each anchor and each of its positives the hard negatives.

    ``anchor`` says which rows are anchors (by default those whose id 100 divides). A
    row's score is its integer inner product with the anchor, components taken as
    floor(scale * x); higher scores come first, ties by the smaller id. An anchor's
    positives are its first ``positives`` rows of the same label and another id.
    Negatives of a pair are the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score.

    Rows with a null id, label or vector, or a component that is null or not finite,
    take no part. Shorter vectors count as if they ended in zeros, so an empty one scores 0.
    Repeated rows are rows of their own: each repeats in the results it is in, as an
    anchor too. Other columns are not looked at. Scores must be under 2^62, else
    an OverflowError tells so.
    """
    spark = vectors.sparkSession
    row_id, label = (F.col(f"`{c}`").cast("long") for c in (id_col, label_col))
    anchor = row_id % 100 == 0 if anchor is None else anchor
    rows = vectors.select(
        row_id.alias("id"), label.alias("label"), anchor.alias("chosen"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    )
    packs = cut(packed(rows, scale).withColumn("key", F.monotonically_increasing_id()))
    size = packs.agg(
        F.count("*").alias("packs"), F.sum("n_anchors").alias("anchors"), F.max("dims").alias("dims"), F.max("norm").alias("norm")
    ).first()
    if not size["anchors"]:
        return spark.createDataFrame([], FOUND)
    if not size["norm"] < 2.0**61:
        raise OverflowError(f"scores up to {size['norm']:.3g} are not under 2^62")
    dims, primes = size["dims"], primes_for(size["dims"], int(size["norm"] * (1 + 1e-9)) + 1)
    groups = math.ceil(size["anchors"] * max(1, dims) * 4 * len(primes) / GROUP_BYTES)
    parts = min(size["packs"], math.ceil(CELLS * spark.sparkContext.defaultParallelism / groups))
    anchors = cut(anchors_of(packs).withColumn("key", F.monotonically_increasing_id()))
    best = first_of(
        positives_in(dealt(packs, anchors, groups, parts), dims, primes, positives),
        ["key"], "positive_score", "positive_id", positives,
    )
    # ``positives`` rows of an anchor at most
    best = best.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("best")
    )
    named = best.select(
        "key", F.col("best.positive_id").alias("positive"), F.col("best.positive_score").alias("score")
    )
    anchors = cut(anchors.join(named, "key"))
    cells = dealt(packs, anchors, groups, parts, "positive", "score")
    found = negatives_in(cells, dims, primes, positives, negatives, low, high)
    return first_of(found, ["key", "place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


@query("op13_negatives")
def op13_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label))
