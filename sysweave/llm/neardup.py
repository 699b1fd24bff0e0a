"""Near-duplicate documents by MinHash.

A text is its set of word shingles. Many universal hash functions give a
signature of minima; documents that agree in a band of minima are candidates.
Texts with the same set are one node from the start, so copies cost nothing
further. In each band's bucket a node is first compared with the bucket's least
node, so a bucket of n nodes makes n - 1 pairs. The buckets of one least node are a
group. Groups that then still join different components are cut into cells in which all
their nodes of different components meet, so a group that fills the buckets of many bands
is gone through once. The nodes of groups too large for that are bucketed anew by longer bands over the same
signatures, and those buckets are cut into cells. A cell's nodes whose signatures may be linked to one of another component meet
again with their full sets, and each cell gives links that join what is linked in it, fewer than it has
nodes: pairs that are not linked are told apart there and never become rows. Every link is confirmed on
the full sets, and components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import arrow_schema, documents, read, slices
from sysweave.llm.ngramlm import ODD, mixed, tokens_of
from sysweave.llm.registry import query
from sysweave.session import cut

#: Minima in a band and bands: a pair at 0.8 misses all bands once in two million.
ROWS, BANDS = 6, 48
#: A pair goes on if its signature's share of equal minima is at most this many
#: standard deviations under the threshold.
DEVIATIONS = 6
#: Nodes of a block at most.
BLOCK = 512
#: Cells that a node of a group taken whole is put into at most, in the mean. Larger groups get longer bands.
CELLS = 64
#: Minima in a longer band, and how many such bands the nodes of larger groups get. Of two nodes that
#: agree in 3 of 4 minima, the first bands miss one pair in forty, all rounds together one in 1,600.
LONGER, WIDE = 10, 64
#: Shingles of a half of a tile: the sets that are held at once.
HELD = 1_000_000
#: Candidates a node meets in a cell, round by round: all that may be linked.
ROUNDS = (None, None)
#: Bits of the filter of documents whose texts are fetched (8 MB).
FILTER_BITS = 1 << 26
SEED = 20_240_229


def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and shifts of multiply-shift hashing, a row each."""
    made = np.random.Generator(np.random.PCG64(SEED))
    a, b = made.integers(0, 2**64, (2, ROWS * BANDS, 1), np.uint64, endpoint=False)
    return a | np.uint64(1), b


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """The distinct hashed shingles of ``k`` words of each text, sorted.

    A-Z count as a-z. A text of fewer words is one shingle, one without words
    has none.
    """
    _, token, owner = tokens_of(texts)
    ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else owner
    out, start = [], 0
    for end in ends:
        words = token[start:end]  # without the end of the text
        start = end + 1
        width = min(k, len(words))
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            rolled = rolled * np.uint64(ODD) + words[j : len(words) - width + 1 + j]
        out.append(np.unique(mixed(rolled + np.uint64(width))) if width else rolled[:0])
    return out


def signature(shingles: np.ndarray, functions) -> np.ndarray:
    """The least value of each hash function over a set."""
    a, b = functions
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024] * a + b).min(1), out=least)
    return least >> np.uint64(32)


SETS = "doc_id long, n_shingles long, digest binary, bands array<long>, minima binary"


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """SETS of (doc_id, text): the size and digest of each set, the hash of each band
    and the last byte of each minimum."""

    def run(batches):
        functions, schema = hash_functions(), arrow_schema(SETS)
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(ODD)
        for batch in batches:
            for part in slices(batch, chars=1_000_000):
                sizes, digests, bands, minima = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), k):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if not len(s):
                        bands.append(None)
                        minima.append(None)
                        continue
                    least = signature(s, functions)
                    band = salt
                    for row in least.reshape(BANDS, ROWS).T:
                        band = mixed(band + row)
                    bands.append(band.view(np.int64))
                    minima.append(least.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *[
                            pa.array(c, f.type)
                            for c, f in zip((sizes, digests, bands, minima), list(schema)[1:], strict=True)
                        ],
                    ],
                    schema=schema,
                )

    return docs.mapInArrow(run, SETS)


def least_share(percent: int) -> float:
    """The least share of equal last bytes that a pair at the threshold can be expected to have."""
    j, n = percent / 100, ROWS * BANDS
    equal = j + (1 - j) / 256
    return equal - DEVIATIONS * (equal * (1 - equal) / n) ** 0.5


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough."""
    least = least_share(percent)

    def run(batches):
        for batch in batches:
            for part in slices(batch, rows=4096):
                x, y = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(len(part), -1)
                    for c in (2, 3)
                )
                good = (x == y).mean(1) >= least if len(part) else np.zeros(0, bool)
                yield part.select(["a", "b"]).filter(pa.array(good))

    one = nodes.select(F.col("node").alias("a"), F.col("minima").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("minima").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        known, seen = np.zeros(0, np.uint64), None
        for batch in batches:
            for part in slices(batch, chars=1_000_000):
                texts, others = (part.column(c).to_pylist() for c in (2, 3))
                good = []
                for text, two in zip(texts, shingle_sets(others, k), strict=True):
                    if text != seen:  # pairs of one node come together
                        known, seen = shingle_sets([text], k)[0], text
                    both = len(np.intersect1d(known, two, assume_unique=True))
                    good.append(100 * both >= percent * (len(known) + len(two) - both))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def longer(bands: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The minima of each of ``bands`` longer bands, and their weights in its key."""
    made = np.random.Generator(np.random.PCG64([SEED, seed]))
    chosen = np.stack([made.permutation(ROWS * BANDS)[:LONGER] for _ in range(bands)])
    return chosen, made.integers(0, 2**64, chosen.shape, np.uint64, endpoint=False) | np.uint64(1)


def keyed(nodes: DataFrame, bands: int, seed: int) -> DataFrame:
    """(key, node, component) for the rows (node, component, minima): a key for each of ``bands`` longer bands.
    A key modulo ``bands``, a power of two, is the band's number."""

    def run(batches):
        chosen, weights = longer(bands, seed)
        for batch in batches:
            for part in slices(batch, rows=1024):
                minima = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(part), -1)
                columns = [
                    mixed((minima[:, c].astype(np.uint64) * w).sum(1, dtype=np.uint64) + w[0])
                    for c, w in zip(chosen, weights, strict=True)
                ]
                keys = np.stack(columns, 1) & ~np.uint64(bands - 1) | np.arange(bands, dtype=np.uint64)
                keys = keys.view(np.int64).ravel()
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(keys))],
                    names=["node", "component", "keys"],
                )

    found = nodes.select("node", "component", "minima").mapInArrow(run, "node long, component long, keys array<long>")
    return found.select(F.explode("keys").alias("key"), "node", "component")


def named_in(rows: list, percent: int, top: int | None) -> list[tuple[int, int]]:
    """For the rows (node, component, minima) of a block: of each node outside the largest component
    the ``top`` nodes of other components that are the likeliest to be linked to it, or all that may be."""
    node, component, minima = zip(*rows, strict=True)
    pairs = set()
    for x, others, equal in likely_in(component, minima, percent):
        for y in others[np.argsort(-equal, kind="stable")[:top]]:
            pairs.add((min(node[x], node[y]), max(node[x], node[y])))
    return sorted(pairs)


def likely_in(component, minima, percent: int):
    """(x, others, equal): for each row outside the largest component the rows of other components that may be
    linked to it, and how many minima are equal."""
    bits = np.frombuffer(b"".join(minima), np.uint8).reshape(len(component), -1)
    least = least_share(percent) * bits.shape[1]
    component = np.unique(component, return_inverse=True)[1]
    for x in np.flatnonzero(component != np.bincount(component).argmax()):
        others = np.flatnonzero(component != component[x])
        equal = (bits[others] == bits[x]).sum(1)
        good = equal >= least
        if good.any():
            yield x, others[good], equal[good]


def tiles_in(rows: list, percent: int, earlier: np.ndarray, less: list | None = None) -> list[tuple[int, int, int]]:
    """(tile, node, component) for the rows (node, component, minima, n_shingles) of a cell: the nodes that may be
    linked to one of another component and do not meet it in one of the ``earlier`` bands, nor in a group
    that is in the set ``less`` of both. A cell whose sets are too large to be held at once is cut into halves of tiles, and every two halves with
    such a pair are a tile."""
    node, component, minima, sizes = zip(*rows, strict=True)
    bits = np.frombuffer(b"".join(minima), np.uint8).reshape(len(node), -1)
    half = np.cumsum(sizes) // HELD
    half = np.unique(half, return_inverse=True)[1]
    count, tiles = int(half.max()) + 1, {}
    for x, others, _ in likely_in(component, minima, percent):
        equal = bits[others] == bits[x]
        others = others[~equal[:, earlier].all(2).any(1)]
        if less and less[x]:
            others = others[[less[x].isdisjoint(less[y]) for y in others]]
        for h in np.unique(half[others]):
            tile = int(min(h, half[x]) * count + max(h, half[x]))
            members = tiles.setdefault(tile, np.zeros(len(node), bool))
            members[x] = True
            members[others[half[others] == h]] = True
    return sorted({(tile, node[i], component[i]) for tile, members in tiles.items() for i in np.flatnonzero(members)})


def links_in(rows: list, percent: int) -> list[tuple[int, int]]:
    """For the rows (node, component, shingles) of a tile: links between nodes of different components that join
    all that is linked in it, by their full sets."""
    node, component, sets = zip(*rows, strict=True)
    component = np.unique(component, return_inverse=True)[1]
    sets = [np.frombuffer(s, np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    held, out = np.zeros(len(values), bool), []
    for x in np.flatnonzero(component != np.bincount(component).argmax()):
        own = place[starts[x] : starts[x] + sizes[x]]
        held[own] = True
        both = np.add.reduceat(held[place], starts, dtype=np.int64)
        held[own] = False
        for y in np.flatnonzero(100 * both >= percent * (sizes[x] + sizes - both)):
            if component[y] != component[x]:
                out.append((min(node[x], node[y]), max(node[x], node[y])))
                component[component == component[y]] = component[x]
    return out


def grouped(batches, width: int, rows: int = 1024):
    """(key, rows): the rows of each value of the first ``width`` columns, which come together."""
    key, block = None, []
    for batch in batches:
        for part in slices(batch, rows=rows):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[:width] != key:
                    if block:
                        yield key, block
                    key, block = row[:width], []
                block.append(row[width:])
    if block:
        yield key, block


def table_of(rows: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], pa.int64()) for c in columns], names=names)


def layout(found: DataFrame) -> DataFrame:
    """(key, n, largest, strips, parts, placed) of the buckets of the rows (key, node, component) that join different
    components: how each is cut into cells, and the rows that makes.

    A bucket of more than a block is cut into cells, strips of the nodes outside its largest component by
    parts of all its nodes, half a block each. So each of those nodes meets every node of another
    component, and no task holds more than a cell. With up to half a block of such nodes there is one strip,
    over at most twice the bucket's rows.
    """
    half = BLOCK // 2
    return (
        found.groupBy("key", "component")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components"))
        .where("components > 1")
        .select("key", "n", F.col("most.component").alias("largest"), (F.col("n") - F.col("most.n")).alias("others"))
        .withColumn("strips", F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("others") / half)).cast("int"))
        .withColumn(
            "parts",
            F.when(F.col("n") <= BLOCK, 1)
            .when(F.col("others") <= half, F.ceil((F.col("n") - F.col("others")) / (BLOCK - F.col("others"))))
            .otherwise(F.ceil(F.col("n") / half))
            .cast("int"),
        )
        .withColumn("placed", F.col("n") * F.col("strips") + F.col("others") * (F.col("parts") - 1))
        .drop("others")
    )


def cells(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, part, node, component): the cells in which the nodes of different components of the buckets of the rows
    (key, node, component) meet, cut as ``wanted`` (a ``layout``) says."""
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    strip = F.pmod(F.xxhash64("node", F.lit(1)), F.col("strips"))
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("strips").cast("long") - 1), lambda i: i * F.col("parts") + own)
    along = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda j: strip * F.col("parts") + j)
    part = F.when(F.col("component") == F.col("largest"), across).otherwise(F.array_union(along, across))
    return found.join(wanted, "key").select("key", F.explode(part).alias("part"), "node", "component")


def banded_cells(nodes: DataFrame, seed: int) -> DataFrame:
    """The cells of the longer bands' buckets of ``nodes`` (node, component, minima)."""
    found = cut(keyed(nodes, WIDE, seed))
    return cells(found, cut(layout(found)))


def candidates(nodes: DataFrame, percent: int, top: int | None, seed: int) -> DataFrame:
    """Pairs (a, b) among ``nodes`` (node, component, minima) of different components that meet in a cell and
    may be linked, the ``top`` likeliest ones of a node there or all. All are as many as the square of
    a group of near copies; ``links`` gives what is linked without them."""
    rows = banded_cells(nodes, seed).join(nodes.drop("component"), "node")
    rows = rows.select("key", "part", "node", "component", "minima")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "node")

    def run(batches):
        for _, block in grouped(batches, 2):
            yield table_of(named_in(block, percent, top), ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, texts: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """Links (a, b) that join all ``nodes`` (node, component, minima, n_shingles) of different components that are
    linked by their full sets and meet in a cell, but in none of the rounds before ``seed``, which must have seen
    all these nodes; ``texts`` are (doc_id, text)."""
    rows = banded_cells(nodes, seed).join(nodes.drop("component"), "node")
    rows = rows.select("key", "part", "node", "component", "minima", "n_shingles")

    def near(batches):
        before = [longer(WIDE, s)[0] for s in range(seed)]
        bands = longer(WIDE, seed)[0]
        for key, block in grouped(batches, 2):
            earlier = np.concatenate([*before, bands[: key[0] % WIDE]])
            found = [(*key, *row) for row in tiles_in(block, percent, earlier)]
            yield table_of(found, ["key", "part", "tile", "node", "component"])

    return joining(rows, near, texts, k, percent)


def group_links(groups: DataFrame, wanted: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join all nodes of different components that are linked by their full sets and share one of
    the ``groups`` (key, node, component) that ``wanted`` (a ``layout``) lists; ``nodes`` are (node,
    minima, n_shingles). Two nodes are compared in the least of the groups they share."""
    own = groups.join(wanted.select("key"), "key").groupBy("node").agg(F.collect_set("key").alias("keys"))
    rows = cells(groups, wanted).join(cut(own.join(nodes, "node")), "node")
    rows = rows.select(
        "key", "part", "node", "component", "minima", "n_shingles", F.filter("keys", lambda x: x < F.col("key")).alias("less")
    )

    def near(batches):
        none = np.zeros((0, LONGER), np.int64)
        for key, block in grouped(batches, 2):
            less = [frozenset(row[-1]) for row in block]
            found = [(*key, *row) for row in tiles_in([row[:-1] for row in block], percent, none, less)]
            yield table_of(found, ["key", "part", "tile", "node", "component"])

    return joining(rows, near, texts, k, percent)


def joining(rows: DataFrame, near, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is linked in the tiles that ``near`` gives for the ``rows`` of each cell
    (key, part); ``texts`` are (doc_id, text)."""
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "node")

    def full(batches):
        for batch in batches:
            for part in slices(batch, chars=1_000_000):
                sets = [s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), k)]
                got = pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
                yield got.filter(pa.array([bool(s) for s in sets], pa.bool_()))

    def run(batches):
        for _, tile in grouped(batches, 3, rows=64):
            yield table_of(links_in(tile, percent), ["a", "b"])

    met = cut(rows.mapInArrow(near, "key long, part long, tile long, node long, component long"))
    wanted = met.select(F.col("node").alias("doc_id")).distinct()
    sets = cut(texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(full, "node long, shingles binary"))
    held = met.join(sets, "node").select("key", "part", "tile", "node", "component", "shingles")
    held = held.repartition("key", "part", "tile").sortWithinPartitions("key", "part", "tile", "node")
    return held.mapInArrow(run, "a long, b long").distinct()


def filter_of(ids: DataFrame) -> DataFrame:
    """A filter of FILTER_BITS bits for the numbers in the column ``id``: (filter_part, filter_bits),
    a row for each 32768 bits at most, so its size has a bound whatever the input."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    return ids.groupBy(F.bitmap_bucket_number(bit).alias("filter_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("filter_bits")
    )


def passing(rows: DataFrame, id_col: str, ids: DataFrame, want: bool = True) -> DataFrame:
    """The rows whose number may be among ``ids`` (its column ``id``), or those whose number is not."""
    bit = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.expr("substring(filter_bits, cast(filter_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.expr("shiftright(filter_byte, cast(filter_place % 8 as int)) & 1") == 1
    made = rows.withColumns({"filter_part": F.bitmap_bucket_number(bit), "filter_place": place})
    made = made.join(F.broadcast(filter_of(ids)), "filter_part", "left").withColumn("filter_byte", byte)
    return made.where(F.coalesce(held, F.lit(False)) == F.lit(want)).select(*(f"`{c}`" for c in rows.columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of the edges (a, b).

    Large-star hangs a node's greater neighbours on the least of its
    neighbourhood, small-star does the same with the smaller ones, in turn until
    nothing moves. A node with very many neighbours is only a hot join key.
    Each round is written to the shared folder.
    """
    edges = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join of a node with very many neighbours can be split.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = cut(small)


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after the ``links`` (a, b) between its nodes and others."""
    links = cut(links)
    if links.isEmpty():
        return found
    before = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return cut(components(links.unionByName(before)))


def open_groups(led: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, component): the rows (node, lead) of the leads whose nodes are in different components."""
    placed = led.join(found, "node", "left").select(
        F.col("lead").alias("key"), "node", F.coalesce("component", "node").alias("component")
    )
    several = cut(
        placed.groupBy("key")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"))
        .where("x <> y")
        .select("key")
    )
    return placed.join(several, "key")


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Documents with 100 * intersection >= percent * union of their sets of
    ``k``-word shingles are linked; component_id is the least doc_id reachable.
    Texts without words, and null texts, are linked with nothing. Rows that
    share a doc_id are one node each by their text and come out as often as they
    came in; a row without doc_id takes the component of its text, or none.
    Other columns are not looked at.
    """
    docs = documents(docs, id_col, text_col)
    sets = cut(sets_of(docs, k))
    classes = cut(
        sets.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"))
    )
    nodes = cut(
        sets.where("n_shingles > 0")
        .join(classes, "digest")
        .where("doc_id = node")
        .dropDuplicates(["digest"])
        .select("node", "minima", "n_shingles", "bands")
    )
    banded = nodes.select("node", F.explode("bands").alias("key"))
    # Written, so that a join with a hot key on one side can be split.
    leads = cut(
        banded.groupBy("key")
        .agg(F.min("node").alias("lead"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", "lead")
    )
    buckets = cut(banded.join(leads, "key").select("key", "node", "lead"))
    led = cut(buckets.where("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("n")))
    first = (
        led.groupBy(F.col("node").alias("b"))
        .agg(F.max(F.struct("n", (-F.col("lead")).alias("less"))).alias("best"))
        .select((-F.col("best.less")).alias("a"), "b")
    )
    involved = cut(buckets.select(F.col("node").alias("id")).distinct())
    texts = passing(docs.where("doc_id is not null"), "doc_id", involved)
    texts = cut(texts.join(involved, F.col("doc_id") == F.col("id"), "left_semi"))
    joined = cut(confirmed(cut(likely(first, nodes, percent)), texts, k, percent))
    found = cut(components(joined))
    # Groups that still join different components, the buckets of a lead taken together.
    led = led.select("node", "lead").unionByName(led.select(F.col("lead").alias("node"), "lead").distinct())
    groups = cut(open_groups(led, found))
    wanted = cut(layout(groups))
    whole = F.col("placed") <= CELLS * F.col("n")
    found = merged(found, group_links(groups, wanted.where(whole), nodes, texts, k, percent))
    large = cut(led.join(wanted.where(~whole).select(F.col("key").alias("lead")), "lead"))
    for seed in range(len(ROUNDS) if not large.isEmpty() else 0):
        members = open_groups(large, found).select("node", "component").distinct()
        members = cut(members.join(nodes, "node").select("node", "component", "minima", "n_shingles"))
        found = merged(found, links(members, texts, k, percent, seed))
    named = classes.join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component_id")
    )
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        sets.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        )
    )


@query("op5_neardup")
def op5_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)
