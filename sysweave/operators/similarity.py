"""Classification of buffers by their words, and clustering of names by their shape."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.session import cut

#: Grams of the model that a task holds, about.
RANGE_GRAMS = 1 << 22
#: Tasks that look grams up, at most. A text's sums come from each of them.
LOOKUPS = 64
#: Grams that are counted and sent on together.
TOGETHER = 2_000_000

WORD = r"(?U)\b\w\w+\b"
DELIMITERS = r"[-_ .]"


def exploded_grams(df: DataFrame, keys, col: str, n_max: int) -> DataFrame:
    """(keys, gram): every run of 1..n_max words."""
    words = F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))

    def grams(n: int) -> Column:
        last = F.size(F.col("_w")) - n + 1
        return F.when(
            last >= 1,
            F.transform(
                F.sequence(F.lit(1), last),
                lambda i: F.array_join(F.slice(F.col("_w"), i, F.lit(n)), " "),
            ),
        ).otherwise(F.array().cast("array<string>"))

    every = F.concat(F.col("_w"), *[grams(n) for n in range(2, n_max + 1)])
    return df.select(*keys, words.alias("_w")).select(*keys, F.explode(every).alias("gram"))


def word_grams(df: DataFrame, keys, col: str = "text", n_max: int = 3) -> DataFrame:
    """(keys, gram, n): counts of runs of 1..n_max words per text."""
    return (
        exploded_grams(df, keys, col, n_max)
        .groupBy(*keys, "gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def gram_keys(df: DataFrame, keys, col: str, n_max: int) -> DataFrame:
    """(keys, gram): a 64-bit hash of every run of 1..n_max words."""
    words = F.transform(
        F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)
    )

    def grams(n: int) -> Column:
        last = F.size(F.col("_w")) - n + 1
        return F.when(
            last >= 1,
            F.transform(
                F.sequence(F.lit(0), last - 1),
                lambda i: F.xxhash64(F.lit(n), *[F.get(F.col("_w"), i + j) for j in range(n)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    every = F.concat(*[grams(n) for n in range(1, n_max + 1)])
    return df.select(*keys, words.alias("_w")).select(*keys, F.explode(every).alias("gram"))


def train_bayes(
    train: DataFrame, label: str = "label", key: str = "id", col: str = "text", n_max: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes with add-one smoothing, as two written tables.

    (gram, n0, n1, ..): one row per gram, by the hash of its words, with its count
    in each label. (label, i, prior, z): one row per label; its counts are in
    column ``n{i}``, z is the logarithm of its grams plus the vocabulary. A model
    has few labels.
    """
    texts = cut(train.groupBy(label).agg(F.count(F.lit(1)).alias("texts")))
    names = [r[0] for r in texts.select(label).orderBy(label).collect()]
    counts = cut(
        gram_keys(train, [label], col, n_max)
        .groupBy("gram")
        .agg(*[F.count(F.when(F.col(label) == name, 1)).alias(f"n{i}") for i, name in enumerate(names)])
    )
    sums = [F.sum(f"n{i}").alias(f"t{i}") for i in range(len(names))]
    totals = counts.agg(F.count(F.lit(1)).alias("v"), *sums).first()
    all_texts = texts.agg(F.sum("texts").alias("t"))
    of_label = F.create_map(*[c for i, n in enumerate(names) for c in (F.lit(n), F.lit(i))]) if names else None
    if of_label is None:
        return counts, texts.select(label, F.lit(0).alias("i"), F.lit(0.0).alias("prior"), F.lit(0.0).alias("z"))
    grams = F.array(*[F.lit(float((totals[f"t{i}"] or 0) + totals["v"])) for i in range(len(names))])
    priors = texts.select(
        label,
        of_label[F.col(label)].alias("i"),
        F.log(F.col("texts") / all_texts.scalar()).alias("prior"),
        F.log(F.get(grams, of_label[F.col(label)])).alias("z"),
    )
    return counts, cut(priors)


def classify_buffers(
    model: tuple[DataFrame, DataFrame],
    test: DataFrame,
    label: str = "label",
    key: str = "id",
    col: str = "text",
    n_max: int = 3,
) -> DataFrame:
    """(key, predicted, score): the most probable label of each text; grams the
    model never saw are left out.

    Grams of some texts at a time are counted and sent to ranges of the hash as sorted, compressed
    numbers, and so is the model. A range holds its part of the model and adds up each label's gains
    of one piece of texts after the other, so a word of every text is no more to hold than another,
    and a text comes back once a task, of which there are ``LOOKUPS`` at most.
    """
    counts, priors = model
    columns = [c for c in counts.columns if c != "gram"]
    known = counts.count()
    ranges = max(1, known // RANGE_GRAMS, min(4 * LOOKUPS, known * 64 // RANGE_GRAMS))
    kind = test.schema[key].dataType.simpleString()
    sent = gram_keys(test, [key], col, n_max).mapInArrow(
        _text_blobs(ranges, TOGETHER), f"range int, n int, keys array<{kind}>, blob binary"
    )
    parts = counts.select("gram", *columns).mapInArrow(_model_blobs(ranges, TOGETHER), "range int, n int, blob binary")
    fields = F.lit(True).alias("sent"), "n", "keys", "blob"
    none = F.lit(None).cast(f"array<{kind}>").alias("keys")
    sums = ", ".join(["_key " + kind, "_size bigint", *[f"_gain{i} double" for i in range(len(columns))]])
    gains = (
        sent.select("range", *fields)
        .unionByName(parts.select("range", F.lit(False).alias("sent"), "n", none, "blob"))
        .repartition(min(ranges, LOOKUPS), "range")
        .sortWithinPartitions("range", "sent")
        .mapInArrow(_adder(len(columns)), sums)
        .groupBy(F.col("_key").alias(key))
        .agg(
            F.sum("_size").alias("_size"),
            F.array(*[F.sum(f"_gain{i}") for i in range(len(columns))]).alias("_gains"),
        )
    )
    # Every text is scored under every label; the labels are one small row.
    labels = priors.agg(F.collect_list(F.struct(F.col(label).alias("label"), "i", "prior", "z")))
    scored = (
        test.select(key)
        .join(gains, key, "left")
        .select(key, "_size", "_gains", F.explode(labels.scalar()).alias("l"))
    )
    size = F.coalesce("_size", F.lit(0))
    gain = F.coalesce(F.get("_gains", F.col("l.i")), F.lit(0.0))
    total = F.round(F.col("l.prior") - size * F.col("l.z") + gain, 6)
    return (
        scored.groupBy(key)
        .agg(F.max(F.struct(total.alias("score"), F.col("l.label").alias("label"))).alias("x"))
        .select(key, F.col("x.label").alias("predicted"), F.col("x.score").alias("score"))
    )


def _tools():
    """Functions for workers: a blob of columns of numbers, sorted by the first, the columns of
    a blob, ranges of sorted hashes, batches put together."""

    def pack(first, *others):
        columns = np.diff(first, prepend=first.dtype.type(0)), *others
        planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(first), -1).T.tobytes() for c in columns]
        return pa.compress(b"".join(planes), codec="zstd", asbytes=True)

    def unpack(blob, n, kinds):
        sizes = [np.dtype(k).itemsize for k in kinds]
        raw = np.frombuffer(pa.decompress(blob, n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
        cuts = np.cumsum([n * size for size in sizes])[:-1]
        columns = [
            np.ascontiguousarray(part.reshape(size, n).T).view(k).ravel()
            for part, size, k in zip(np.split(raw, cuts), sizes, kinds, strict=True)
        ]
        return [np.cumsum(columns[0], dtype=columns[0].dtype), *columns[1:]]

    def pieces(gram, ranges: int):
        """(range, slice) of the sorted hashes ``gram``, for ranges that have some."""
        bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
        cuts = [0, *np.searchsorted(gram, bounds).tolist(), len(gram)]
        return [(r, slice(i, j)) for r, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]

    def collected(batches, rows: int):
        """Tables of ``rows`` rows and a batch at most."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    return pack, unpack, pieces, collected


def _model_blobs(ranges: int, rows: int):
    """From (gram, n0, n1, ..) to (range, n, blob)."""
    pack, _, pieces, collected = _tools()

    def run(batches):
        for table in collected(batches, rows):
            gram, *counts = (c.to_numpy() for c in table.columns)
            gram = gram.view(np.uint64)
            order = np.argsort(gram)
            gram, counts = gram[order], [c[order] for c in counts]
            for r, part in pieces(gram, ranges):
                made = [r], [part.stop - part.start], [pack(gram[part], *[c[part] for c in counts])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(made, (pa.int32(), pa.int32(), pa.binary()))], ["range", "n", "blob"]
                )

    return run


def _text_blobs(ranges: int, rows: int):
    """From (key, gram) to (range, n, keys, blob): of each gram of a text its hash, the place of its key and its times."""
    pack, _, pieces, collected = _tools()

    def run(batches):
        for table in collected(batches, rows):
            codes = pa.concat_arrays(table.column(0).chunks).dictionary_encode(null_encoding="encode")
            text, gram = codes.indices.to_numpy(), table.column(1).to_numpy().view(np.uint64)
            order = np.lexsort((text, gram))
            gram, text = gram[order], text[order]
            first = np.ones(len(gram), bool)
            first[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(first)
            times = np.diff(first, append=len(gram)).astype(np.uint32)
            gram, text = gram[first], text[first]
            for r, part in pieces(gram, ranges):
                used, place = np.unique(text[part], return_inverse=True)
                keys = codes.dictionary.take(pa.array(used))
                blob = pack(gram[part], place.astype(np.uint32), times[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r], pa.int32()),
                        pa.array([part.stop - part.start], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                        pa.array([blob], pa.binary()),
                    ],
                    ["range", "n", "keys", "blob"],
                )

    return run


def _adder(labels: int):
    """From (range, sent, n, keys, blob), a range's model before its texts, to (key, size, gain0, gain1, ..)."""
    _, unpack, _, _ = _tools()

    def run(batches):
        at, parts, known = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r, sent, n = (batch.column(c)[i].as_py() for c in range(3))
                blob = batch.column(4)[i].as_py()
                if r != at:
                    at, parts, known = r, [], None
                if not sent:
                    parts.append(unpack(blob, n, [np.uint64] + [np.int64] * labels))
                    continue
                if not parts:
                    continue
                if known is None:
                    known, *counts = (np.concatenate(c) for c in zip(*parts))
                    order = np.argsort(known)
                    known, logs = known[order], [np.log(c[order] + 1.0) for c in counts]
                    parts = [()]
                gram, place, times = unpack(blob, n, [np.uint64, np.uint32, np.uint32])
                to = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                hit = known[to] == gram
                to, place, times = to[hit], place[hit], times[hit].astype(float)
                keys = batch.column(3)[i].values
                size = np.bincount(place, times, len(keys)).astype(np.int64)
                some = np.flatnonzero(size)
                if len(some) == 0:
                    continue
                gains = [np.bincount(place, times * log[to], len(keys))[some] for log in logs]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(some)), pa.array(size[some]), *map(pa.array, gains)],
                    ["_key", "_size", *[f"_gain{j}" for j in range(labels)]],
                )

    return run


def majority(df: DataFrame, keys, col: str = "predicted") -> DataFrame:
    """Most frequent label per key; equal counts are settled by the label."""
    counted = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy(*keys)
        .agg(F.max(F.struct("n", F.col(col).alias("label"))).alias("x"))
        .select(*keys, F.col("x.label").alias(col), F.col("x.n").alias("n"))
    )


def confusion(df: DataFrame, actual: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def name_shape(name: Column) -> Column:
    """Digits to ``#``, other words to ``w``, delimiters kept."""
    return F.regexp_replace(F.regexp_replace(name, r"\d+", "#"), r"[^-_ .#]+", "w")


def cluster_names(df: DataFrame, col: str = "name", depth: int = 1) -> DataFrame:
    """(name, cluster): names grouped by shape, then split ``depth`` times.

    Each round splits a group by the words at one position: the one with the
    greatest gain, which is the entropy of its words times the share of names that
    have a word again that another had. A position where all words are equal or
    all are different gains nothing; a group without gain stays whole.
    """
    names = df.select(F.col(col).alias("name")).distinct()
    out = names.withColumn("cluster", name_shape(F.col("name")))
    for _ in range(depth):
        words = out.select(
            "cluster", "name", F.posexplode(F.split("name", DELIMITERS)).alias("at", "word")
        )
        counted = words.groupBy("cluster", "at", "word").agg(F.count(F.lit(1)).alias("n"))
        spread = counted.groupBy("cluster", "at").agg(
            F.sum("n").alias("total"),
            F.count(F.lit(1)).alias("distinct"),
            F.sum(F.col("n") * F.log2("n")).alias("_nlogn"),
        )
        entropy = F.round(F.log2("total") - F.col("_nlogn") / F.col("total"), 9)
        gain = F.round(entropy * (F.col("total") - F.col("distinct")) / F.col("total"), 9)
        best = (
            spread.select("cluster", "at", gain.alias("gain"))
            .where("gain > 0")
            .groupBy("cluster")
            .agg(F.max(F.struct("gain", (-F.col("at")).alias("neg"))).alias("x"))
            .select("cluster", (-F.col("x.neg")).alias("_at"))
        )
        word = F.get(F.split("name", DELIMITERS), F.col("_at"))
        out = out.join(best, "cluster", "left").select(
            "name",
            F.when(
                F.col("_at").isNotNull(),
                F.concat("cluster", F.lit("|"), F.col("_at").cast("string"), F.lit("="), word),
            )
            .otherwise(F.col("cluster"))
            .alias("cluster"),
        )
    return out
