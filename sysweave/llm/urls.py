"""URL filters: host and path rules, and a ratio of character language models.

Two variable-order Markov models of characters, one of accepted and one of
rejected URLs, are counted in Spark, exactly, over a bounded number of labelled URLs.
The longest context a model has seen decides, smoothed by the shorter ones (Witten and
Bell). A URL's score is the difference of its log-likelihoods over its length; the
threshold is calibrated on labelled URLs of hosts the models have not seen.

Where no labels are given, several voters on the form of the host vote, expectation-
maximisation over their vote patterns tells how far each can be trusted, and the
more probable class is the label.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import arrow_schema, map_rows, read
from sysweave.llm.registry import query
from sysweave.llm.weak import reliabilities

#: Characters of context.
ORDER = 5
#: Labelled URLs of each class the models are fitted on, those with the least hashes,
#: and the characters a URL among them may have.
TRAINED_ON, LONGEST = 1 << 14, 2048
#: Characters of the alphabet that the shortest context spreads over.
ALPHABET = 128
#: The labelled URLs of one host in so many are kept from training, for calibration.
HELD_OUT = 5
#: Histogram of scores for calibration.
BINS, REACH = 400, 8.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: (host, path, verdict): the longest rule that fits decides.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Words in a host that speak against it when no labelled URLs are given.
UNWANTED = ["adult", "bet", "bets", "casino", "cheap", "farm", "pills", "porn", "spam", "ads", "track"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    found = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def rule_of(host: Column, path: Column, rules=tuple(RULES)) -> Column:
    """The longest rule for the host or a parent of it whose path begins the path, or null."""
    out = F.lit(None).cast("string")
    for at, begin, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        out = F.when(fits, F.lit(at + begin)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=tuple(RULES)) -> Column:
    out = F.lit(None).cast("string")
    for at, begin, verdict in rules:
        out = F.when(rule == at + begin, F.lit(verdict)).otherwise(out)
    return out


def voters(host: Column) -> list[Column]:
    """What speaks for (1) and against (-1) a host, as votes; 0 is no vote."""
    said = lambda bad, good: F.when(bad, -1).otherwise(good)
    return [
        said(host.rlike(r"(^|[.-])(" + "|".join(UNWANTED) + r")([.-]|$)"), 1),
        said(host.rlike(r"[^.-]-[^.-]"), 1),
        said(host.rlike(r"[0-9][^.]*[a-z]|[a-z][^.]*[0-9]"), 0),
        said(host.rlike(r"[^.]{25}") | host.rlike(r"(\.[^.]*){5}"), 0),
    ]


def weak_labels(urls: DataFrame) -> DataFrame:
    """(url, accepted) of the rows of (url) with a host, by the voters and their reliabilities.

    Rows are counted by their votes; at most 81 patterns come to the driver.
    """
    host = host_of(F.col("url"))
    votes = F.array(*voters(host))
    voted = urls.where(host != "").select("url", F.array_join(votes, ",").alias("votes"))
    patterns = voted.groupBy("votes").count().orderBy("votes").collect()
    table = np.array([[int(x) for x in r["votes"].split(",")] for r in patterns]).reshape(-1, 4)
    counts = np.array([r["count"] for r in patterns], float)
    posterior, _, _ = reliabilities(table, counts, np.zeros(len(table), np.int64))
    labels = [(r["votes"], bool(x >= 0.5)) for r, x in zip(patterns, posterior, strict=True)]
    by_votes = urls.sparkSession.createDataFrame(labels, "votes string, accepted boolean")
    return voted.join(F.broadcast(by_votes), "votes").select("url", "accepted")


@dataclasses.dataclass
class Model:
    """Exact counts of n-grams and contexts, by sorted hash: a row for each hash, with a
    column for rejected and one for accepted URLs; and the least accepted score."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    threshold: float = 0.0


def looked_up(keys: np.ndarray, wanted: np.ndarray):
    """Rows of ``wanted`` in the sorted ``keys``; one past the end where there is none."""
    at = np.searchsorted(keys, wanted)
    found = at < len(keys)
    found[found] = keys[at[found]] == wanted[found]
    return np.where(found, at, len(keys))


def grams_of(texts: list[str]):
    """(owner, [(hash of context, hash of context and character) by order]) of the
    characters of some texts; a hash is 0 where the text has too few characters before."""
    counts = [len(t) for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    points = points.astype(np.uint64) + np.uint64(1)
    starts = np.repeat(np.cumsum(counts) - counts, counts).astype(np.int64)
    place = np.arange(len(points)) - starts
    owner = np.repeat(np.arange(len(texts)), counts)
    out = []
    gram = np.zeros(len(points), np.uint64)
    for order in range(ORDER + 1):
        # The gram of this order is the character and the ``order`` before it.
        shifted = np.zeros_like(points)
        shifted[order:] = points[: len(points) - order] if order else points
        power = MULTIPLIER ** np.uint64(order) if order else np.uint64(1)
        gram = gram + shifted * power
        before = np.zeros_like(gram)
        if order:
            # The context is the gram of one order less that ends one character before.
            before[1:] = out[order - 1][2][:-1]
        here = place >= order
        salt = np.uint64(2 * order + 1)
        out.append((np.where(here, scrambled(before, salt), 0), np.where(here, scrambled(gram, salt + np.uint64(1)), 0), gram, here))
    return owner, [(c, g, here) for c, g, _, here in out]


def scrambled(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + salt * np.uint64(0xBF58476D1CE4E5B9)) * MULTIPLIER
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


COUNTED = "accepted boolean, context long, gram long, n long"


def count_grams(labelled: DataFrame) -> DataFrame:
    """(accepted, context, gram, n) over (url, accepted), added up in each batch."""

    def run(batches):
        schema = arrow_schema(COUNTED)
        for batch in batches:
            urls, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for label in (True, False):
                texts = [u for u, x in zip(urls, labels, strict=True) if x is label and u]
                if not texts:
                    continue
                _, orders = grams_of(texts)
                pairs = np.concatenate([np.stack([c[h], g[h]], 1) for c, g, h in orders])
                pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
                first = np.flatnonzero(np.concatenate(([True], pairs[1:, 1] != pairs[:-1, 1])))
                n = np.diff(np.append(first, len(pairs)))
                columns = [
                    pa.array(np.full(len(first), label)),
                    pa.array(pairs[first, 0].view(np.int64)),
                    pa.array(pairs[first, 1].view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = labelled.select("url", "accepted").mapInArrow(run, COUNTED)
    return counted.groupBy("accepted", "gram").agg(F.min("context").alias("context"), F.sum("n").alias("n"))


def by_hash(hashes: np.ndarray, label: np.ndarray, *values: np.ndarray):
    """The distinct hashes, sorted, and for each of ``values`` its sums by hash and label
    with a last row of zeros, for hashes that are not among them."""
    keys, row = np.unique(hashes, return_inverse=True)
    size = 2 * (len(keys) + 1)
    return keys, *(np.bincount(2 * row + label, v, size).reshape(-1, 2) for v in values)


def train(labelled: DataFrame, trained_on: int = TRAINED_ON) -> Model:
    """A model of the accepted and rejected URLs in (url, accepted).

    Of the distinct URLs of at most LONGEST characters, whose host is not held out for
    calibration, each class's ``trained_on`` with the least hashes are counted. Their
    n-grams come to the driver, and a histogram of all held-out URLs. Where one of
    the classes is empty all scores are 0 and all URLs pass.
    """
    labelled = labelled.where("url is not null and accepted is not null").select("url", "accepted")
    held = F.pmod(F.xxhash64(host_of(F.col("url"))), F.lit(HELD_OUT)) == 0
    known = labelled.where(~held & (F.length("url") <= LONGEST)).distinct()
    least = [known.where(F.col("accepted") == x).orderBy(F.xxhash64("url"), "url").limit(trained_on) for x in (True, False)]
    got = count_grams(least[0].unionByName(least[1])).toArrow()
    label = np.asarray(got["accepted"].to_numpy(zero_copy_only=False), np.int64)
    gram, context = (got[c].to_numpy().view(np.uint64) for c in ("gram", "context"))
    n = got["n"].to_numpy().astype(np.float64)
    if len(np.unique(label)) < 2:
        label, gram, context, n = label[:0], gram[:0], context[:0], n[:0]
    grams, counts = by_hash(gram, label, n)
    model = Model(grams, counts, *by_hash(context, label, n, np.ones(len(n))))
    if not len(gram):
        return model
    histogram = (
        scored(labelled.where(held), model, "url", ["accepted"])
        .groupBy("accepted", F.floor((F.col("score") + REACH) / (2 * REACH) * BINS).alias("bin"))
        .count()
        .collect()
    )
    counts = np.zeros((2, BINS))
    for row in histogram:
        counts[int(row["accepted"]), min(BINS - 1, max(0, row["bin"]))] += row["count"]
    model.threshold = calibrated(counts)
    return model


def calibrated(counts: np.ndarray) -> float:
    """The edge between bins that keeps most of the accepted and least of the
    rejected, as shares of each; of equals the one in their middle; 0 without both."""
    totals = counts.sum(1)
    if not totals.all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(counts, 1)), 1) / totals[:, None]
    good = (1 - below[1]) + below[0]
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * REACH - REACH)


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    """Log-likelihood as an accepted URL less that as a rejected one, by character; 0 if empty."""
    owner, orders = grams_of(texts)
    p = np.full((len(owner), 2), 1 / ALPHABET)
    for context, gram, here in orders:
        at = looked_up(model.contexts, context[here])
        n = model.counts[looked_up(model.grams, gram[here])]
        total, kinds = model.totals[at], model.kinds[at]
        mixed = (n + kinds * p[here]) / np.maximum(total + kinds, 1)
        p[here] = np.where(total > 0, mixed, p[here])
    logs = np.log(p)
    sums = np.bincount(owner, logs[:, 1] - logs[:, 0], len(texts))
    return sums / np.maximum(1, [len(t) for t in texts])


def scored(urls: DataFrame, model: Model, url_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` of each row; the score of a null or empty URL is 0."""
    kept = urls.select(F.col(f"`{url_col}`").alias("url"), *[F.col(f"`{c}`") for c in keep])
    shared = urls.sparkSession.sparkContext.broadcast(model)
    kinds = {"bigint": "long", "string": "string", "boolean": "boolean"}
    ddl = ", ".join([*(f"{f} {kinds[t]}" for f, t in kept.dtypes[1:]), "score double"])

    def make():
        return lambda texts, *rest: (
            *rest,
            score_texts([t or "" for t in texts], shared.value),
        )

    return map_rows(kept, make, ddl)


def judge(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules=tuple(RULES),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row.

    A rule decides where one fits, the longest, and of two as long the later one; else
    the score, which passes if it is not under the threshold. Without ``labelled``
    (url, accepted) the labels are ``weak_labels`` of the URLs themselves; with labels
    of one class only, or none, all URLs no rule decides pass. A null URL, or one without
    ``://``, has an empty host and path; a null or empty URL scores 0. URLs of any
    length are scored whole. Repeated rows give repeated rows, other columns are
    not looked at.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
    )
    model = train(weak_labels(rows) if labelled is None else labelled)
    by_model = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    judged = scored(rows.withColumn("again", F.col("url")), model, "url", ["page_id", "again"])
    host, path = host_of(F.col("again")), path_of(F.col("again"))
    return judged.select(
        "page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"), "score"
    ).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), by_model).alias("verdict"),
        "score",
    )


@query("op8_urls")
def op8_urls(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
