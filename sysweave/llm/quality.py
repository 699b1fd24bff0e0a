"""Quality classifier from weak labels.

Several heuristic labellers vote on each document: good, bad, or nothing. From
how often each combination of votes occurs, expectation-maximisation estimates
how reliable each labeller is and how probably a document is good. Those
posteriors label a sample on which a linear scorer over hashed words, word
shapes and votes is trained; it decides on all documents. Abusive language has
labellers and a scorer of its own. Known labels are fixed evidence in the estimates;
a fixed part of the sample has none, however many there are.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import arrow_schema, documents, read, slices
from sysweave.llm.ngramlm import ODD, mixed, powers, word_hashes
from sysweave.llm.registry import query
from sysweave.llm.weak import reliabilities, sigmoid, train_linear
from sysweave.session import cut

#: Documents of each class the scorers are trained on, and one in how many of them has no known label.
TRAINED_ON, GUESSED = 2_000, 4
SLOTS = 1 << 18
#: A word or beginning of a word speaks for abuse if at least so many abusive documents
#: of the sample have it, and so many times the share of the others.
NEEDED, RATIO = 5, 15
#: Others are those whose probability of abuse is at most this.
SURE = 0.01
#: The probability that a known label is right.
KNOWN = 0.999
#: Probability from which a text counts as abusive.
ABUSIVE_FROM = 0.5

# Frequent small words of four languages, and groups of abusive words (fixed values).
SMALL = frozenset(
    "the of and to in is that for with on was it by this are be from as at or an not "
    "der die das und ist nicht von den mit ein zu des im auf für als auch "
    "le la les de des et un une du en que qui dans pour est sur pas par au avec "
    "el los las y una con por para se del su no al lo como".split()
)
ABUSE = [
    "idiot moron imbecile stupid dumb dumbass retard fool".split(),
    "scum trash garbage filth vermin worthless pathetic useless".split(),
    "loser clown disgusting jerk pig creep freak crap".split(),
    "idiot moron scum trash loser clown worthless pathetic stupid disgusting bastard bitch shit fuck".split(),
]
#: Below and above these a labeller says good and bad.
SYMBOLS, CAPITALS, REPEATS, TWICE = (0.03, 0.10), (0.15, 0.35), (0.15, 0.35), (0.05, 0.20)

LETTERS = np.zeros(256, np.int8)
LETTERS[65:91], LETTERS[97:123] = 1, 2


def among(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


MARKS, STOPS, EDGES = among("#*$%&|<>{}~^=\\"), among(".!?"), among(".,;:!?\"'()[]")
N_QUALITY = 9
#: A labeller seldom calls a good text bad, but may miss a bad one; and so with abuse.
START = {"quality": (0.95, 0.5), "abuse": (0.5, 0.05)}
#: Bytes of the beginnings of words that may speak for abuse.
BEGINNINGS = (4, 5, 6)


@functools.lru_cache(maxsize=1)
def small_words() -> np.ndarray:
    return np.unique(word_hashes(" ".join(SMALL).encode())[0])


@functools.lru_cache(maxsize=1)
def abusive_words() -> list[np.ndarray]:
    """Hashes of each group's words and their plurals."""
    groups = [Batch([" ".join([*g, *(w + "s" for w in g)])]) for g in ABUSE]
    return [np.unique(g.spans(g.first, g.last)) for g in groups]


def one_of(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def limits(share: np.ndarray, good: float, bad: float) -> np.ndarray:
    return np.where(share < good, 1, np.where(share > bad, -1, 0))


def slot_of(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


@functools.lru_cache(maxsize=4)
def vote_slots(n: int) -> tuple[np.ndarray, int]:
    """Slots by labeller and vote + 1, and that of the bias."""
    return np.array([[slot_of(f"v {i} {v}") for v in (-1, 0, 1)] for i in range(n)]), slot_of("bias")


class Batch:
    """The words of some texts as arrays, for all texts at a time."""

    def __init__(self, texts: list):
        coded = [(t or "").encode() for t in texts]
        self.size = len(coded)
        self.begin = np.cumsum([0, *(len(c) + 1 for c in coded)])
        data = b"\n".join(coded)
        self.raw = np.frombuffer(data, np.uint8)
        lower = data.lower()
        self.hash, self.first, self.last = word_hashes(lower)
        self.owner = np.searchsorted(self.begin, self.first, "right") - 1
        self.n = np.bincount(self.owner, minlength=self.size)
        self.lower = np.frombuffer(lower, np.uint8)

    @functools.cached_property
    def sums(self) -> np.ndarray:
        up, _ = powers(max(1 << 21, 1 << len(self.lower).bit_length()))
        out = np.zeros(len(self.lower) + 1, np.uint64)
        np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * up[: len(self.lower)], out=out[1:])
        return out

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, in lower case."""
        _, down = powers(max(1 << 21, 1 << len(self.lower).bit_length()))
        h = (self.sums[last] - self.sums[first]) * down[first]
        return mixed(h + (last - first).astype(np.uint64) * np.uint64(ODD))

    @functools.cached_property
    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and byte after the last of each word without marks around it."""
        first, last = self.first.copy(), self.last.copy()
        for _ in range(3):
            first += EDGES[self.raw[first]] & (last - first > 1) if len(first) else 0
            last -= EDGES[self.raw[last - 1]] & (last - first > 1) if len(first) else 0
        return first, last

    @functools.cached_property
    def bare_hash(self) -> np.ndarray:
        return self.spans(*self.bare)

    def per_text(self, of_bytes: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.concatenate(([0], np.cumsum(of_bytes)))
        return sums[np.minimum(self.begin[1:], len(of_bytes))] - sums[self.begin[:-1]]

    def mean(self, values: np.ndarray) -> np.ndarray:
        """By text, over its words."""
        return np.bincount(self.owner, values, self.size) / np.maximum(1, self.n)

    def distinct(self, key: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How many different keys each text has."""
        key = key ^ mixed(owner.astype(np.uint64))
        order = np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
        return np.bincount(owner[order][new], minlength=self.size)

    def quality_votes(self) -> np.ndarray:
        """What each labeller says of each text: 1 good, -1 bad, 0 nothing."""
        n, words, owner, raw = self.n, self.hash, self.owner, self.raw
        kinds = LETTERS[raw]
        upper = self.per_text(kinds == 1)
        letters = upper + self.per_text(kinds == 2)
        symbols = self.per_text(MARKS[raw]) / np.maximum(1, n)
        grams = mixed((words[:-2] * np.uint64(ODD) + words[1:-1]) * np.uint64(ODD) + words[2:])
        whole = owner[:-2] == owner[2:]
        repeats = 1 - self.distinct(grams[whole], owner[:-2][whole]) / np.maximum(1, n - 2)
        small = self.mean(one_of(words, small_words()))
        length = self.mean(self.last - self.first)
        ends = self.mean(STOPS[raw[self.last - 1]]) if len(words) else np.zeros(self.size)
        # Words of letters only, but for one mark at the end; bytes beyond ASCII count as letters.
        odd = np.concatenate(([0], np.cumsum((kinds == 0) & (raw < 128))))
        clean = (odd[self.last - 1] == odd[self.first]) if len(words) else words
        no_letter = odd[self.last] - odd[self.first] == self.last - self.first
        plain = self.mean(clean) - self.mean(no_letter)
        same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        twice = np.bincount(owner[1:][same], minlength=self.size) / np.maximum(1, n - 1)
        # Different words in each hundred, over all hundreds.
        place = np.arange(len(words)) - (np.cumsum(n) - n)[owner]
        hundred = (place // 100).astype(np.uint64) * np.uint64(ODD)
        varied = self.distinct(mixed(words + hundred), owner) / np.maximum(1, n)
        votes = np.stack(
            [
                limits(symbols, *SYMBOLS),
                limits(upper / np.maximum(1, letters), *CAPITALS),
                limits(repeats, *REPEATS),
                np.where(small > 0.08, 1, np.where((small < 0.02) & (n >= 20), -1, 0)),
                np.where((length >= 2.5) & (length <= 11), 1, -1),
                np.where((ends >= 0.01) & (ends <= 0.5), 1, np.where(n >= 30, -1, 0)),
                np.where(plain > 0.85, 1, np.where((plain < 0.7) & (n >= 20), -1, 0)),
                limits(twice, *TWICE),
                np.where(n < 50, 0, np.where(varied > 0.4, 1, np.where(varied < 0.25, -1, 0))),
            ],
            1,
        )
        votes[n < 5] = 0
        return votes

    def abuse_votes(self) -> np.ndarray:
        """For each text and group of abusive words 1 if the text has one, else -1."""
        has = [
            np.bincount(self.owner[one_of(self.bare_hash, g)], minlength=self.size) > 0
            for g in abusive_words()
        ]
        return np.where(np.stack(has, 1), 1, -1)

    def quality_slots(self) -> list[np.ndarray]:
        """Slots of each word itself and of its shape."""
        first, last = self.first, self.last
        if not len(first):
            return [self.owner, self.owner]
        kinds = LETTERS[self.raw]
        upper = np.concatenate(([0], np.cumsum(kinds == 1)))
        odd = np.concatenate(([0], np.cumsum((kinds == 0) & (self.raw < 128))))
        n_upper, n_odd = upper[last] - upper[first], odd[last] - odd[first]
        end = self.raw[last - 1]
        shape = np.minimum(n_upper, 2) * 4 + np.minimum(n_odd, 3)
        shape = shape * 4 + np.where(EDGES[end], 1, np.where(MARKS[end], 2, np.where(end < 65, 3, 0)))
        shape = shape * 8 + np.minimum(last - first, 21) // 3
        return [
            (self.bare_hash % np.uint64(SLOTS)).astype(np.int64),
            (mixed(shape.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(SLOTS)).astype(np.int64),
        ]

    def abuse_slots(self) -> list[np.ndarray]:
        """Slots of each word and of its beginnings."""
        first, last = self.bare
        made = [self.bare_hash]
        made += [
            self.spans(first, np.minimum(last, first + n)) ^ np.uint64(n * 0x1234567) for n in BEGINNINGS
        ]
        return [(h % np.uint64(SLOTS)).astype(np.int64) for h in made]

    def features(self, column: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(slots, values) of each text for the scorer of ``column``: shares of words and
        shapes for quality, for abuse the words and beginnings it has; and the votes."""
        quality = column == "quality"
        votes = self.quality_votes() if quality else self.abuse_votes()
        table, bias = vote_slots(votes.shape[1])
        words = self.quality_slots() if quality else self.abuse_slots()
        ends = np.cumsum(self.n)
        out = []
        for i, (a, b) in enumerate(zip(ends - self.n, ends, strict=True)):
            slots, counts = np.unique(np.concatenate([w[a:b] for w in words]), return_counts=True)
            values = counts / max(1, b - a) if quality else np.ones(len(slots))
            named = np.append(table[np.arange(votes.shape[1]), votes[i] + 1], bias)
            out.append((np.concatenate((slots, named)), np.concatenate((values, np.ones(len(named))))))
        return out


def voted(votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the votes and the bias add to each text's score."""
    table, bias = vote_slots(votes.shape[1])
    return weights[table[np.arange(votes.shape[1])[None, :], votes + 1]].sum(1) + weights[bias]


VOTES = "doc_id long, quality array<int>, abuse array<int>"


def votes_of(docs: DataFrame) -> DataFrame:
    """VOTES of each row of (doc_id, text)."""

    def run(batches):
        schema = arrow_schema(VOTES)
        for batch in batches:
            for part in slices(batch, rows=2048, chars=1_000_000):
                texts = Batch(part.column(1).to_pylist())
                votes = [texts.quality_votes(), texts.abuse_votes()]
                columns = [pa.array(list(v), f.type) for v, f in zip(votes, list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    return docs.mapInArrow(run, VOTES)


def pattern(column: str) -> Column:
    """A text for each combination of votes and the known label."""
    known = F.coalesce(F.col(f"known_{column}").cast("int").cast("string"), F.lit("-"))
    return F.concat_ws(",", F.col(column).cast("array<string>"), known)


def posteriors(votes: DataFrame, column: str) -> list[tuple[str, float]]:
    """(pattern, probability of the class 1): 3 to the power of ten of them at most, nine
    labellers and a label."""
    known = f"known_{column}"
    rows = (
        votes.groupBy(pattern(column).alias("pattern"))
        .agg(F.first(column).alias("votes"), F.first(known).alias("known"), F.count("*").alias("n"))
        .orderBy("pattern")
        .collect()
    )
    if not rows:
        return []
    table = np.array([r["votes"] for r in rows], np.int64)
    counts = np.array([r["n"] for r in rows], float)
    label = np.array([0 if r["known"] is None else 1 if r["known"] >= 0.5 else -1 for r in rows])
    # Texts nothing says anything of would only blur the estimates.
    silent = (table == 0).all(1) & (label == 0)
    p, prior, _ = reliabilities(
        table,
        np.where(silent, 0, counts),
        np.zeros(len(rows), np.int64),
        START[column],
        known=np.where(label == 0, np.nan, np.where(label > 0, KNOWN, 1 - KNOWN)),
    )
    return [(r["pattern"], float(x)) for r, x in zip(rows, np.where(silent, prior[0], p), strict=True)]


class Model:
    """Weights of the two scorers."""

    def __init__(self, quality: np.ndarray, abuse: np.ndarray):
        self.quality, self.abuse = quality, abuse

    def score(self, texts: list) -> list[np.ndarray]:
        """[words, quality, abuse, kept] of some texts; one without words is not kept."""
        some = Batch(texts)
        logit = voted(some.quality_votes(), self.quality)
        for slots in some.quality_slots():
            logit = logit + some.mean(self.quality[slots])
        quality = sigmoid(logit)
        logit = voted(some.abuse_votes(), self.abuse)
        # A word counts once, however often a text has it.
        slots, owner = [], []
        for found in some.abuse_slots():
            at = np.flatnonzero(self.abuse[found])
            slots.append(found[at])
            owner.append(some.owner[at])
        pairs = np.unique(np.concatenate(owner) * SLOTS + np.concatenate(slots))
        logit = logit + np.bincount(pairs // SLOTS, self.abuse[pairs % SLOTS], some.size)
        abuse = sigmoid(logit)
        return [some.n, quality, abuse, (some.n > 0) & (quality >= 0.5) & (abuse < ABUSIVE_FROM)]


def sample_of(votes: DataFrame, column: str, p: list[tuple[str, float]], trained_on: int) -> DataFrame:
    """(doc_id, label) of ``trained_on`` documents of each class, labelled with their posteriors:
    of which one in GUESSED has no known label and the others have; each by the least hash."""
    # A row for each pattern, 3 to the power of ten at most
    table = F.broadcast(votes.sparkSession.createDataFrame(p, "pattern string, label double"))
    known = F.col(f"known_{column}").isNotNull().alias("known")
    named = (
        votes.where("doc_id is not null")
        .select("doc_id", known, pattern(column).alias("pattern"))
        .join(table, "pattern")
        .select("doc_id", "known", "label")
    )
    rank = [F.xxhash64("doc_id"), "doc_id", "label"]
    some = [
        named.where(c).where(F.col("known") == k).orderBy(*rank).limit(n)
        for c in ("label >= 0.5", "label < 0.5")
        for k, n in ((True, trained_on - trained_on // GUESSED), (False, trained_on // GUESSED))
    ]
    out = some[0]
    for more in some[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id").agg(F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame | None, trained_on: int = TRAINED_ON) -> Model:
    """The scorers for (doc_id, text), with the known ``labels`` (doc_id, quality, toxic).

    All documents vote. Of each class (good, bad; abusive, not) ``trained_on``
    documents are trained on, so at most four times that many texts' features
    come to the driver, whatever the input.
    """
    votes = votes_of(docs)
    if labels is None:
        none = F.lit(None).cast("double")
        votes = votes.withColumns({"known_quality": none, "known_abuse": none})
    else:
        known = (
            labels.where("doc_id is not null")
            .groupBy("doc_id")
            .agg(
                F.min(F.col("quality").cast("double")).alias("known_quality"),
                F.max(F.col("toxic").cast("double")).alias("known_abuse"),
            )
        )
        votes = votes.join(known, "doc_id", "left")
    votes = cut(votes)
    weights = []
    for column in ("quality", "abuse"):
        some = sample_of(votes, column, posteriors(votes, column), trained_on)
        # 2 * trained_on ids at most
        sample = docs.join(F.broadcast(some), "doc_id").select("label", "text")
        weights.append(fitted(features_of(sample, column).toArrow(), column == "abuse"))
    return Model(*weights)


def features_of(sample: DataFrame, column: str) -> DataFrame:
    """(label, slots, parts) of (label, text), for the scorer of ``column``."""
    ddl = "label double, slots array<int>, parts array<float>"

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch, rows=2048, chars=1_000_000):
                made = Batch(part.column(1).to_pylist()).features(column)
                columns = [pa.array([m[c] for m in made], schema[c + 1].type) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    return sample.mapInArrow(run, ddl)


def fitted(rows: pa.Table, chosen_only: bool) -> np.ndarray:
    """Weights for the features (label, slots, parts) of labelled texts; with ``chosen_only`` just for the votes
    and for features that the class 1 has far oftener than the other."""
    if not rows.num_rows:
        return np.zeros(SLOTS)
    labels = rows["label"].to_numpy()
    lists = rows["slots"].combine_chunks()
    slots = lists.flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(labels)), lists.value_lengths().to_numpy())
    if not chosen_only:
        values = rows["parts"].combine_chunks().flatten().to_numpy().astype(float)
        return train_linear(slots, owner, values, labels, SLOTS)
    # Words are chosen by documents of little doubt; all of the sample weighs them.
    abusive, others = labels >= 0.5, labels <= SURE
    yes, no = np.bincount(slots, abusive[owner], SLOTS), np.bincount(slots, others[owner], SLOTS)
    share, other = yes / max(1, abusive.sum()), (no + 0.3) / max(1, others.sum())
    chosen = (yes >= NEEDED) & (share >= RATIO * other)
    table, bias = vote_slots(len(ABUSE))
    chosen[table.ravel()] = chosen[bias] = True
    kept = chosen[slots]
    return train_linear(slots[kept], owner[kept], np.ones(kept.sum()), labels, SLOTS)


SCORED = "doc_id long, n_words long, quality double, abuse double, kept boolean"


def judge(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    trained_on: int = TRAINED_ON,
) -> DataFrame:
    """(doc_id, n_words, quality, abuse, kept) of each row.

    All documents vote; known ``labels`` (doc_id, quality, toxic) fix what is estimated.
    ``quality`` and ``abuse`` are probabilities; a document is kept if it has
    words, its quality is a half or more and its abuse under ABUSIVE_FROM. A
    null text is an empty one; repeated rows give repeated rows and vote as
    often; rows without doc_id are scored but not trained on. Of several labels
    of a document the least quality and the greatest toxicity count, and labels
    of no document are not used. Ties at the sample's bound go by doc_id; a very long text is scored
    whole. Other columns are not looked at.
    """
    docs = documents(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, trained_on))

    def run(batches):
        schema = arrow_schema(SCORED)
        for batch in batches:
            for part in slices(batch, rows=2048, chars=1_000_000):
                made = model.value.score(part.column(1).to_pylist())
                columns = [pa.array(c, f.type) for c, f in zip(made, list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    return docs.mapInArrow(run, SCORED)


def good_documents(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    trained_on: int = TRAINED_ON,
) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps."""
    chosen = documents(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(chosen, labels, trained_on))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, rows=2048, chars=1_000_000):
                yield part.filter(pa.array(model.value.score(part.column(at).to_pylist())[3]))

    return docs.mapInArrow(run, docs.schema)


@query("op1_quality")
def op1_quality(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
