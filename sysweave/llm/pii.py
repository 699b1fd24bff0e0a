"""Personal data by weak supervision.

Patterns find spans; voters (the patterns' own checks, lists of known values,
and the words around) each say yes, no or nothing on a span. Expectation-
maximisation over how often each combination of votes occurs tells how far each
voter can be trusted; the labels that follow train a linear classifier of spans
and their surroundings, which decides on the spans the strict patterns leave.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import arrow_schema, documents, map_rows, read, slices
from sysweave.llm.registry import query
from sysweave.llm.weak import reliabilities, sigmoid, train_linear
from sysweave.session import cut

KINDS = ["email", "ip", "card", "phone"]
#: Spans the classifier is trained on: those with the least hash, so the same at every run.
TRAINED_ON = 20_000
SLOTS = 1 << 14

# Strict patterns (fixed values).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wider patterns, whose spans are only candidates.
WIDE = [
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?[\[({]\s?at\s?[\])}]\s?"
                   r"[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    (1, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::|(?::?[0-9A-Fa-f]{1,4})){1,4}(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[.\x20-]{1,2}[0-9]{2,6}){2,4}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+.])00[1-9][0-9]{0,2}[\x20.-]?(?:[0-9]{2,4}[\x20.-]?){2,5}(?![0-9A-Za-z])")),
]

# Known values: common endings of hosts, first digits of card issuers.
ENDINGS = frozenset("com org net edu gov mil int info biz io eu de fr es uk us it nl ch at be se pl ru cn jp br in au ca".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)|35|36|30[0-5]|62")
NEAR = [
    re.compile(r"e-?mail|mail|contact|write|@", re.I),
    re.compile(r"\bip\b|address|host|server|login|client|from", re.I),
    re.compile(r"card|visa|master|credit|amex|payment", re.I),
    re.compile(r"phone|\btel|call|mobile|cell|fax|contact|\bsms\b", re.I),
]
NOT_NEAR = re.compile(
    r"\b(?:v|ver|version|release|build|order|invoice|isbn|issn|id|ref|sku|section|chapter|token|key|hash|sha\d*|page)\b\W*$",
    re.I,
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses, leftmost first: for each @ the run before it and the domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        start = at
        while m and start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns, leftmost without overlap by kind, by start."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def wide_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the wider patterns that touch no span in ``taken``, nor each other."""
    covered: list[list[int]] = []  # ``taken``, overlapping ones joined
    for s, _, e in taken:
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    found = [(m.start(), kind, m.end()) for kind, pattern in WIDE for m in pattern.finditer(text)]
    out, k, end = [], 0, 0
    for s, kind, e in sorted(found):
        while k < len(covered) and covered[k][1] <= s:
            k += 1
        if s >= end and (k == len(covered) or covered[k][0] >= e):
            out.append((s, kind, e))
            end = e
    return out


def votes_on(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, ...]:
    """What each voter says of a span: 1 yes, -1 no, 0 nothing."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    left, right = text[start - 1 : start], text[end : end + 1]
    digits = digits_of(span)
    if kind == 0:
        known = 1 if span.lower().rpartition(".")[2].strip(" )]}") in ENDINGS else -1
        shape = 1 if len(span) <= 80 and not span.startswith((".", "-")) else -1
    elif kind == 1:
        known = 0 if ":" in span else -1 if span.startswith(("0.", "00")) else 1
        shape = 1 if ":" not in span or span.count(":") == 7 or "::" in span else -1
    elif kind == 2:
        known = 1 if ISSUERS.match(digits) else -1
        shape = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    else:
        known = -1 if len(set(digits)) < 3 else 1 if digits[:1] not in "01" or span[0] == "+" else 0
        shape = 1 if 9 <= len(digits) <= 15 else -1
    around = -1 if left.isalnum() or right.isalnum() or left in "_=\"'/" and left else 1
    return (
        1 if strict else 0,
        known,
        shape,
        1 if NEAR[kind].search(before) else 0,
        -1 if NOT_NEAR.search(before) else 0,
        around,
    )


def features(text: str, start: int, kind: int, end: int, votes: tuple[int, ...]) -> list[int]:
    """Slots of the hashed features of a span and its surroundings."""
    span = text[start:end]
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", span[:40]))
    before = text[max(0, start - 30) : start].lower().split()
    after = text[end : end + 30].lower().split()
    named = [
        "bias",
        f"kind {kind}",
        f"shape {kind} {shape}",
        f"length {kind} {min(40, end - start) // 3}",
        f"before {before[-1] if before else ''}",
        f"after {after[0] if after else ''}",
        f"left {text[start - 1 : start]}",
        f"right {text[end : end + 1]}",
        *(f"vote {kind} {i} {v}" for i, v in enumerate(votes)),
    ]
    return [zlib.crc32(n.encode("utf-8", "replace")) % SLOTS for n in named]


CANDIDATES = "kind int, votes array<int>, slots array<int>, key long"


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate span in (doc_id, text): kind, votes, features and a hash."""

    def run(batches):
        schema = arrow_schema(CANDIDATES)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = text or ""
                    strict = base_spans(text)
                    for some, is_strict in ((strict, True), (wide_spans(text, strict), False)):
                        for s, kind, e in some:
                            votes = votes_on(text, s, kind, e, is_strict)
                            key = zlib.crc32(f"{doc}:{kind}:{s}:{e}".encode())
                            rows.append((kind, votes, features(text, s, kind, e, votes), key))
                columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

    return docs.mapInArrow(run, CANDIDATES)


def train(found: DataFrame, trained_on: int = TRAINED_ON) -> np.ndarray:
    """Weights of the span classifier from (kind, votes, slots, key).

    Reliabilities come from all candidates, by combination of votes: at most
    four kinds times three to the power of six rows. The classifier is fitted on
    the ``trained_on`` candidates with the least hash.
    """
    patterns = found.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()
    if not patterns:
        return np.zeros(SLOTS)
    votes = np.array([p["votes"] for p in patterns], np.int64)
    kinds = np.array([p["kind"] for p in patterns])
    counts = np.array([p["count"] for p in patterns], float)
    posterior, _, _ = reliabilities(votes, counts, kinds)
    label = {(p["kind"], *p["votes"]): y for p, y in zip(patterns, posterior, strict=True)}
    sample = found.orderBy("key", "kind", "slots").limit(trained_on).collect()
    labels = np.array([label[(r["kind"], *r["votes"])] for r in sample])
    slots = np.concatenate([r["slots"] for r in sample])
    rows = np.repeat(np.arange(len(sample)), [len(r["slots"]) for r in sample])
    return train_linear(slots, rows, np.ones(len(slots)), labels, SLOTS)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


def find_private(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trained_on: int = TRAINED_ON
) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans) of each row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and
    then kind; the numbers count the base spans, ``spans`` has all. A null text
    is an empty one; repeated rows give repeated rows and count twice in
    training; other columns are not looked at.
    """
    docs = documents(docs, id_col, text_col)
    weights = train(cut(candidates(docs)), trained_on)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        def fn(ids, texts):
            columns = [[] for _ in range(6)]
            for text in texts:
                text = text or ""
                base = base_spans(text)
                more = [
                    (s, kind, e)
                    for s, kind, e in wide_spans(text, base)
                    if sigmoid(
                        shared.value[features(text, s, kind, e, votes_on(text, s, kind, e, False))].sum()
                    )
                    >= 0.5
                ]
                of = [kind for _, kind, _ in base]
                row = [*map(of.count, range(4)), span_text(base), span_text(sorted(base + more))]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            return ids, *columns

        return fn

    return map_rows(docs, make, FOUND)


@query("op9_pii")
def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_private(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"),
        "spans",
    )
