"""Quality rules: how much of a text repeats itself.

Words become numbers, and windows of several lengths become rolling hashes in
numpy, for many texts at a time. A window that its text has had before covers
its words; the rules compare the characters of covered words, and of lines that
occurred before, with those of all words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import documents, map_rows, read
from sysweave.llm.registry import query

#: Percent of a text's characters that windows of n words seen before may cover.
MAY_REPEAT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of a text's characters that lines seen before may hold.
LINES_MAY_REPEAT = 20
#: Symbols for each hundred words.
MAY_HAVE_SYMBOLS = 10
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
BASE = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, " \
    "n_repeat_words long, dup_line_chars long, " + ", ".join(f"cover_{n} long" for n in MAY_REPEAT)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread small numbers over 64 bits (the splitmix64 finalizer)."""
    x = (x + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread_over(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of length ``n`` at ``starts``."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def same_windows(words: np.ndarray, owner: np.ndarray, rolled: np.ndarray, at: np.ndarray, n: int):
    """(order, same): window starts ``at`` sorted, equal windows side by side and
    in text order; ``same[i]`` if windows i and i + 1 are equal.

    Windows sort by rolling hash and are then compared word by word. If unequal
    ones ever share a hash, they are sorted by their words instead.
    """
    key = rolled[at] ^ mixed(owner[at].astype(np.uint64))
    order = at[np.argsort(key, kind="stable")]
    key = rolled[order] ^ mixed(owner[order].astype(np.uint64))
    same = key[1:] == key[:-1]
    a, b = order[:-1][same], order[1:][same]
    equal = owner[a] == owner[b]
    for j in range(n):
        equal &= words[a + j] == words[b + j]
    if not equal.all():
        order = at[np.lexsort([words[at + j] for j in reversed(range(n))] + [owner[at]])]
        same = owner[order[1:]] == owner[order[:-1]]
        for j in range(n):
            same &= words[order[1:] + j] == words[order[:-1] + j]
    return order, same


def measure(ids: list, texts: list) -> list[list]:
    """The columns of COLUMNS for some texts."""
    lengths, numbers, counts = [], [], []
    symbols, chars, dup_lines, dup_chars = [], [], [], []
    for text in texts:
        text = text or ""
        words = text.encode().split()  # at the six ASCII blanks
        known: dict[bytes, int] = {}
        numbers.extend([known.setdefault(w, len(known)) for w in words])
        lengths.extend([len(w) if w.isascii() else len(w.decode()) for w in words])
        counts.append(len(words))
        symbols.append(sum(map(text.count, SYMBOLS)))
        chars.append(len(text) - sum(map(text.count, BLANK)))
        seen, again, inside = set(), 0, 0
        for line in text.split("\n"):
            if line in seen:
                again += 1
                inside += len(line) - sum(map(line.count, BLANK))
            elif line.strip(BLANK):
                seen.add(line)
        dup_lines.append(again)
        dup_chars.append(inside)
    size, n_texts = len(numbers), len(texts)
    words = np.array(numbers, np.int64)
    chars_of = np.array(lengths, np.int64)
    owner = np.repeat(np.arange(n_texts), counts)
    value = mixed(words.astype(np.uint64))
    rolled, repeats, covers = value, np.zeros(n_texts, np.int64), {}
    for n in range(2, max(MAY_REPEAT) + 1):
        rolled = rolled[: max(0, size - n + 1)] * BASE + value[n - 1 :]
        if n != 3 and n not in MAY_REPEAT:
            continue
        at = np.flatnonzero(owner[: len(rolled)] == owner[n - 1 :])
        order, same = same_windows(words, owner, rolled, at, n)
        later = np.concatenate(([False], same)) if len(order) else np.zeros(0, bool)
        if n == 3:
            any_of = later | np.concatenate((same, [False])) if len(order) else later
            inside = spread_over(order[any_of], n, size)
            repeats = np.bincount(owner[inside], minlength=n_texts)
        else:
            inside = spread_over(order[later], n, size)
            covers[n] = np.bincount(owner[inside], chars_of[inside], n_texts).astype(np.int64)
    return [ids, counts, chars, symbols, dup_lines, repeats, dup_chars, *covers.values()]


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its counts, ``base_failed`` and ``kept``.

    ``cover_n`` counts the characters of words in windows of n words that the
    text has had before, ``dup_line_chars`` those in lines it has had before. A
    null text counts as empty; texts under 50 words fail. Repeated rows give
    repeated rows, other columns are not looked at.
    """
    counted = map_rows(documents(docs, id_col, text_col), lambda: measure, COLUMNS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeats = 100 * F.col("dup_line_chars") > LINES_MAY_REPEAT * F.col("word_chars")
    for n, percent in MAY_REPEAT.items():
        repeats |= 100 * F.col(f"cover_{n}") > percent * F.col("word_chars")
    repeats |= 100 * F.col("n_symbols") > MAY_HAVE_SYMBOLS * F.col("n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeats)


def rules_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    parts = [
        f"""texts as (select doc_id, coalesce(text, '') as text from documents),
        w as (select doc_id, regexp_extract_all(text, '{word}') as ws, text from texts),
        line as (select doc_id, unnest(string_split(text, chr(10))) as l,
            generate_subscripts(string_split(text, chr(10)), 1) as i from texts),
        lines as (select doc_id, l, count(*) - 1 as again,
                length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) as chars
            from line where regexp_matches(l, '{word}') group by doc_id, l),
        dup as (select doc_id, sum(again) as n_dup_lines, sum(again * chars) as dup_line_chars
            from lines group by doc_id),
        pos as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w)"""
    ]
    for n in [3, *MAY_REPEAT]:
        rest = "".join(f" || ' ' || lead(word, {j}) over d" for j in range(1, n))
        keep = "c > 1" if n == 3 else "i > first"
        parts.append(
            f"""g{n} as (select doc_id, i, word{rest} as g from pos
                window d as (partition by doc_id order by i)),
            r{n} as (select doc_id, i, count(*) over p as c, min(i) over p as first from g{n}
                where g is not null window p as (partition by doc_id, g)),
            in{n} as (select distinct doc_id, i + unnest(range({n})) as i from r{n} where {keep}),
            cov{n} as (select doc_id, count(*) as words, sum(length(word)) as chars
                from pos join in{n} using (doc_id, i) group by doc_id)"""
        )
    covers = ", ".join(f"cast(coalesce(cov{n}.chars, 0) as bigint) as cover_{n}" for n in MAY_REPEAT)
    joins = " ".join(f"left join cov{n} using (doc_id)" for n in [3, *MAY_REPEAT])
    limits = " or ".join(f"100 * cover_{n} > {p} * word_chars" for n, p in MAY_REPEAT.items())
    return f"""with {", ".join(parts)},
        counted as (select doc_id, len(ws) as n_words,
            length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
            cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
            coalesce(cov3.words, 0) as n_repeat_words,
            cast(coalesce(dup_line_chars, 0) as bigint) as dup_line_chars, {covers}
            from w left join dup using (doc_id) {joins}),
        based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
            from counted)
        select *, not base_failed and not ({limits}
            or 100 * dup_line_chars > {LINES_MAY_REPEAT} * word_chars
            or 100 * n_symbols > {MAY_HAVE_SYMBOLS} * n_words) as kept from based"""


@query("op6_rules", rules_sql())
def op6_rules(spark, sf_dir: str) -> DataFrame:
    return rules(read(spark, sf_dir, "documents"))
