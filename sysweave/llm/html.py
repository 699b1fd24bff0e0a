"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. The weights of a few
lines in a row are summed; where the sums surge main text begins, and where they
dive it ends. A line weighs as much as it has text outside links. Text in an
article element weighs more, and text around article elements less. Lines of menus,
headers, footers, side columns, notices, adverts, forms and reader comments weigh
nothing.
"""

from __future__ import annotations

import html as references
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sysweave.llm.batches import map_rows, read
from sysweave.llm.registry import query

#: Lines in a block of lines.
WINDOW = 3
#: Main text begins with this much weight in a block of lines, or half of the page's greatest
#: block if that is less; it ends under a share of that.
SURGE, DIVE = 80, 0.25
#: Weight of a character in an article element, in a page without one, and elsewhere; and of
#: a character of a link in an article element.
INSIDE, PLAIN, OUTSIDE, LINKED = 6, 1, 0.25, 1

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|select|svg|iframe|object|canvas|audio|video|math)\b"
    r"[^>]*+(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|$))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark "
    "meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub "
    "sup time track tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may go unclosed.
CLOSED_BY_NEXT = set("p li dt dd tr td th option".split())
#: Elements that hold no main text.
ASIDE = set("nav footer aside form menu dialog button fieldset head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that name something else than the main text.
HINTS = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay sidebar "
    "widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead "
    "comment comments reply replies respond disqus discussion login signin signup register subscribe "
    "subscription newsletter share sharing social related recommended recommendations pagination "
    "pager toolbar topbar copyright".split()
)
#: Hints that may also name a wrapper around the article.
WRAPS = set("sidebar header footer nav menu banner notice alert widget promo related social share".split())
HEADS = set("header masthead".split())


def is_aside(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(whether an element holds something else than main text, whether it may wrap the article)."""
    if name in ASIDE or name == "header" and not in_article:
        return True, False
    if name in ("html", "body", "main") or name in INLINE or name in VOID:
        return False, False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "role" and value.lower() in ROLES:
            return True, False
        if key in ("class", "id"):
            found = {w.lower() for w in WORD.findall(value)} & HINTS
            if in_article:
                found -= HEADS
            if found:
                return True, found <= WRAPS
    return False, False


def lines_of(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, characters inside links, number of the article it is in or 0, aside) by block."""
    out: list[tuple[str, int, int, bool]] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open containers: name, aside, wraps, article
    article = n_articles = in_link = breaks = 0
    aside = False

    def end_block():
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(references.unescape("".join(links)).split()))
            out.append((text, linked, article, aside))
        parts.clear()
        links.clear()

    def add(text):
        nonlocal breaks
        if text:
            parts.append(text)
            if in_link:
                links.append(text)
            if not text.isspace():
                breaks = 0

    at = 0
    for m in TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            breaks += 1
            if breaks > 1:
                end_block()
            else:
                add(" ")
        elif name in INLINE:
            if name in ("img", "input"):
                add(" ")
        elif closing:
            end_block()
            in_link = 0
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if depth >= 0:
                del stack[depth:]
                aside = any(x[1] for x in stack)
                article = stack[-1][3] if stack else 0
        else:
            end_block()
            in_link = 0
            if stack and stack[-1][0] == "p" or stack and stack[-1][0] == name and name in CLOSED_BY_NEXT:
                stack.pop()  # a paragraph ends where the next block begins
                aside = any(x[1] for x in stack)
            hinted, wraps = is_aside(name, attributes, bool(article))
            if name in VOID or name in CLOSED_BY_NEXT and not hinted:
                continue
            if name in ("article", "main") and not hinted and not article:
                if aside and all(x[2] for x in stack if x[1]):  # a wrapper with a misleading name
                    stack = [(x[0], False, False, x[3]) for x in stack]
                    aside = False
                if not aside:
                    n_articles += 1
                    article = n_articles
            stack.append((name, hinted, wraps, article))
            aside = aside or hinted
    add(page[at:])
    end_block()
    return out


def surges(weights: list[float], least: float) -> list[tuple[int, int]]:
    """[start, end) of the runs of lines that begin with a block of WINDOW lines of weight
    ``least`` and end with the last line of the last block of DIVE times that."""
    n, runs, start = len(weights), [], None
    for i in range(n + 1):
        total = sum(weights[i : i + WINDOW])
        if start is None:
            if total >= least:
                start = i
        elif total < DIVE * least:
            runs.append((start, min(n, i + WINDOW - 1)))
            start = None
    return runs


def weight(text: str, linked: int, article: int, aside: bool, has_articles: bool) -> float:
    """What a line adds to its blocks."""
    if aside:
        return 0
    if article:
        return INSIDE * (len(text) - linked) + LINKED * linked
    return (OUTSIDE if has_articles else PLAIN) * max(0, len(text) - 2 * linked)


def main_text(page: str | None) -> str:
    """The main text, its blocks joined by line ends in page order; empty if there is none."""
    lines = lines_of(page or "")
    # An aside inside an article does not end its text.
    lines = [x for x in lines if not (x[2] and x[3])]
    has_articles = any(x[2] for x in lines)
    parts = [
        [(x[0], weight(*x, has_articles)) for x in part]
        for _, part in itertools.groupby(lines, key=lambda x: x[2])
    ]
    sums = (sum(w for _, w in part[i : i + WINDOW]) for part in parts for i in range(len(part)))
    least = min(SURGE, max(sums, default=0) / 2)
    if not least:
        return ""
    out = []
    for part in parts:
        after = 0  # runs may share lines
        for first, last in surges([w for _, w in part], least):
            out += [text for text, w in part[max(first, after) : last] if w]
            after = last
    return "\n".join(out)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, empty if none.

    Null html is an empty page. Repeated rows give repeated rows, other columns
    are not looked at. n_chars counts code points.
    """

    def make():
        def fn(ids, urls, pages):
            texts = [main_text(p) for p in pages]
            return ids, urls, texts, [len(t) for t in texts]

        return fn

    chosen = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        F.col(f"`{html_col}`").alias("html"),
    )
    return map_rows(chosen, make, "page_id long, url string, text string, n_chars long")


@query("op7_html")
def op7_html(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
