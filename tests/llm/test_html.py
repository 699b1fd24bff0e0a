from sysweave.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="with-sidebar"><header><a href="/">Home</a></header><nav><ul><li><a href="/x">x</a></ul></nav>
<div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1><p>First <b>bold</b>
 and&nbsp;&#8212; so.<p>Second<br>line<!-- hidden --></p><div class="ad">Buy</div><ul><li>one<li>two</ul>
<form>Mail <input name=a></form><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_article():
    assert html.main_text(PAGE).split("\n") == [
        "Head & more",
        "First bold and \u2014 so.",
        "Second line",
        "one",
        "two",
    ]


def test_page_without_article():
    text = "A sentence of a story that goes on and on, with many words in it, as they do."
    page = f"<div><a>menu</a> <a>more</a></div><p>{text}</p><p>Short.</p><p>{text}</p><div><a>last</a></div>"
    assert html.main_text(page) == f"{text}\nShort.\n{text}"


STORY = "A sentence of a story that goes on and on, with many words in it, as they do."


def test_every_article_of_main_text():
    page = f"<div>Our pages</div><article><p>{STORY}</p></article><article><h2>Two</h2><p>{STORY[::-1]}</p></article>"
    assert html.main_text(page) == f"{STORY}\nTwo\n{STORY[::-1]}"


def test_markup_only_weighs():
    """Much text beside an article is main text, a little is not."""
    long = " ".join([STORY] * 6)
    page = f"<article><p>{STORY}</p></article><div><p>Read this too</p></div>"
    assert html.main_text(page) == STORY
    assert html.main_text(f"{page}<div><p>{long}</p></div>").endswith(f"\n{long}")


def test_short_lines_without_article():
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "Log", "Us", "Shop", "Map"))
    tale = "".join(f"<p>This is line {i} of a short tale.</p>" for i in range(4))
    got = html.main_text(menu + tale).split("\n")
    assert got[-4:] == [f"This is line {i} of a short tale." for i in range(4)]
    assert not {"Home", "Log", "Us"} & set(got)


def test_dive_inside_an_article():
    """Lines of next to nothing after the text of an article are not part of it."""
    got = html.main_text(f"<article><p>{STORY}</p>{'<p>.</p>' * 9}</article>").split("\n")
    assert got[0] == STORY and len(got) < 5


def test_odd_pages():
    assert html.main_text(None) == "" == html.main_text("") == html.main_text("<nav>a</nav>")
    assert html.main_text("only text & more") == "only text & more"
    assert html.main_text("<article><p>cut off in a <b") == "cut off in a <b"
    assert html.main_text("<article class=x>" + "<p>word" * 20_000).count("word") == 20_000
    for page in ("<" * 50_000, "<p" * 50_000, "<!--" * 20_000, "<div>" * 20_000 + "x", '<a b="' * 5_000):
        html.main_text(page)


def test_wrapper_with_a_misleading_name():
    page = "<div class='sidebar-layout'><article><p>kept</p></article><div class=sidebar>gone</div></div>"
    assert html.main_text(page) == "kept"


def test_extract(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    got = html.extract(pages).collect()
    assert len(got) == 4
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(pages.limit(0)).collect() == []
