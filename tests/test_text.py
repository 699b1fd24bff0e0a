"""Scans and SQL dependencies on texts written for these tests."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sysweave.functions import paths, values
from sysweave.operators import similarity as sim
from sysweave.operators import sqltext as sq
from sysweave.operators import textscan as x

def wrapped(statement, deep):
    """``statement`` inside ``deep`` more selects, each with a table of its own."""
    for n in range(deep):
        statement = f"select v{n}.l_tax from ({statement}) v{n}, shelf{n}"
    return statement


# Statements over the given tables, with the tables they read or write.
SQL = [
    ("select n_name from nation", "NATION"),
    ("SELECT c_name, o_totalprice FROM customer cu, orders od WHERE cu.c_custkey = od.o_custkey", "CUSTOMER ORDERS"),
    (wrapped("select l_tax from lineitem", 1), "LINEITEM SHELF0"),
    (wrapped("select l_tax from lineitem", 3), "LINEITEM SHELF0 SHELF1 SHELF2"),
    ("select p_name from part union select s_name from supplier order by 1", "PART SUPPLIER"),
    ("select p_name from part union (select s_name from supplier)", "PART SUPPLIER"),
    ("select r_name from crm.region rg JOIN nation ON rg.r_regionkey = n_regionkey", "CRM.REGION NATION"),
    ("select 1 from orders LEFT OUTER JOIN lineitem ON o_orderkey = l_orderkey FULL JOIN part ON true", "LINEITEM ORDERS PART"),
    ("select s_name from supplier JOIN ( select max(p_size) m from part group by p_brand ) x ON s_suppkey = m", "PART SUPPLIER"),
    ("select p_name from part where p_size = (select max(p_size) from part)", "PART"),
    ("select c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)", "CUSTOMER ORDERS"),
    ("select (select count(*) from orders) total from region", "ORDERS REGION"),
    ("select ts from events where props = 'taken from pages' -- from labels", "EVENTS"),
    ("select url /* not from labels */ from pages", "PAGES"),
    ("update part set p_size = 1 where p_partkey = 2", "PART"),
    ("update part set p_size = (select max(l_quantity) from lineitem)", "LINEITEM PART"),
    ("insert into region (r_regionkey, r_name) values (9, 'new')", "REGION"),
    ("delete from events where user_id = 1", "EVENTS"),
    ("create table shelf (a int)", "SHELF"),
]


def test_table_names(spark):
    df = spark.createDataFrame(SQL, "query string, tables string")
    got = df.select("query", "tables", F.array_join(sq.table_names(F.col("query")), " ").alias("got"))
    assert [(r.query, r.got) for r in got.collect()] == [(r[0], r[1]) for r in SQL]


def test_nested_queries(spark):
    df = spark.createDataFrame([("select a from (select b from (select c from t) u) v",)], "query string")
    rows = sq.nested_queries(df).orderBy("depth").collect()
    assert [(r.depth, r.sub) for r in rows] == [
        (0, "select a from (select b from (select c from t) u) v"),
        (1, "select b from (select c from t) u"),
        (2, "select c from t"),
    ]
    assert [r.parent for r in rows] == [None, rows[0].sub, rows[1].sub]


def plain_selects(text):
    """(parent, sub, depth) by a stack of brackets; texts without strings and comments."""
    import re

    spans, stack = [], []
    for i, ch in enumerate(text):
        if ch == "(":
            stack.append(i + 1)
        elif ch == ")" and stack:
            spans.append((stack.pop(), i + 1))
    spans += [(at, len(text) + 1) for at in stack]
    spans = [s for s in spans if re.match(r"(?i)\s*select\b", text[s[0] :])]
    if re.match(r"(?i)\s*\(*\s*select\b", text):
        spans.append((0, len(text) + 1))
    out = []
    for a, b in spans:
        around = sorted(s for s in spans if s[0] < a and s[1] >= b)
        parent = text[around[-1][0] : around[-1][1] - 1] if around else None
        out.append((parent, text[a : b - 1], len(around)))
    return sorted(out, key=repr)


def test_nested_queries_against_a_stack(spark):
    rnd = random.Random(21)
    texts = [
        "".join(rnd.choice(["(", ")", "(select a ", "select b ", "x, ", "( SELECT c", ") "]) for _ in range(rnd.randint(1, 30)))
        for _ in range(150)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, query string")
    got = {}
    for r in sq.nested_queries(df.select("query")).collect():
        got.setdefault(r.query, []).append((r.parent, r.sub, r.depth))
    for text in set(texts):
        assert sorted(got.get(text, []), key=repr) == sorted(plain_selects(text) * texts.count(text), key=repr), text


def test_a_statement_of_very_many_brackets(spark):
    text = "select " + "(" * 25_000 + "1" + ")" * 25_000 + " + (select 2)" + "(3)" * 25_000
    rows = sq.nested_queries(spark.createDataFrame([(text,)], "query string")).collect()
    assert sorted((r.depth, r.sub) for r in rows) == [(0, text), (1, "select 2")]


def test_find_sql_per_line(spark):
    df = spark.createDataFrame([(1, "x = 'select a from b';\ny\nUPDATE t SET a=1\n")], "source int, text string")
    assert {(r.kind, r.text) for r in x.find_sql(df, per_line=True).collect()} == {
        ("SELECT", "select a from b'"), ("UPDATE", "UPDATE t SET a=1"),
    }


def test_connection_strings(spark):
    text = "..;Driver={SQL Server};Server=.\\SQLEXPRESS;Database=Sales;Trusted_Connection=yes? then DSN=Other! end"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "source int, text string")
    whole = [(r.offset, r.dsn) for r in x.find_dsn(df).orderBy("offset").collect()]
    assert whole[0] == (2, ";Driver={SQL Server};Server=.\\SQLEXPRESS;Database=Sales;Trusted_Connection=yes")
    assert whole[1][1].strip() == "DSN=Other"
    single = [r.dsn for r in x.find_dsn(df, glue=False, keys=x.COMMON_DSN_KEYS).orderBy("offset").collect()]
    assert single[:2] == [";Driver={SQL Server}", ";Server=.\\SQLEXPRESS"]


def test_words_and_lines(spark):
    df = spark.createDataFrame([(1, "alpha beta1 xy\n\ngamma delta")], "source int, text string")
    got = [(r.line, r.hit, r.word) for r in x.find_words(df).orderBy("hit").collect()]
    assert got == [(1, 1, "alpha"), (1, 2, "beta1"), (3, 3, "gamma"), (3, 4, "delta")]
    many = spark.createDataFrame([(1, "words " * 3000)], "source int, text string")
    assert x.find_words(many).count() == 3000
    assert x.find_words(many, max_hits=3).count() == 3


def test_bayes_sends_grams_once_and_together(spark, monkeypatch):
    """Grams of several blobs, ranges and rows of a key add up, texts without known grams and keys that are null stay,
    and a text's grams are not rows of a shuffle."""
    monkeypatch.setattr(sim, "RANGE_GRAMS", 256)
    monkeypatch.setattr(sim, "TOGETHER", 300)
    words = [f"w{i}" for i in range(40)]
    rnd = random.Random(5)

    def text(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    train = [(i, i % 3, text(rnd.randrange(30))) for i in range(60)]
    test = [(f"k{i % 50}", text(rnd.randrange(60)) + " unknown") for i in range(70)] + [(None, text(9)), ("empty", ""), ("null", None)]
    model = sim.train_bayes(spark.createDataFrame(train, "id int, label int, text string"))
    found = sim.classify_buffers(model, spark.createDataFrame(test, "id string, text string"))
    got = {r.id: (r.predicted, r.score) for r in found.collect()}

    def grams(text):
        w = (text or "").split()
        return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    labels = {0, 1, 2}
    counts = {label: Counter(g for _, x, t in train if x == label for g in grams(t)) for label in labels}
    known = {g for _, _, t in train for g in grams(t)}
    sizes = Counter(label for _, label, _ in train)
    of_key = {}
    for k, t in test:
        of_key.setdefault(k, []).extend([] if k is None else [g for g in grams(t) if g in known])
    assert got.keys() == of_key.keys()
    for k, own in of_key.items():
        scores = {
            label: math.log(sizes[label] / len(train))
            + sum(math.log((counts[label][g] + 1) / (sum(counts[label].values()) + len(known))) for g in own)
            for label in labels
        }
        assert abs(got[k][1] - max(scores.values())) < 1e-5 and scores[got[k][0]] > max(scores.values()) - 1e-5
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [step for step in plan if "Aggregate [" in step and "gram#" in step]


def test_bayes_against_counts(spark):
    train = [(1, "m", "open file read file"), (2, "m", "read file close"), (3, "n", "send socket packet file")]
    test = [(7, "read the file"), (8, "socket packet"), (9, "nothing known")]
    df = spark.createDataFrame(train, "id int, label string, text string")
    model = sim.train_bayes(df, n_max=2)
    got = {r.id: (r.predicted, r.score) for r in sim.classify_buffers(model, spark.createDataFrame(test, "id int, text string"), n_max=2).collect()}

    def grams(text):
        w = text.split()
        return w + [" ".join(p) for p in zip(w, w[1:])]

    counts = {lab: Counter(g for _, a, t in train if a == lab for g in grams(t)) for lab in "mn"}
    words = set().union(*counts.values())
    for key, text in test:
        scores = []
        for lab in "mn":
            z = math.log(sum(counts[lab].values()) + len(words))
            prior = math.log(sum(a == lab for _, a, _ in train) / len(train))
            s = prior + sum(math.log(counts[lab][g] + 1) - z for g in grams(text) if g in words)
            scores.append((round(s, 6), lab))
        best = max(scores)
        assert got[key][0] == best[1]
        assert got[key][1] == pytest.approx(best[0], abs=1e-5)


@pytest.mark.parametrize(
    "path, category",
    [
        ("/usr/lib/x86_64/libc.so.6", "Shared libraries"),
        ("/lib64/libm.so", "Shared libraries"),
        ("/usr/share/fonts/a.ttf", "System config files"),
        ("/var/lib/dpkg/status", "Other libraries"),
        ("/bin/ls", "System executables"),
        ("/run/user", "Kernel file systems"),
        ("/var/log/syslog", "Temporary files"),
        ("UNIX:[123]", "Pipes and terminals"),
        ("TCPv6:[::1:80->::1:90]", "Connected TCP sockets"),
        ("TCP:[0.0.0.0:80]", "Other TCP/IP sockets"),
        ("/home/me/x", "Others"),
    ],
)
def test_categories(spark, path, category):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.path_category(F.col("p")).alias("c")).first().c == category


def test_small_columns(spark):
    df = spark.createDataFrame([("Server=a;PWD=secret;Uid=me",)], "d string")
    row = df.select(
        values.mask_dsn(F.col("d")).alias("m"),
        values.dsn_parts(F.col("d")).alias("p"),
        values.plural_label(F.lit(2), F.lit("Class")).alias("l"),
        values.extension(F.lit("/a.b/.bashrc")).alias("e1"),
        values.extension(F.lit("/a/x.tar.gz")).alias("e2"),
    ).first()
    assert row.m == "Server=a;PWD=xxx;Uid=me"
    assert row.p == {"SERVER": "a", "PWD": "secret", "UID": "me"}
    assert (row.l, row.e1, row.e2) == ("Classes", "", ".gz")
