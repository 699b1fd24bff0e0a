"""Graph operators against brute force on small random graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sysweave.functions import identity as ident
from sysweave.model import TRIPLE_SCHEMA, TYPE, as_set
from sysweave.operators import graphset as g
from sysweave.operators import match as m
from sysweave.operators import traverse as t


def facts(spark, rows):
    full = [(*r, None, None)[:6] if len(r) == 4 else r for r in rows]
    return spark.createDataFrame([(s, p, o, k, "string" if k == "lit" else None, None) for s, p, o, k, *_ in full], TRIPLE_SCHEMA)


def random_edges(seed, n=25, k=30):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(k)]


def naive_match(rows, patterns):
    names = sorted({x for p in patterns for x in p if x.startswith("?")})
    out = []
    for combo in itertools.product(rows, repeat=len(patterns)):
        env, ok = {}, True
        for row, pattern in zip(combo, patterns):
            for value, term in zip(row[:3], pattern):
                term = TYPE if term == "a" else term
                if term.startswith("?"):
                    ok = ok and env.setdefault(term, value) == value
                else:
                    ok = ok and term == value
        if ok:
            out.append(tuple(env[n] for n in names))
    return sorted(out)


@pytest.mark.parametrize(
    "patterns",
    [
        [("?a", "e", "?b"), ("?b", "e", "?c")],
        [("?a", "e", "?a")],
        [("?a", "?p", "?b"), ("?b", "a", "node")],
        [("?a", "e", "?b"), ("?b", "e", "?c"), ("?c", "name", "red")],
        [("?x", "name", "red"), ("?x", "e", "?y"), ("n1", "a", "node")],
    ],
)
def test_match(spark, patterns):
    rows = [(a, "e", b, "uri") for a, b in set(random_edges(4, 8, 14)) | {("n3", "n3")}]
    rows += [(f"n{i}", TYPE, "node", "uri") for i in range(8)]
    rows += [(f"n{i}", "name", "red" if i % 2 else "blue", "lit") for i in range(8)]
    names = sorted({x for p in patterns for x in p if x.startswith("?")})
    got = m.match(facts(spark, rows), patterns, select=names).collect()
    assert sorted(tuple(r) for r in got) == naive_match(rows, patterns)


def test_match_refuses_a_product(spark):
    with pytest.raises(ValueError):
        m.match(facts(spark, [("a", "e", "b", "uri")]), [("?a", "e", "?b"), ("?c", "e", "?d")])


def test_typed_literals(spark):
    df = spark.createDataFrame(
        [("a", "v", "1", "lit", "integer", None), ("b", "w", "1", "lit", "string", None)], TRIPLE_SCHEMA
    )
    patterns = [("?a", "v", "?x"), ("?b", "w", "?x")]
    assert m.match(df, patterns).count() == 1
    assert m.match(df, patterns, typed=True).count() == 0


def test_product_keeps_correlated_values_together(spark):
    df = m.product(spark.range(1), {("a", "b"): [("a1", "b1"), ("a2", "b2")], ("c",): [("c1",), ("c2",)]})
    assert sorted((r.a, r.b, r.c) for r in df.collect()) == [
        ("a1", "b1", "c1"), ("a1", "b1", "c2"), ("a2", "b2", "c1"), ("a2", "b2", "c2"),
    ]


def neighbours(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    return out


def test_closure_with_cycles(spark):
    edges = random_edges(11)
    got = {(r.ancestor, r.descendant): r.depth for r in t.closure(spark.createDataFrame(edges, "parent string, child string")).collect()}
    nxt, want = neighbours(edges), {}
    for start in nxt:
        level, depth, seen = {start}, 0, set()
        while level:
            level = {c for p in level for c in nxt.get(p, ())} - seen
            depth += 1
            seen |= level
            want.update({(start, c): depth for c in level})
    assert got == want


def test_components_and_connected(spark):
    edges = [e for e in random_edges(12, 30, 18) if e[0] != e[1]]
    both = neighbours(edges + [(b, a) for a, b in edges])
    want = {}
    for node in both:
        group, todo = {node}, [node]
        while todo:
            new = both[todo.pop()] - group
            group |= new
            todo += new
        want[node] = min(group)
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r.node: r.component for r in t.components(df).collect()} == want
    rows = facts(spark, [(a, "e", b, "uri") for a, b in edges])
    start = edges[0][0]
    assert {r.node for r in t.connected(rows, start).collect()} == {
        n for n in want if want[n] == want[start]
    }


def test_set_algebra(spark):
    a = facts(spark, [("a", "p", "1", "lit"), ("a", "p", "1", "lit"), ("b", "p", "c", "uri")])
    b = facts(spark, [("b", "p", "c", "uri"), ("x", "p", "1", "lit")])
    assert g.union(a, b).count() == 3
    assert [r.s for r in g.subtract(a, b).collect()] == ["a"]
    assert as_set(a).count() == 2


def test_link_same_chains_a_hot_alias(spark):
    nodes = [(f"H{i}@x.k=1", "p", f"h{i % 2}@x.k=1", "uri") for i in range(6)]
    rows = facts(spark, nodes)
    edges = g.link_same(rows).collect()
    groups = {}
    for r in rows.select(F.explode(F.array("s", "o")).alias("n")).distinct().collect():
        groups.setdefault(r.n.lower(), []).append(r.n)
    want = {(a, b) for ns in groups.values() for a, b in itertools.pairwise(sorted(ns))}
    assert {(r.s, r.o) for r in edges} == want


def test_node_text_round_trip(spark):
    values = ["plain", "a,b=c", "é ü", "B64_x", ""]
    df = spark.createDataFrame([(v, str(i)) for i, v in enumerate(values)], "name string, id string")
    nodes = ident.make_nodes(df, "thing", {"Name": "name", "Id": "id"})
    got = ident.parse_nodes(nodes).collect()
    assert [r["keys"] for r in got] == [{"Name": v, "Id": str(i)} for i, v in enumerate(values)]
    assert {r.cls for r in got} == {"thing"}


def test_check_minimal_and_subclasses(spark):
    df = spark.createDataFrame([("a/b/c",)], "path string")
    assert {(r.cls, r.base) for r in g.subclass_edges(df).collect()} == {("a", ""), ("a.b", "a"), ("a.b.c", "a.b")}


def test_closure_from_against_walking(spark):
    rnd = random.Random(12)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(90)]
    edges += [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("n1", "n1"), (None, "n2"), ("n3", None)]
    starts = ["n1", "n5", "c2", "alone"]
    want = {}
    for s in starts:
        depth, level = {s: 0}, [s]
        while level:
            level = [b for a in level for x, b in edges if x == a and b is not None and b not in depth and not depth.update({b: depth[a] + 1})]
        want |= {(s, b): d for b, d in depth.items() if d}
    df = spark.createDataFrame(edges, "parent string, child string")
    begin = spark.createDataFrame([(s,) for s in [*starts, "n1", None]], "start string")
    got = t.closure_from(df, begin).collect()
    assert {(r.ancestor, r.descendant): r.depth for r in got} == want and len(got) == len(want)
    near = t.closure_from(df, begin, max_depth=3).collect()
    assert {(r.ancestor, r.descendant): r.depth for r in near} == {p: d for p, d in want.items() if d <= 3}
    assert t.closure_from(df.limit(0), begin).isEmpty() and t.closure_from(df, begin.limit(0)).isEmpty()


def test_a_long_chain_closes_in_few_rounds(spark):
    """Twenty thousand events of the given tables, each followed by the next."""
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("event_id < 20000")
    links = e.selectExpr("event_id as child", "event_id - 1 as parent").where("parent >= 0")
    rounds = []
    got = t.closure_from(links, spark.createDataFrame([(0,)], "start long"), rounds=rounds)
    assert got.count() == 19_999 and got.where("descendant <> depth").isEmpty()
    assert len(rounds) <= 16


def test_pairs_of_a_chain_are_not_written(spark, monkeypatch):
    """Three hundred starts on a chain, a cycle behind it and a side branch: rounds hold links and paths only."""
    monkeypatch.setattr(t, "FEW_LINKS", 800)
    monkeypatch.setattr(t, "PIECE", 64)
    edges = [(i, i + 1) for i in range(2000)] + [(2000, 1990), (700, 3000), (3000, 3001)]
    links = spark.createDataFrame(edges * 2, "parent long, child long")
    rounds = []
    got = t.closure_from(links, spark.range(0, 2000, 7).withColumnRenamed("id", "start"), rounds=rounds)
    want = {(a, b): b - a for a in range(0, 2000, 7) for b in range(a + 1, 2001)}
    want |= {(a, b): 2001 - a + b - 1990 for a in range(0, 2000, 7) for b in range(1990, a)}
    want |= {(a, b): b - 3000 + 701 - a for a in range(0, 701, 7) for b in (3000, 3001)}
    rows = got.collect()
    assert {(r.ancestor, r.descendant): r.depth for r in rows} == want and len(rows) == len(want)
    assert 800 < max(rounds) <= 2003


def test_providers_about_objects(spark):
    """Only usable providers of classes that occur are read, each for the objects it applies to."""
    from sysweave.model import TRIPLE_SCHEMA
    from sysweave.sources.tables import Providers

    def facts(*names):
        rows = [(n, "p", "o", "lit", "string", None) for n in names]
        return lambda s: read.append(names) or s.createDataFrame(rows, TRIPLE_SCHEMA)

    read = []
    providers = Providers()
    providers.register("a", "file", facts("file.id=1", "file.id=2", "file.id=3"))
    providers.register("b", "file", facts("file.id=1"), usable=lambda s: False)
    providers.register("c", "file", facts("file.id=2", "file.id=3"), applies=lambda k: k["id"] == "3")
    providers.register("a", "disk", facts("disk.id=1"))
    names = ["file.id=1", "file.id=3", "file.id=3", "file.id=9", "other.id=1", "broken", "", None]
    objects = spark.createDataFrame([(n,) for n in names], "node string")
    assert sorted(r.s for r in providers.about(objects).collect()) == ["file.id=1", "file.id=3", "file.id=3"]
    assert len(read) == 2
    assert providers.about(objects.limit(0)).collect() == []
    assert providers.triples(spark, ["b:file"]).collect() == []
    assert providers.triples(spark, ["a:disk", "disk"]).count() == 1
    with pytest.raises(KeyError):
        providers.triples(spark, ["a:none"])
