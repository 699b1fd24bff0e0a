"""Graphs in the shapes that files and viewers want."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.functions.identity import parse_nodes, property_name
from sysweave.functions.paths import path_category
from sysweave.model import INFORMATION, LABEL, SCRIPT, TYPE
from sysweave.operators.traverse import roots
from sysweave.session import cut

CALL_COLUMNS = [
    "pid", "occurrences", "style", "status", "function", "arguments", "return", "start", "end",
]


def call_rows(calls: DataFrame) -> DataFrame:
    """The nine columns of a calls file."""
    has = set(calls.columns)
    text = F.array_join("args", ",") if "args" in has else F.col("args_text")
    return calls.select(
        "pid",
        (F.col("occurrences") if "occurrences" in has else F.lit(1)).alias("occurrences"),
        (F.col("style") if "style" in has else F.lit("Orig")).alias("style"),
        "status",
        F.col("fn").alias("function"),
        text.alias("arguments"),
        F.col("ret").alias("return"),
        F.col("t_start").alias("start"),
        F.col("t_end").alias("end"),
    )


def write_calls(calls: DataFrame, path: str, fmt: str = "csv", ordered: bool = False) -> None:
    """Calls as CSV, JSON or text; flows by process id downward when ``ordered``."""
    source = calls
    if ordered:
        source = calls.repartitionByRange(F.col("pid").desc(), "seq").sortWithinPartitions(
            F.col("pid").desc(), "seq"
        )
    rows = call_rows(source)
    if fmt == "csv":
        rows.write.csv(path, header=True)
    elif fmt == "json":
        rows.write.json(path)
    elif fmt == "text":
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in CALL_COLUMNS]
        rows.select(F.concat_ws("\t", *cells).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def bindings_json(solutions: DataFrame, names: Sequence[str]) -> DataFrame:
    """One JSON text per solution: variable -> {type, value}. Variables without a
    ``name__kind`` column are literals."""
    has = set(solutions.columns)

    def cell(name: str) -> Column:
        kind = F.col(f"{name}__kind") if f"{name}__kind" in has else F.lit("lit")
        label = F.when(kind == "lit", "literal").otherwise("url")
        return F.struct(label.alias("type"), F.col(name).cast("string").alias("value")).alias(name)

    return solutions.select(F.to_json(F.struct(*[cell(n) for n in names])).alias("binding"))


def nodes_and_links(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a graph without its scripts.

    Nodes are long: (id, kind, name, value), kind ``node`` (name = class, value =
    label), ``info`` (free information) or ``property`` (its last value in text
    order), so that a node with very many values is not one row.
    """
    kept = triples.where(F.col("p") != SCRIPT)
    is_lit = F.col("o_kind") == "lit"
    ids = (
        kept.select(F.col("s").alias("id")).union(kept.where(~is_lit).select("o")).distinct()
    )
    parsed = parse_nodes(ids, "id")
    heads = parsed.select(
        "id", F.lit("node").alias("kind"), F.col("cls").alias("name"), F.col("ident").alias("value")
    )
    infos = kept.where(is_lit & (F.col("p") == INFORMATION)).select(
        F.col("s").alias("id"), F.lit("info").alias("kind"), F.lit("").alias("name"),
        F.col("o").alias("value"),
    ).distinct()
    props = (
        kept.where(is_lit & (F.col("p") != INFORMATION))
        .groupBy(F.col("s").alias("id"), property_name(F.col("p")).alias("name"))
        .agg(F.max("o").alias("value"))
        .select("id", F.lit("property").alias("kind"), "name", "value")
    )
    links = kept.where(~is_lit).select(
        F.col("s").alias("source"),
        F.col("o").alias("target"),
        property_name(F.col("p")).alias("property"),
    ).distinct()
    return heads.unionByName(infos).unionByName(props), links


def menu_tree(triples: DataFrame, predicate: str = SCRIPT) -> DataFrame:
    """(root, path, node, name, depth) of the tree a predicate spans.

    ``path`` sorts as a nested menu does: names of the nodes from the root down.
    A node reached from several roots has a row for each.
    """
    edges = triples.where(F.col("p") == predicate).select(
        F.col("s").alias("parent"), F.col("o").alias("child")
    )
    names = (
        triples.where((F.col("p") == INFORMATION) & (F.col("o_kind") == "lit"))
        .groupBy(F.col("s").alias("node"))
        .agg(F.max("o").alias("name"))
    )
    named = edges.join(names, edges["child"] == names["node"], "left").select(
        "parent", "child", F.coalesce("name", "child").alias("name")
    )
    steps = cut(named.groupBy("parent", "child").agg(F.max("name").alias("name")))
    tops = roots(edges).join(names, "node", "left")
    own = F.coalesce("name", "node")
    level = cut(
        tops.select(
            F.col("node").alias("root"), own.alias("path"), "node", own.alias("name"), F.lit(0).alias("depth")
        )
    )
    found = level
    # A path is carried down with the root it starts from; of several paths of the
    # least length to a node the first by text is taken.
    while not level.isEmpty():
        below = (
            level.select("root", "path", F.col("node").alias("parent"), "depth")
            .join(steps, "parent")
            .groupBy("root", F.col("child").alias("node"))
            .agg(
                F.min(F.concat_ws("/", "path", "name")).alias("path"),
                F.max("name").alias("name"),
                (F.max("depth") + 1).alias("depth"),
            )
            .join(found.select("root", "node"), ["root", "node"], "left_anti")
        )
        level = cut(below.select("root", "path", "node", "name", "depth"))
        found = found.unionByName(level)
    return found


def objects_by_class(triples: DataFrame) -> DataFrame:
    """(cls, s, p, o): objects under their class; empty information is skipped."""
    kept = triples.where(
        (F.col("p") != TYPE) & ~((F.col("p") == INFORMATION) & (F.trim("o") == ""))
    )
    return parse_nodes(kept, "s").select("cls", "s", "p", "o").distinct()


def collapse_property(
    triples: DataFrame, predicate: str, columns: Sequence[str], priority: Sequence[str] = ()
) -> DataFrame:
    """One row per object reached by a collapsed predicate, one column per property.

    ``columns`` are the properties wanted; those in ``priority`` come first, the
    rest in alphabetical order. Of several values the greatest is shown.
    """
    first = [c for c in priority if c in columns]
    order = first + sorted(c for c in columns if c not in first and c != INFORMATION)
    reached = triples.where(F.col("p") == predicate).select(
        F.col("s").alias("subject"), F.col("o").alias("object")
    ).distinct()
    wide = (
        triples.where(F.col("p").isin(order))
        .groupBy(F.col("s").alias("object"))
        .pivot("p", order)
        .agg(F.max("o"))
    )
    return reached.join(wide, "object", "left").select("subject", "object", *order)


def summary(
    processes: DataFrame, files: DataFrame, categories: Sequence[str] | None = None
) -> DataFrame:
    """(section, item, detail): processes, then files by category."""
    procs = processes.select(
        F.lit("Processes").alias("section"),
        F.col("pid").cast("string").alias("item"),
        F.concat_ws(
            "|", "executable", "t_create", "t_end", F.col("ppid").cast("string")
        ).alias("detail"),
    )
    named = files.select("path").distinct().withColumn("category", path_category(F.col("path")))
    if categories is not None:
        named = named.where(F.col("category").isin(list(categories)))
    rows = named.select(
        F.col("category").alias("section"), F.col("path").alias("item"), F.lit("").alias("detail")
    )
    return procs.unionByName(rows)


def described(triples: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, cls, label, alias, information) of the nodes of known classes.

    ``classes`` has a row per class: (cls, keys, label, alias, information). Where the
    texts name a key in braces, the value the node has for it is put in; ``keys``
    are the keys a node of the class must have, others are left out.
    """
    nodes = parse_nodes(triples.select(F.col("s").alias("node")).distinct(), "node")
    known = nodes.select("node", "cls", F.col("keys").alias("has")).join(classes, "cls")
    whole = known.where(F.forall("keys", lambda k: F.map_contains_key(F.col("has"), k)))

    def filled(name: str) -> Column:
        return F.aggregate(
            F.map_entries("has"),
            F.col(name),
            lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
        ).alias(name)

    return whole.select("node", "cls", filled("label"), filled("alias"), filled("information"))


def labels(triples: DataFrame) -> DataFrame:
    """Display label of every node: its stated label, else its identity text."""
    stated = triples.where(F.col("p") == LABEL).groupBy(F.col("s").alias("node")).agg(
        F.max("o").alias("label")
    )
    nodes = triples.select(F.col("s").alias("node")).distinct()
    return nodes.join(stated, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )
