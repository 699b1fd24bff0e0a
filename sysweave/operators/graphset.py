"""Graph algebra, reconciliation and metadata over the triple table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sysweave.functions.identity import alias_text, parse_nodes, property_name, unquote
from sysweave.model import (
    ALIAS,
    CLASS,
    COMMENT,
    DOMAIN,
    IDENTITY,
    INFORMATION,
    LABEL,
    PROPERTY,
    RANGE,
    SCRIPT,
    SEE_ALSO,
    TYPE,
    as_set,
    triples,
    union_all,
)
from sysweave.operators.ordered import scan
from sysweave.session import cut

METADATA_NODE = "urn:sysweave:metadata"
COLLAPSED = "collapsed"


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return as_set(a.unionByName(b))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples of ``a`` that are not in ``b``, each once."""
    unique = as_set(a)
    cond = [unique[c].eqNullSafe(b[c]) for c in IDENTITY]
    return unique.join(b, cond, "left_anti")


def size(source: DataFrame) -> DataFrame:
    """Number of distinct triples."""
    return source.select(*IDENTITY).distinct().agg(F.count(F.lit(1)).alias("triples"))


def context_sizes(source: DataFrame) -> DataFrame:
    return (
        source.select("ctx", *IDENTITY).distinct().groupBy("ctx").agg(
            F.count(F.lit(1)).alias("triples")
        )
    )


def node_table(source: DataFrame) -> DataFrame:
    """(node, p, value, o_kind): every node that is no literal with its values.

    Nodes that are only objects have one row without property.
    """
    facts = as_set(source).select(
        F.col("s").alias("node"), "p", F.col("o").alias("value"), "o_kind"
    )
    targets = source.where("o_kind <> 'lit'").select(F.col("o").alias("node")).distinct()
    lonely = targets.join(
        source.select(F.col("s").alias("node")).distinct(), "node", "left_anti"
    )
    return facts.unionByName(lonely, allowMissingColumns=True)


def objects(source: DataFrame, url_filter: str) -> DataFrame:
    """Nodes whose text contains the marker, with host, class and keys."""
    nodes = (
        source.select(F.col("s").alias("node"))
        .union(source.where("o_kind <> 'lit'").select("o"))
        .distinct()
        .where(F.col("node").contains(url_filter))
    )
    return parse_nodes(nodes)


def adjacency(source: DataFrame, exclude=(), localhost: str | None = None) -> DataFrame:
    """Undirected edges (a, b) between nodes that are no literals, both ways, each once."""
    links = source.where((F.col("o_kind") != "lit") & ~F.col("p").isin(list(exclude) or [""]))
    if localhost is not None:
        links = links.where((F.col("s") != localhost) & (F.col("o") != localhost))
    both = F.array(
        F.struct(F.col("s").alias("a"), F.col("o").alias("b")),
        F.struct(F.col("o").alias("a"), F.col("s").alias("b")),
    )
    return links.select(F.explode(both).alias("e")).select("e.a", "e.b").distinct()


def match_strings(source: DataFrame, regex: str) -> DataFrame:
    """Literal triples whose text matches from its first character."""
    return source.where((F.col("o_kind") == "lit") & F.col("o").rlike(f"^(?:{regex})"))


def all_strings(source: DataFrame) -> DataFrame:
    return source.where("o_kind = 'lit'").select(unquote(F.col("o")).alias("text"))


def bag_distance(a: Column, b: Column) -> Column:
    """Share of the words of either bag that the bags do not have in common."""
    both = F.size(F.array_union(a, b))
    apart = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.when(both > 0, apart / both).otherwise(0.0)


def link_same(source: DataFrame) -> DataFrame:
    """Alias edges chaining the nodes that stand for the same object, in text order."""
    nodes = (
        source.select(F.col("s").alias("node"))
        .union(source.where("o_kind <> 'lit'").select("o"))
        .distinct()
        .withColumn("alias", alias_text(F.col("node")))
    )
    return chain(nodes, "alias", "node")


def chain(nodes: DataFrame, group: str, col: str) -> DataFrame:
    """Edges from each member of a group to the next one.

    The members are ranked over the whole table by a range-partitioned sort, so
    a group with very many members spans several tasks.
    """
    ranked = dense_rank_by(nodes, [group, col])
    linked = scan(
        ranked.withColumn("_all", F.lit(0)),
        ["_all"],
        "_rank",
        previous={"_was": F.struct(F.col(group).alias("g"), F.col(col).alias("n"))},
    )
    same = linked.where(F.col("_was.g") == F.col(group))
    return triples(same, F.col("_was.n"), ALIAS, F.col(col), kind="uri")


def dense_rank_by(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_rank``: position in the total order, 0 upward.

    A range partitioning sorts in parallel; partitions learn where they start
    from one count each.
    """
    # The sorted rows are written once: their partition numbers must not change
    # between the count and the numbering.
    part = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    kept = cut(part).withColumn("_part", F.shiftright("_mono", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        kept.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    )
    return (
        kept.join(F.broadcast(starts), "_part")
        .withColumn("_rank", F.col("_skip") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_skip", "_mono")
    )


def with_ontology(source: DataFrame) -> DataFrame:
    """The triples plus type, label and key properties of every object named in
    them; scripts become see-also links, information becomes comments."""
    is_lit = F.col("o_kind") == "lit"
    scripts = source.where(F.col("p") == SCRIPT)
    see = scripts.withColumns(
        {
            "p": F.lit(SEE_ALSO),
            "o": F.when(is_lit, F.col("o")).otherwise(F.concat("o", F.lit("&mode=rdf"))),
        }
    )
    info = source.where(F.col("p") == INFORMATION).withColumn("p", F.lit(COMMENT))
    plain = source.where(~F.col("p").isin(SCRIPT, INFORMATION))
    nodes = parse_nodes(
        plain.select(F.col("s").alias("node"))
        .union(plain.where(~is_lit & (F.col("p") != TYPE)).select("o"))
        .distinct()
    ).where("cls <> ''")
    keys = nodes.select("node", F.explode("keys").alias("k", "v"))
    return as_set(
        union_all(
            [
                plain,
                see,
                info,
                triples(nodes, "node", TYPE, F.col("cls"), kind="uri"),
                triples(nodes, "node", LABEL, F.col("ident")),
                triples(keys, "node", F.col("k"), F.col("v")),
            ]
        )
    )


def derive_ontology(source: DataFrame) -> DataFrame:
    """Classes and properties in use, with the domains and ranges observed."""
    plain = source.where(~F.col("p").isin(SCRIPT, INFORMATION, TYPE))
    cls = F.regexp_extract  # class of a node text
    pattern = r"^(?:[^@,=]*@)?([a-zA-Z_][a-zA-Z0-9_/]*)\."
    seen = plain.select(
        property_name(F.col("p")).alias("prop"),
        cls("s", pattern, 1).alias("domain"),
        F.when(F.col("o_kind") != "lit", cls("o", pattern, 1)).alias("range"),
    ).distinct()
    domains = seen.where("domain <> ''").select("prop", "domain").distinct()
    ranges = seen.where("range <> ''").select("prop", "range").distinct()
    used = seen.select(F.explode(F.array("domain", "range")).alias("cls")).where("cls <> ''")
    names = used.distinct()
    return as_set(
        union_all(
            [
                triples(names, "cls", TYPE, F.lit(CLASS), kind="uri"),
                triples(seen.select("prop").distinct(), "prop", TYPE, F.lit(PROPERTY), kind="uri"),
                triples(domains, "prop", DOMAIN, F.col("domain"), kind="uri"),
                triples(ranges, "prop", RANGE, F.col("range"), kind="uri"),
            ]
        )
    )


def rename_predicate(source: DataFrame, a: str, b: str) -> DataFrame:
    return source.withColumn("p", F.when(F.col("p") == a, F.lit(b)).otherwise(F.col("p")))


def commutative(source: DataFrame, predicates) -> DataFrame:
    """One edge per unordered pair for symmetric predicates, lesser node first."""
    swap = F.col("p").isin(list(predicates)) & (F.col("s") > F.col("o"))
    return as_set(
        source.withColumns(
            {
                "s": F.when(swap, F.col("o")).otherwise(F.col("s")),
                "o": F.when(swap, F.col("s")).otherwise(F.col("o")),
            }
        )
    )


def display_split(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph without layout metadata, predicates marked as collapsed)."""
    meta = F.col("s") == METADATA_NODE
    collapsed = source.where(meta & (F.col("o") == COLLAPSED)).select("p").distinct()
    return source.where(~meta), collapsed


def subclass_edges(df: DataFrame, col: str = "path") -> DataFrame:
    """``a/b/c`` class paths to (cls, base) rows with dots; top classes have an empty base."""
    parts = F.split(col, "/")
    named = df.select(
        parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")
    )
    return named.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("n")), ".").alias("cls"),
        F.array_join(F.slice("parts", F.lit(1), F.col("n") - 1), ".").alias("base"),
    ).distinct()


def check_minimal(ontology: DataFrame, required: DataFrame) -> DataFrame:
    """(s, p, o) rows of ``required`` that the ontology lacks; a null matches anything.

    Each required row is matched on the columns it fills. ``required`` is written first, so that a
    small one is sent to the facts; only facts of its subjects are then grouped or shuffled.
    """
    required = cut(required.select("s", "p", "o"))
    facts = ontology.select("s", "p", "o").join(required.select("s"), "s", "left_semi")
    full = required.where("p is not null and o is not null")
    by_subject = required.where("p is null or o is null")
    missing = full.join(facts, ["s", "p", "o"], "left_anti")
    lacking = by_subject.join(facts.select("s").distinct(), "s", "left_anti")
    return missing.select("s", "p", "o").unionByName(lacking.select("s", "p", "o"))


def path_ancestors(df: DataFrame, col: str = "path") -> DataFrame:
    """Directory edges (parent, child) of each path down from the root."""
    parts = F.filter(F.split(col, "/"), lambda x: x != "")
    named = df.select(
        parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")
    )
    child = F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/"))
    parent = F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("n") - 1), "/"))
    return named.select(parent.alias("parent"), child.alias("child")).distinct()
