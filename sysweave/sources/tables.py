"""How every table becomes facts: one typed node per row, a triple per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sysweave.functions.identity import node_of_integer, node_text, parse_nodes
from sysweave.model import TRIPLE_COLUMNS, TRIPLE_SCHEMA, TYPE, triples, union_all

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def node(df: DataFrame, cls: str, keys: Mapping[str, str]) -> Column:
    """Node text of a row; integer keys skip the check for unsafe characters."""
    types = dict(df.dtypes)
    if len(keys) == 1:
        ((key, column),) = keys.items()
        if isinstance(column, str) and types.get(column) in INTEGERS:
            return node_of_integer(cls, key, column)
    return node_text(cls, keys)


def link(df: DataFrame, cls: str, keys: Mapping[str, str]) -> Column:
    """Node text of a row's reference; null when a key is null."""
    found = [column if isinstance(column, Column) else F.col(column) for column in keys.values()]
    text = node(df, cls, keys)
    types = dict(df.dtypes)
    if all(isinstance(c, str) and types.get(c) in INTEGERS for c in keys.values()) and len(keys) == 1:
        return text  # a null number makes a null text
    return F.when(reduce(and_, [column.isNotNull() for column in found]), text)


def literal_type(spark_type: str) -> str:
    # Literal type names by column type.
    names = {
        "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer",
        "bigint": "long", "float": "double", "double": "double", "timestamp": "dateTime",
        "timestamp_ntz": "dateTime",
    }
    return names.get(spark_type, "string")


def tables_to_triples(
    df: DataFrame,
    cls: str,
    keys: Mapping[str, str],
    properties: Mapping[str, str | Column] | None = None,
    links: Mapping[str, tuple[str, Mapping[str, str]]] | None = None,
    ctx: str | None = None,
    layout: str = "union",
) -> DataFrame:
    """Rows of a table as triples.

    properties: predicate -> column. links: predicate -> (class, keys of the node).
    layout ``union`` has one branch per predicate: a pattern with a constant
    predicate then reads only the columns of its branch. ``rows`` reads the
    table once and suits work on whole graphs.
    """
    types = dict(df.dtypes)
    subject = node(df, cls, keys)
    facts = [(F.lit(TYPE), F.lit(cls), "uri", None)]
    for name, value in (properties or {}).items():
        column = value if isinstance(value, Column) else F.col(value)
        kind = literal_type(types.get(value, "string")) if isinstance(value, str) else "string"
        facts.append((F.lit(name), column.cast("string"), "lit", kind))
    for name, (target, target_keys) in (links or {}).items():
        facts.append((F.lit(name), link(df, target, target_keys), "uri", None))
    if layout == "union":
        return union_all(
            [triples(df, subject, p, o, kind, t or "string", ctx) for p, o, kind, t in facts]
        )
    packed = F.array(
        *[
            F.struct(
                p.alias("p"),
                o.alias("o"),
                F.lit(kind).alias("o_kind"),
                F.lit(t).cast("string").alias("o_type"),
            )
            for p, o, kind, t in facts
        ]
    )
    rows = df.select(subject.alias("s"), F.explode(packed).alias("t"))
    return (
        rows.select("s", "t.*", F.lit(ctx).cast("string").alias("ctx"))
        .where("o is not null")
        .select(*TRIPLE_COLUMNS)
    )


@dataclass(frozen=True)
class Provider:
    """What gives facts about the objects of a class.

    ``usable`` says whether it can be read at all in a session, ``applies`` for which objects,
    by a column of the keys of the object's name (a map of texts); without them always
    and for all.
    """

    read: Callable[[SparkSession], DataFrame]
    usable: Callable[[SparkSession], bool] | None = None
    applies: Callable[[Column], Column] | None = None


class Providers:
    """Classes and the tables that feed them, by the prefix of their source."""

    def __init__(self) -> None:
        self._by_source: dict[str, dict[str, Provider]] = {}

    def register(
        self,
        source: str,
        cls: str,
        provider: Callable[[SparkSession], DataFrame],
        usable: Callable[[SparkSession], bool] | None = None,
        applies: Callable[[Column], Column] | None = None,
    ):
        self._by_source.setdefault(source, {})[cls] = Provider(provider, usable, applies)

    def classes(self, source: str) -> list[str]:
        return sorted(self._by_source.get(source, {}))

    def found(self, spark: SparkSession, names: list[str]) -> list[tuple[str, Provider]]:
        """(class, provider) of those named ``source:class`` or ``class`` (any source) that are
        usable; each once. A name nothing was registered under is an error."""
        chosen = {}
        for name in names:
            source, _, cls = name.rpartition(":")
            sources = [source] if source else sorted(self._by_source)
            there = [s for s in sources if cls in self._by_source.get(s, {})]
            if not there:
                raise KeyError(f"no provider for {name}")
            chosen.update({(s, cls): self._by_source[s][cls] for s in there})
        return [(c, p) for (_, c), p in chosen.items() if p.usable is None or p.usable(spark)]

    def triples(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """Union of the usable providers of some names; no other is read or planned."""
        chosen = [provider.read(spark) for _, provider in self.found(spark, names)]
        return union_all(chosen) if chosen else spark.createDataFrame([], TRIPLE_SCHEMA)

    def about(self, objects: DataFrame, col: str = "node") -> DataFrame:
        """The facts about the objects a column names, by the providers that apply to each.

        Only providers of classes that occur among the objects are read; which
        occur is asked once, of the registered classes. Objects of other classes, and
        null or broken names, have no facts; a name that is repeated counts once.
        """
        spark = objects.sparkSession
        known = sorted({cls for classes in self._by_source.values() for cls in classes})
        named = parse_nodes(objects.select(F.col(f"`{col}`").alias("s")).distinct(), "s")
        asked = named.where(F.col("cls").isin(known)).select("s", "cls", "keys")
        present = sorted(r["cls"] for r in asked.select("cls").distinct().collect())
        parts = []
        for cls, provider in self.found(spark, present):
            mine = asked.where(F.col("cls") == cls)
            if provider.applies is not None:
                mine = mine.where(provider.applies(F.col("keys")))
            parts.append(provider.read(spark).join(mine.select("s"), "s", "left_semi"))
        found = [p.select(*TRIPLE_COLUMNS) for p in parts]
        return union_all(found) if found else spark.createDataFrame([], TRIPLE_SCHEMA)


def read_table(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A query on a database through Spark's JDBC source, to feed ``tables_to_triples``."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def catalog_edges(constraints: DataFrame) -> DataFrame:
    """(schema, table, referenced_schema, referenced_table, constraint) rows to edges."""
    return triples(
        constraints.where("referenced_table is not null"),
        node_text("table", {"Schema": "schema", "Name": "table"}),
        F.concat(F.lit("constraint."), F.col("constraint")),
        node_text("table", {"Schema": "referenced_schema", "Name": "referenced_table"}),
        kind="uri",
    )


def captured_sql(sessions: DataFrame, statements: DataFrame) -> DataFrame:
    """Text of running statements: the long text, or the short one where there is no
    long one. Sessions without a statement give no row."""
    joined = sessions.join(statements, "sql_id", "left")
    text = F.coalesce("sql_fulltext", "sql_text")
    return joined.where(text.isNotNull()).withColumn("query", text)
