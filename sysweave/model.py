"""The triple table, the one data model of the library.

``s, p, o`` are text; ``o_kind`` is ``uri``, ``bnode`` or ``lit``; ``o_type`` is
the literal's type name; ``ctx`` the named context (null = default graph).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE_COLUMNS = ["s", "p", "o", "o_kind", "o_type", "ctx"]
TRIPLE_SCHEMA = "s string, p string, o string, o_kind string, o_type string, ctx string"
# Two rows are the same triple when these agree; the context is not part of it.
IDENTITY = ["s", "p", "o", "o_kind", "o_type"]

TYPE = "rdf:type"
LABEL = "rdfs:label"
COMMENT = "rdfs:comment"
SEE_ALSO = "rdfs:seeAlso"
SUBCLASS = "rdfs:subClassOf"
DOMAIN = "rdfs:domain"
RANGE = "rdfs:range"
CLASS = "rdfs:Class"
PROPERTY = "rdf:Property"
INFORMATION = "information"
SCRIPT = "script"
ALIAS = "alias"

PROPERTY_PREFIX = "urn:sysweave#"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def triples(df: DataFrame, s, p, o, kind="lit", o_type="string", ctx=None) -> DataFrame:
    """One triple per row of ``df``; rows without an object give none."""

    def text(value):
        return value if isinstance(value, Column) else F.lit(value)

    return df.select(
        as_column(s).cast("string").alias("s"),
        text(p).cast("string").alias("p"),
        as_column(o).cast("string").alias("o"),
        text(kind).cast("string").alias("o_kind"),
        (F.lit(None) if kind != "lit" else text(o_type)).cast("string").alias("o_type"),
        text(ctx).cast("string").alias("ctx"),
    ).where(F.col("o").isNotNull() & F.col("s").isNotNull())


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def as_set(df: DataFrame) -> DataFrame:
    """Drop repeated triples, whatever their context.

    Equal rows are combined before the shuffle, so a triple repeated in a third
    of the rows reaches the reducer once per map task.
    """
    return df.dropDuplicates(IDENTITY)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a computed row: later filters are not moved in front of it.

    The optimizer moves a filter below the projection that computes its columns
    and writes their expressions out once per use. For costly expressions that
    is far slower than computing them once.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
