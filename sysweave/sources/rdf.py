"""Graphs from and to files, and triples carried as JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sysweave.functions.identity import encode_value, property_uri
from sysweave.model import TRIPLE_COLUMNS

RDF_TAG = "rdf:Description"
# N-Triples terms: <uri>, _:label, "text", "text"^^<type>, "text"@lang
NTRIPLE = (
    r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+'
    r'(?:<([^>]*)>|(_:[^\s.]+)|"((?:[^"\\]|\\.)*+)"(?:\^\^<([^>]*)>|(@[^\s.]+))?)\s*\.\s*$'
)
XSD = "http://www.w3.org/2001/XMLSchema#"


def read_rdf_xml(spark: SparkSession, path: str, predicates: Sequence[str] | None = None) -> DataFrame:
    """``rdf:Description`` elements of XML files to triples; blank nodes are ``_:label``.

    ``predicates`` names the properties that may occur; without, the files are
    read once more to find them.
    """
    reader = spark.read.format("xml").options(rowTag=RDF_TAG)
    if predicates is not None:
        value = "array<struct<_VALUE:string,`_rdf:resource`:string,`_rdf:nodeID`:string,`_rdf:datatype`:string>>"
        subject = "`_rdf:about` string, `_rdf:nodeID` string"
        reader = reader.schema(", ".join([subject, *(f"`{p}` {value}" for p in predicates)]))
    wide = reader.load(path)
    facts = []
    for field in wide.schema:
        if field.name.startswith("_"):
            continue
        repeated = isinstance(field.dataType, T.ArrayType)
        inner = field.dataType.elementType if repeated else field.dataType
        column = F.col(f"`{field.name}`")
        items = column if repeated else F.when(column.isNotNull(), F.array(column))
        facts.append(F.transform(items, _xml_object(field.name, inner)))
    cells = F.flatten(F.array(*[F.coalesce(f, F.array().cast(_FACTS)) for f in facts]))
    blank = F.concat(F.lit("_:"), _first(wide, ["_rdf:nodeID"]))
    subject = F.coalesce(_first(wide, ["_rdf:about"]), blank)
    return (
        wide.select(subject.alias("s"), F.explode(cells).alias("t"))
        .select("s", "t.*", F.lit(None).cast("string").alias("ctx"))
        .where("o is not null")
        .select(*TRIPLE_COLUMNS)
    )


def rdf_xml_text(triples: DataFrame) -> DataFrame:
    """One ``rdf:Description`` element per triple; predicates are element names."""

    def escaped(text: Column) -> Column:
        for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
            text = F.replace(text, F.lit(char), F.lit(entity))
        return text

    def named(column: Column, about: str) -> Column:
        """The attribute that names a node."""
        blank = F.concat(F.lit(' rdf:nodeID="'), F.substr(column, F.lit(3)), F.lit('"'))
        uri = F.concat(F.lit(f' rdf:{about}="'), escaped(column), F.lit('"'))
        return F.when(column.startswith("_:"), blank).otherwise(uri)

    p, o, kind = F.col("p"), F.col("o"), F.coalesce(F.col("o_type"), F.lit("string"))
    typed = F.when(kind == "string", "").otherwise(
        F.concat(F.lit(f' rdf:datatype="{XSD}'), kind, F.lit('"'))
    )
    literal = F.concat(F.lit("<"), p, typed, F.lit(">"), escaped(o), F.lit("</"), p, F.lit(">"))
    link = F.concat(F.lit("<"), p, named(o, "resource"), F.lit("/>"))
    body = F.when(F.col("o_kind") == "lit", literal).otherwise(link)
    head = F.concat(F.lit("<rdf:Description"), named(F.col("s"), "about"), F.lit(">"))
    return triples.select(F.concat(head, body, F.lit("</rdf:Description>")).alias("value"))


RDF_NAMESPACE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def write_rdf_xml(triples: DataFrame, path: str, predicates: Sequence[str]) -> None:
    """XML files of the triples with the named predicates, an element for each triple."""

    def part(column: Column, blank: bool) -> Column:
        is_blank = column.startswith("_:")
        return F.when(is_blank, F.substr(column, F.lit(3))) if blank else F.when(~is_blank, column)

    s, o, literal = F.col("s"), F.col("o"), F.col("o_kind") == "lit"
    kind = F.coalesce(F.col("o_type"), F.lit("string"))
    value = F.struct(
        F.when(literal, o).alias("_VALUE"),
        F.when(~literal, part(o, False)).alias("_rdf:resource"),
        F.when(~literal, part(o, True)).alias("_rdf:nodeID"),
        F.when(literal & (kind != "string"), F.concat(F.lit(XSD), kind)).alias("_rdf:datatype"),
    )
    wide = triples.where(F.col("p").isin(list(predicates))).select(
        part(s, False).alias("_rdf:about"),
        part(s, True).alias("_rdf:nodeID"),
        *[F.when(F.col("p") == p, value).alias(p) for p in predicates],
    )
    root = f'rdf:RDF xmlns:rdf="{RDF_NAMESPACE}"'
    wide.write.format("xml").options(rowTag=RDF_TAG, rootTag=root, validateName="false").save(path)


_FACTS = "array<struct<p:string,o:string,o_kind:string,o_type:string>>"


def _first(df: DataFrame, names: list[str]) -> Column:
    present = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _xml_object(predicate: str, kind: T.DataType):
    """Object of one XML property: a resource, a blank node, or a literal with its type."""
    fields = kind.fieldNames() if isinstance(kind, T.StructType) else []

    def build(value: Column) -> Column:
        def part(name: str) -> Column:
            return value[name].cast("string") if name in fields else F.lit(None).cast("string")

        text = part("_VALUE") if fields else value.cast("string")
        uri, bnode = part("_rdf:resource"), part("_rdf:nodeID")
        o_kind = F.when(uri.isNotNull(), "uri").when(bnode.isNotNull(), "bnode").otherwise("lit")
        o_type = F.regexp_replace(F.coalesce(part("_rdf:datatype"), F.lit("string")), "^.*#", "")
        return F.struct(
            F.lit(predicate).alias("p"),
            F.coalesce(uri, F.concat(F.lit("_:"), bnode), text).alias("o"),
            o_kind.alias("o_kind"),
            F.when(o_kind == "lit", o_type).alias("o_type"),
        )

    return build


def ntriples_text(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple."""

    def term(column: Column) -> Column:
        return F.when(column.startswith("_:"), column).otherwise(
            F.concat(F.lit("<"), column, F.lit(">"))
        )

    text = F.col("o")
    for char, escape in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        text = F.replace(text, F.lit(char), F.lit(escape))
    # A language is kept as a type that begins with @.
    suffix = (
        F.when(F.coalesce(F.col("o_type"), F.lit("string")) == "string", F.lit(""))
        .when(F.col("o_type").startswith("@"), F.col("o_type"))
        .otherwise(F.concat(F.lit("^^<" + XSD), F.col("o_type"), F.lit(">")))
    )
    literal = F.concat(F.lit('"'), text, F.lit('"'), suffix)
    o = F.when(F.col("o_kind") == "lit", literal).otherwise(term(F.col("o")))
    line = F.concat(term(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" ."))
    return triples.select(line.alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_text(triples).write.text(path)


def parse_ntriples(lines: DataFrame, col: str = "value") -> DataFrame:
    def group(n: int) -> Column:
        return F.regexp_extract(col, NTRIPLE, n)

    # The escapes are those of JSON, but for an escaped apostrophe.
    quoted = F.regexp_replace(group(6), r"\\'", "'")
    text = F.from_json(F.concat(F.lit('{"v":"'), quoted, F.lit('"}')), "v string")["v"]
    text = F.coalesce(text, quoted)
    kind = F.when(group(4) != "", "uri").when(group(5) != "", "bnode").otherwise("lit")
    typed = (
        F.when(group(8) != "", group(8))
        .when(group(7) == "", "string")
        .otherwise(F.regexp_replace(group(7), "^.*#", ""))
    )
    return lines.where(F.col(col).rlike(NTRIPLE)).select(
        F.when(group(1) != "", group(1)).otherwise(group(2)).alias("s"),
        group(3).alias("p"),
        F.when(kind == "uri", group(4)).when(kind == "bnode", group(5)).otherwise(text).alias("o"),
        kind.alias("o_kind"),
        F.when(kind == "lit", typed).alias("o_type"),
        F.lit(None).cast("string").alias("ctx"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


JSON_TRIPLE = (
    "struct<subject:struct<cls:string,keys:map<string,string>>,predicate:string,"
    "object_node:struct<cls:string,keys:map<string,string>>,object_literal:string>"
)


def triples_from_json(df: DataFrame, ontology: Mapping[str, list[str]], col: str = "json"):
    """JSON triples over (class, keys) objects; keys in the order of the class."""
    order = F.create_map(
        *[x for c, ks in ontology.items() for x in (F.lit(c), F.array(*map(F.lit, ks)))]
    )

    def named(moniker: Column) -> Column:
        keys = F.element_at(order, moniker["cls"])
        pairs = F.transform(
            keys, lambda k: F.concat(k, F.lit("="), encode_value(F.element_at(moniker["keys"], k)))
        )
        return F.concat(moniker["cls"], F.lit("."), F.array_join(pairs, ","))

    t = df.select(F.from_json(col, JSON_TRIPLE).alias("t")).select("t.*")
    is_node = F.col("object_node").isNotNull()
    return t.select(
        named(F.col("subject")).alias("s"),
        property_uri([F.col("predicate")]).alias("p"),
        F.when(is_node, named(F.col("object_node"))).otherwise(F.col("object_literal")).alias("o"),
        F.when(is_node, "uri").otherwise("lit").alias("o_kind"),
        F.when(~is_node, "string").alias("o_type"),
        F.lit(None).cast("string").alias("ctx"),
    ).where("s is not null and o is not null")
