"""What SQL texts depend on, by patterns over columns; texts are not parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sysweave.functions.identity import node_text
from sysweave.model import triples
from sysweave.session import cut

# Stands for a bracketed part that has been dealt with; no text holds it.
HOLE = "\ue000"
# Words that end a table name and are never its alias.
NOT_ALIAS = (
    "where|on|using|join|inner|left|right|full|cross|natural|outer|group|order|having|limit|"
    "union|intersect|except|minus|set|values|fetch|offset|window|for|when|and|or|not|as|from|select"
)
NAME = r"[A-Za-z_\uE000\[][\w$.\uE000\]-]*"
ITEM = rf"{NAME}(?:\s+(?:as\s+)?(?!(?:{NOT_ALIAS})\b)[A-Za-z_][\w-]*)?"
CLAUSE = (
    rf"(?i)\b(?:from|join|update|into|create\s+table)\s+((?:{ITEM})(?:\s*,\s*(?:{ITEM}))*)"
)
COMMENTS = r"(?s)/\*.*?\*/|--[^\n]*"
STRINGS = r"'(?:[^']|'')*'|\"[^\"]*\""


def _tables_of(flat: Column) -> Column:
    """Names in the table lists of a text without brackets."""
    lists = F.regexp_extract_all(flat, F.lit(CLAUSE), F.lit(1))
    items = F.flatten(F.transform(lists, lambda part: F.split(part, r"\s*,\s*")))
    names = F.transform(items, lambda item: F.regexp_extract(F.trim(item), rf"^({NAME})", 1))
    return F.filter(names, lambda n: (n != "") & ~n.contains(HOLE))


def table_names(sql: Column) -> Column:
    """Sorted distinct upper-case tables a statement reads or changes.

    The innermost brackets are searched and replaced by a hole, as often as the
    text has opening brackets; what is left is the outermost statement.
    """
    no_strings = F.regexp_replace(F.regexp_replace(sql, COMMENTS, " "), STRINGS, "''")
    inner = r"\(([^()]*)\)"
    opened = F.length(no_strings) - F.length(F.replace(no_strings, F.lit("("), F.lit("")))
    start = F.struct(no_strings.alias("text"), F.array().cast("array<string>").alias("found"))
    rounds = F.sequence(F.lit(1), F.greatest(opened, F.lit(1)))

    def step(acc: Column, _: Column) -> Column:
        parts = F.regexp_extract_all(acc["text"], F.lit(inner), F.lit(1))
        tables = F.flatten(F.transform(parts, _tables_of))
        return F.when(
            F.instr(acc["text"], "(") > 0,
            F.struct(
                F.regexp_replace(acc["text"], inner, f" {HOLE} ").alias("text"),
                F.concat(acc["found"], tables).alias("found"),
            ),
        ).otherwise(acc)

    done = F.aggregate(rounds, start, step)
    every = F.concat(done["found"], _tables_of(done["text"]))
    return F.array_sort(F.array_distinct(F.transform(every, F.upper)))


def table_dependencies(queries: DataFrame, col: str = "query") -> DataFrame:
    """(…, query, table): one row per table a statement depends on."""
    return queries.withColumn("table", F.explode(table_names(F.col(col))))


def nested_queries(queries: DataFrame, col: str = "query") -> DataFrame:
    """(query, parent, sub, depth): sub-selects with the select around them.

    ``depth`` counts the selects around; the statement itself has depth 0 and no
    parent. Brackets are matched by their nesting level; those in strings and
    comments are none. Brackets become rows: where one stands and its level are running
    sums over its statement, its partner is the next one of its level, and the
    select around it the last one that is a level of selects further out.
    """
    text = F.col(col)
    stated = cut(
        queries.where(F.length(text) > 0).select(col).withColumn("_id", F.monotonically_increasing_id())
    )
    # Strings and comments as a sign of the same length, so that places stay.
    hidden = F.lit(f"{COMMENTS}|{STRINGS}")
    parts = F.arrays_zip(
        F.split(text, f"{COMMENTS}|{STRINGS}", -1).alias("keep"),
        F.regexp_extract_all(text, hidden, F.lit(0)).alias("hide"),
    )
    masked = F.transform(
        parts,
        lambda x: F.concat(x["keep"], F.repeat(F.lit(HOLE), F.length(F.coalesce(x["hide"], F.lit(""))))),
    )
    # Each piece ends with a bracket, but for what follows the last one.
    pieces = F.regexp_extract_all(F.array_join(masked, ""), F.lit(r"[^()]*[()]|[^()]+$"), F.lit(0))
    marks = F.transform(
        pieces,
        lambda piece: F.struct(
            F.length(piece).alias("n"),
            F.right(piece, F.lit(1)).alias("c"),
            piece.rlike(r"(?i)^\s*select\b").alias("selects"),
        ),
    )
    in_text = Window.partitionBy("_id").orderBy("i")
    so_far = in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("c") == "(", 1).when(F.col("c") == ")", -1).otherwise(0)
    rows = stated.select("_id", F.posexplode(marks).alias("i", "m")).select("_id", "i", "m.*")
    rows = rows.select(
        "_id",
        "c",
        F.sum("n").over(so_far).alias("at"),
        # The level a bracket opens or closes.
        (F.sum(step).over(so_far) + F.when(F.col("c") == ")", 1).otherwise(0)).alias("level"),
        F.lead("selects", 1, False).over(in_text).alias("selects"),
    ).where(F.col("c").isin("(", ")"))
    of_level = Window.partitionBy("_id", "level").orderBy("at")
    closed = F.when(F.lead("c").over(of_level) == ")", F.lead("at").over(of_level))
    spans = rows.withColumn("to", closed).where((F.col("c") == "(") & F.col("selects"))
    top = stated.where(text.rlike(r"(?i)^\s*\(*\s*select\b")).select(
        "_id", F.lit(0).cast("bigint").alias("from"), F.lit(None).cast("bigint").alias("to")
    )
    spans = cut(spans.select("_id", F.col("at").alias("from"), "to").unionByName(top))
    # Selects around: those begun before and not ended.
    ends = spans.where("to is not null").select("_id", F.col("to").alias("x"), F.lit(-1).alias("d"), F.lit(None).cast("bigint").alias("to"))
    begins = spans.select("_id", F.col("from").alias("x"), F.lit(1).alias("d"), "to")
    earlier = Window.partitionBy("_id").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum("d").over(earlier), F.lit(0))
    deep = begins.unionByName(ends).withColumn("depth", depth).where("d = 1")
    own = F.struct(F.col("x").alias("from"), "to")
    nothing = F.lit(None).cast("struct<from:bigint,to:bigint>")
    inner = deep.select("_id", "x", "depth", F.col("depth").alias("key"), own.alias("span"), nothing.alias("outer"))
    outer = deep.select("_id", "x", "depth", (F.col("depth") + 1).alias("key"), nothing.alias("span"), own.alias("outer"))
    of_key = Window.partitionBy("_id", "key").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    found = inner.unionByName(outer).withColumn("outer", F.last("outer", ignorenulls=True).over(of_key))
    found = found.where("span is not null").join(stated, "_id")

    def body(span: Column) -> Column:
        end = F.coalesce(span["to"], F.length(text) + 1)
        return F.substr(text, (span["from"] + 1).cast("int"), (end - span["from"] - 1).cast("int"))

    return found.select(
        col,
        F.when(F.col("outer").isNotNull(), body(F.col("outer"))).alias("parent"),
        body(F.col("span")).alias("sub"),
        F.col("depth").cast("int").alias("depth"),
    )


def query_vs_catalog(deps: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, database): databases that hold **all** tables of the query.

    ``deps`` has (query, table), ``catalog`` (database, table); names compare in
    upper case.
    """
    need = deps.select("query", F.upper("table").alias("table")).distinct()
    needed = need.groupBy("query").agg(F.count(F.lit(1)).alias("needed"))
    have = catalog.select("database", F.upper("table").alias("table")).distinct()
    found = (
        need.join(have, "table")
        .groupBy("query", "database")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    return found.join(needed, "query").where("found = needed").select("query", "database")


def lineage_edges(deps: DataFrame) -> DataFrame:
    """Query -> table facts."""
    return triples(
        deps.select("query", "table").distinct(),
        node_text("query", {"Query": "query"}),
        "table",
        node_text("table", {"Name": "table"}),
        kind="uri",
    )


# Quoted texts and numbers that stand alone.
VALUES = r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b"


def sql_template(sql: Column) -> Column:
    return F.regexp_replace(sql, VALUES, "?")


def sql_templates(queries: DataFrame, col: str = "query") -> DataFrame:
    """(template, position, queries, values): queries equal up to their literals.

    One row per literal position with the number of distinct values there; a
    position with more than one value varies.
    """
    named = queries.select(
        sql_template(F.col(col)).alias("template"),
        F.posexplode_outer(F.regexp_extract_all(col, F.lit(VALUES), F.lit(0))).alias(
            "position", "value"
        ),
    )
    # Equal values are combined before the distinct count.
    each = named.groupBy("template", "position", "value").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("template", "position").agg(
        F.sum("n").alias("queries"), F.count("value").alias("values")
    )


def template_values(queries: DataFrame, col: str = "query") -> DataFrame:
    """(template, position, value, queries): the values met at each position."""
    return (
        queries.select(
            sql_template(F.col(col)).alias("template"),
            F.posexplode(F.regexp_extract_all(col, F.lit(VALUES), F.lit(0))).alias(
                "position", "value"
            ),
        )
        .groupBy("template", "position", "value")
        .agg(F.count(F.lit(1)).alias("queries"))
    )
