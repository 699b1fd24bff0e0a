"""Graph patterns over the triple table, as joins.

A pattern is a tuple ``(s, p, o)``; text starting with ``?`` is a variable, any
other text a constant, ``a`` the type predicate. A constant object written as
``Literal`` or ``Uri`` is of that kind, plain text of any. The output has a
column per variable. What else a query needs (left joins, anti joins, grouping, order) is
the DataFrame API on that output.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.model import LABEL, SEE_ALSO, TYPE, as_set, triples

Pattern = tuple[str, str, str]


class Literal(str):
    """A constant object that is a literal, whatever its text begins with."""


class Uri(str):
    """A constant object that is not a literal."""


def is_variable(term) -> bool:
    return isinstance(term, str) and term.startswith("?") and not isinstance(term, Literal | Uri)


def kind_condition(term) -> list[Column]:
    if isinstance(term, Literal):
        return [F.col("o_kind") == "lit"]
    return [F.col("o_kind") != "lit"] if isinstance(term, Uri) else []


def variables(patterns: Sequence[Pattern]) -> list[str]:
    seen: list[str] = []
    for pattern in patterns:
        for term in pattern:
            if is_variable(term) and term[1:] not in seen:
                seen.append(term[1:])
    return seen


def connected_order(patterns: Sequence[Pattern]) -> list[Pattern]:
    """The patterns, each sharing a variable with the ones before it.

    Only this is decided here; the optimizer picks the order of the joins.
    """
    if not patterns:
        raise ValueError("a match needs a pattern with a variable")
    left = sorted(patterns, key=lambda p: sum(is_variable(t) for t in p))
    out, known = [left.pop(0)], set()
    known.update(variables(out))
    while left:
        found = next((p for p in left if known & set(variables([p]))), None)
        if found is None:
            raise ValueError(
                "the patterns fall apart into groups without a shared variable; "
                "match each group by itself"
            )
        left.remove(found)
        out.append(found)
        known.update(variables([found]))
    return out


def solve_one(
    source: DataFrame, pattern: Pattern, nodes: set[str], typed: bool, carried: dict[str, str] | None = None
) -> DataFrame:
    """Solutions of one pattern. ``nodes`` are variables that stand for objects; ``carried``
    names further columns of the source and what they are called among the solutions."""
    s, p, o = pattern
    conditions: list[Column] = []
    columns: dict[str, Column] = {}
    for place, term in (("s", s), ("p", p), ("o", o)):
        if not is_variable(term):
            value = TYPE if place == "p" and term == "a" else term
            conditions.append(F.col(place) == F.lit(str(value)))
            if place == "o":
                conditions.extend(kind_condition(term))
        elif term[1:] in columns:
            conditions.append(F.col(place) == columns[term[1:]])
        else:
            columns[term[1:]] = F.col(place)
    if is_variable(o):
        if o[1:] in nodes:
            conditions.append(F.col("o_kind") != "lit")
        if o not in (s, p):
            columns[f"{o[1:]}__kind"] = F.col("o_kind")
            if typed:
                columns[f"{o[1:]}__type"] = F.coalesce(F.col("o_type"), F.lit(""))
    columns |= {name: F.col(c) for c, name in (carried or {}).items()}
    found = source.where(reduce(lambda a, b: a & b, conditions)) if conditions else source
    return found.select(*[column.alias(name) for name, column in columns.items()])


def match(
    source: DataFrame,
    patterns: Sequence[Pattern],
    select: Sequence[str] | None = None,
    distinct: bool = False,
    typed: bool = False,
    kinds: bool = False,
    is_set: bool = False,
) -> DataFrame:
    """Solutions of a graph pattern: the natural join of its patterns.

    A graph is a set: a triple repeated, or in several contexts, counts once.
    ``is_set=True`` says that ``source`` has no such rows and saves the step that
    drops them. Terms compare by text and kind, so a literal is never equal to a
    node of the same text; ``typed=True`` also compares the types of literals, as
    RDF terms do. ``kinds=True`` keeps ``var__kind`` beside each variable.
    """
    subjects = {p[0][1:] for p in patterns if is_variable(p[0])}
    out: DataFrame | None = None
    for pattern in connected_order([p for p in patterns if variables([p])]):
        step = solve_one(source, pattern, subjects, typed)
        step = step if is_set else step.distinct()
        if out is None:
            out = step
            continue
        shared = [v for v in variables([pattern]) if v in out.columns]
        extra = [c for c in step.columns if "__" in c and c in out.columns]
        out = out.join(step, shared + extra)
    for s, p, o in (p for p in patterns if not variables([p])):
        # A pattern without variables only has to hold.
        p = TYPE if p == "a" else p
        same = [F.col("s") == s, F.col("p") == p, F.col("o") == str(o), *kind_condition(o)]
        fact = source.where(reduce(lambda a, b: a & b, same))
        out = out.where(fact.exists())
    wanted = [v.lstrip("?") for v in (select or variables(patterns))]
    columns = [F.col(v) for v in wanted]
    if kinds:
        for v in wanted:
            kind = F.col(f"{v}__kind") if f"{v}__kind" in out.columns else F.lit("uri")
            columns.append(kind.alias(f"{v}__kind"))
    out = out.select(*columns)
    return out.distinct() if distinct else out


def union_solutions(*solutions: DataFrame) -> DataFrame:
    """Bag union; variables one side lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), solutions)


def filter_regex(solutions: DataFrame, variable: str, pattern: str) -> DataFrame:
    """Keep solutions whose value contains the pattern, not anchored."""
    return solutions.where(F.col(variable.lstrip("?")).rlike(pattern))


def hops(edges: DataFrame, k: int, start: str = "s", end: str = "o") -> DataFrame:
    """Chains of exactly ``k`` edges: columns n0 .. nk."""
    out = edges.select(F.col(start).alias("n0"), F.col(end).alias("n1"))
    for i in range(1, k):
        step = edges.select(F.col(start).alias(f"n{i}"), F.col(end).alias(f"n{i + 1}"))
        out = out.join(step, f"n{i}")
    return out.select(*[f"n{i}" for i in range(k + 1)])


def down_then_up(edges: DataFrame, k: int, start: str = "s", end: str = "o") -> DataFrame:
    """``k`` links down from a node and ``k`` up again from the same leaf.

    An edge goes from a node to what lies below it, and a node has one parent,
    so each leaf contributes one row.
    """
    down = hops(edges, k, start, end)
    up = down.select(
        F.col(f"n{k}"), *[F.col(f"n{i}").alias(f"b{i}") for i in range(k - 1, -1, -1)]
    )
    return down.join(up, f"n{k}").select(
        *[f"n{i}" for i in range(k + 1)], *[f"b{i}" for i in range(k - 1, -1, -1)]
    )


def siblings(source: DataFrame, predicate: str, of: DataFrame, col: str = "node") -> DataFrame:
    """Subjects sharing a value with the nodes of ``of``; a node is its own sibling.

    The nodes asked for drive the join, so the rows are those of the answer and
    not every pair of every group.
    """
    facts = source.where(F.col("p") == predicate)
    asked = facts.join(of.select(F.col(col).alias("s")).distinct(), "s")
    left = asked.select(F.col("s").alias(col), F.col("o").alias("shared"))
    right = facts.select(F.col("s").alias("sibling"), F.col("o").alias("shared"))
    return left.join(right, "shared").select(col, "shared", "sibling")


def sibling_groups(source: DataFrame, predicate: str) -> DataFrame:
    """All groups of siblings, one row per member with the size of its group.

    A pair of siblings is two rows with the same ``shared``; writing the pairs
    out would square the largest group.
    """
    facts = source.where(F.col("p") == predicate).select(
        F.col("o").alias("shared"), F.col("s").alias("sibling")
    )
    sizes = facts.groupBy("shared").agg(F.count(F.lit(1)).alias("members"))
    return facts.join(sizes, "shared").select("shared", "sibling", "members")


def product(df: DataFrame, bindings: Mapping[tuple[str, ...], Sequence[tuple]]) -> DataFrame:
    """Each row with every combination of the given value lists.

    ``bindings`` maps a tuple of variables to the list of their correlated
    values, as written in the query. The lists are part of the plan, so their
    size is known when it is made; tables are never multiplied with each other.
    """
    out = df
    for n, (names, values) in enumerate(bindings.items()):
        rows = F.array(
            *[
                F.struct(*[F.lit(v).alias(name) for name, v in zip(names, row, strict=True)])
                for row in values
            ]
        )
        out = out.withColumn(f"_b{n}", F.explode(rows))
        for name in names:
            out = out.withColumn(name, F.col(f"_b{n}.{name}"))
        out = out.drop(f"_b{n}")
    return out


def instance_table(source: DataFrame, cls: str, properties: Sequence[str]) -> DataFrame:
    """Instances of a class with one column per property, the least of several values.

    Patterns grouped by their typed subject need this one shuffle on the
    subject instead of a join per property.
    """
    wanted = source.where(
        ((F.col("p") == TYPE) & (F.col("o") == cls)) | F.col("p").isin(list(properties))
    )
    return (
        wanted.groupBy("s")
        .agg(
            F.max((F.col("p") == TYPE) & (F.col("o") == cls)).alias("_is"),
            *[F.min(F.when(F.col("p") == p, F.col("o"))).alias(p) for p in properties],
        )
        .where("_is")
        .drop("_is")
    )


def see_also(source: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """The triples and, for every typed subject whose name matches, a link to more."""
    subjects = source.where(F.col("p") == TYPE).select("s").distinct()
    target = F.regexp_replace("s", pattern, replacement)
    more = triples(
        subjects.where(F.col("s").rlike(pattern)), "s", SEE_ALSO, target, kind="uri"
    )
    return source.unionByName(more)


def merge_by_object(attributes: DataFrame) -> DataFrame:
    """(object, source_rank, key, value) rows: per object and key the value of the
    highest-ranked source; equal ranks are settled by the value."""
    return attributes.groupBy("object", "key").agg(
        F.max(F.struct("source_rank", "value")).alias("_m")
    ).select("object", "key", F.col("_m.value").alias("value"))


def bindings_to_triples(solutions: DataFrame, subject: str, attributes: Sequence[str]) -> DataFrame:
    """Each object's attributes as triples named after their variables."""
    named = solutions.select(
        F.col(subject).alias("_s"),
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("k"), F.col(a).cast("string").alias("v"))
                      for a in attributes])
        ).alias("kv"),
    )
    return as_set(triples(named, "_s", F.col("kv.k"), F.col("kv.v")))


def ontology_triples(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(cls, base, descr) and (prop, type, descr, domains, range) tables as triples."""
    from sysweave.model import CLASS, COMMENT, DOMAIN, PROPERTY, RANGE, SUBCLASS, union_all

    each_domain = properties.withColumn("domain", F.explode("domains"))
    is_ref = F.col("type").startswith("ref:")
    target = F.when(is_ref, F.substr("type", F.lit(5))).otherwise(F.col("type"))
    return as_set(
        union_all(
            [
                triples(classes, "cls", TYPE, F.lit(CLASS), kind="uri"),
                triples(classes, "cls", LABEL, F.col("cls")),
                triples(classes, "cls", COMMENT, F.col("descr")),
                triples(classes.where("base <> ''"), "cls", SUBCLASS, F.col("base"), kind="uri"),
                triples(properties, "prop", TYPE, F.lit(PROPERTY), kind="uri"),
                triples(properties, "prop", LABEL, F.col("prop")),
                triples(properties, "prop", RANGE, target, kind="uri"),
                triples(each_domain, "prop", DOMAIN, F.col("domain"), kind="uri"),
            ]
        )
    )


def objects_of(source: DataFrame, predicate: str, cls: str) -> DataFrame:
    """Objects of a class reached by a predicate, with all their literal properties,
    one row per (subject, object, property, value)."""
    reached = source.where((F.col("p") == predicate) & (F.col("o_kind") != "lit")).select(
        F.col("s").alias("subject"), F.col("o").alias("object")
    )
    members = source.where((F.col("p") == TYPE) & (F.col("o") == cls)).select(
        F.col("s").alias("object")
    )
    facts = source.where(F.col("o_kind") == "lit").select(
        F.col("s").alias("object"), F.col("p").alias("property"), F.col("o").alias("value")
    )
    return reached.join(members, "object", "left_semi").join(facts, "object", "left")


def associators(properties: DataFrame, cls: str | None = None) -> DataFrame:
    """Properties named ``association.role`` with the class and role of the other leg."""
    name, role = F.substring_index("prop", ".", 1), F.substring_index("prop", ".", -1)
    legs = properties.where(F.instr("prop", ".") > 1).select(
        "prop", "domains", name.alias("association"), role.alias("role"),
        F.regexp_replace("type", "^ref:", "").alias("leg_class"),
    )
    other = legs.select(
        "association",
        F.col("role").alias("other_role"),
        F.col("leg_class").alias("other_class"),
    )
    out = legs.join(other, "association").where("role <> other_role")
    if cls is not None:
        out = out.where(F.array_contains("domains", cls))
    return out.select("prop", "association", "role", "leg_class", "other_role", "other_class")
