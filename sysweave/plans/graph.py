"""Graph patterns, graph algebra and traversal over the facts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sysweave.functions import identity as ident
from sysweave.functions.values import cast_literals
from sysweave.model import LABEL, TYPE, as_set, triples, union_all
from sysweave.operators import graphset as g
from sysweave.operators import match as m
from sysweave.operators import traverse as t
from sysweave.plans import views as v
from sysweave.plans.registry import query

FACTS = ["s", "p", "o", "o_kind", "o_type"]


def solve(source, patterns, **options):
    """``match`` on facts of the given tables, which hold no triple twice."""
    return m.match(source, patterns, is_set=True, **options)


@query(
    "q1_match_region_customers",
    """select 'customer.key='||c_custkey customer, c_name as name, 'nation.key='||n_nationkey nation
    from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
    where r_name='ASIA'""",
)
def region_customers(spark, sf):
    return solve(
        v.geography(spark, sf),
        [
            ("?customer", "in_nation", "?nation"),
            ("?nation", "in_region", "?region"),
            ("?region", "r_name", "ASIA"),
            ("?customer", "c_name", "?name"),
        ],
        select=["customer", "name", "nation"],
    )


@query(
    "q2_match_literals",
    """select 'part.key='||p_partkey part, p_name as name from part
    where p_size=11 and p_brand='Brand#2'""",
)
def literals(spark, sf):
    return solve(
        v.part_facts(spark, sf),
        [("?part", "p_size", "11"), ("?part", "p_brand", "Brand#2"), ("?part", "p_name", "?name")],
    )


@query("q3_match_class", "select 'supplier.key='||s_suppkey x, s_name as name from supplier")
def by_class(spark, sf):
    return solve(v.everything(spark, sf), [("?x", "a", "supplier"), ("?x", "s_name", "?name")])


@query(
    "q4_link_join",
    """select 'order.key='||o_orderkey ord, 'customer.key='||o_custkey customer, c_name as name
    from orders join customer on o_custkey=c_custkey where o_orderstatus='F'""",
)
def link_join(spark, sf):
    return solve(
        union_all([v.order_facts(spark, sf), v.customer_facts(spark, sf)]),
        [
            ("?ord", "o_orderstatus", "F"),
            ("?ord", "by_customer", "?customer"),
            ("?customer", "c_name", "?name"),
        ],
    )


@query(
    "q5_reverse_link",
    """select 'nation.key='||n_nationkey nation, 'supplier.key='||s_suppkey supplier
    from nation join supplier on s_nationkey=n_nationkey where n_name='NATION_3'""",
)
def reverse_link(spark, sf):
    return solve(
        union_all([v.nation_facts(spark, sf), v.supplier_facts(spark, sf)]),
        [("?nation", "n_name", "NATION_3"), ("?supplier", "in_nation", "?nation")],
    )


@query(
    "q6_three_hops",
    """select 'region.key='||n_regionkey n0, 'nation.key='||n_nationkey n1,
    'customer.key='||c_custkey n2, 'order.key='||o_orderkey n3
    from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey""",
)
def three_hops(spark, sf):
    return m.hops(v.tree_edges(spark, sf), 3, "parent", "child")


@query(
    "q7_down_then_up",
    """select 'region.key='||n_regionkey n0, 'nation.key='||n_nationkey n1,
    'customer.key='||c_custkey n2, 'nation.key='||n_nationkey b1, 'region.key='||n_regionkey b0
    from customer join nation on c_nationkey=n_nationkey
    union all select 'nation.key='||c_nationkey, 'customer.key='||c_custkey, 'order.key='||o_orderkey,
      'customer.key='||c_custkey, 'nation.key='||c_nationkey from orders join customer on o_custkey=c_custkey""",
)
def down_up(spark, sf):
    return m.down_then_up(v.tree_edges(spark, sf), 2, "parent", "child")


@query(
    "q8_siblings",
    """select a.k node, a.n shared, b.k sibling from
    (select 'customer.key='||c_custkey k, 'nation.key='||c_nationkey n, c_name from customer) a
    join (select 'customer.key='||c_custkey k, 'nation.key='||c_nationkey n from customer) b on a.n=b.n
    where a.c_name='Customer#000000007'""",
)
def siblings(spark, sf):
    facts = v.customer_facts(spark, sf)
    asked = solve(facts, [("?node", "c_name", "Customer#000000007")])
    return m.siblings(facts, "in_nation", asked)


@query(
    "q8_sibling_groups",
    """select 'nation.key='||c_nationkey shared, 'customer.key='||c_custkey sibling,
    count(*) over (partition by c_nationkey) members from customer""",
)
def sibling_groups(spark, sf):
    return m.sibling_groups(v.customer_facts(spark, sf), "in_nation")


@query(
    "q9_variable_predicate",
    f"select p, o from ({v.CUSTOMER_SQL}) where s='customer.key=12'",
)
def variable_predicate(spark, sf):
    return solve(v.customer_facts(spark, sf), [("customer.key=12", "?p", "?o")])


@query(
    "q10_union",
    """select 'supplier.key='||s_suppkey x, s_name sname, cast(null as varchar) cname from supplier
    union all select 'customer.key='||c_custkey, null, c_name from customer""",
)
def union_of_solutions(spark, sf):
    return m.union_solutions(
        solve(v.supplier_facts(spark, sf), [("?x", "s_name", "?sname")]),
        solve(v.customer_facts(spark, sf), [("?x", "c_name", "?cname")]),
    )


@query(
    "q11_intersection",
    """select 'order.key='||o_orderkey x from
    (select o_orderkey from lineitem l join orders on o_orderkey=l_orderkey where l_returnflag='A' group by 1)
    where o_orderkey in (select l_orderkey from lineitem where l_returnflag='R')""",
)
def intersection(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    orders = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    known = lines.join(orders, "l_orderkey", "left_semi")
    facts = as_set(
        triples(known, ident.node_of_integer("order", "key", "l_orderkey"), "flag", "l_returnflag")
    )
    return solve(facts, [("?x", "flag", "A"), ("?x", "flag", "R")])


@query(
    "q12_filter_regex",
    """select 'part.key='||p_partkey part, p_name as name from part
    where regexp_matches(p_name, 'r[ei][dn]')""",
)
def filter_regex(spark, sf):
    found = solve(v.part_facts(spark, sf), [("?part", "p_name", "?name")])
    return m.filter_regex(found, "?name", "r[ei][dn]")


@query(
    "q13_projection_distinct",
    "select distinct p_brand brand from part",
)
def projection(spark, sf):
    return solve(
        v.part_facts(spark, sf),
        [("?part", "p_brand", "?brand"), ("?part", "p_name", "?name")],
        select=["?brand"],
        distinct=True,
    )


@query(
    "q14_value_product",
    """select r_name as region, x.lo, x.hi, y.flag from region,
    (values (1, 10), (11, 20)) x(lo, hi), (values ('A'), ('R')) y(flag)""",
)
def value_product(spark, sf):
    regions = v.table(spark, sf, "region").select(F.col("r_name").alias("region"))
    return m.product(regions, {("lo", "hi"): [(1, 10), (11, 20)], ("flag",): [("A",), ("R",)]})


@query(
    "q15_instance_table",
    "select 'part.key='||p_partkey s, p_brand, cast(p_size as varchar) p_size from part",
)
def instance_table(spark, sf):
    return m.instance_table(v.everything(spark, sf), "part", ["p_brand", "p_size"])


@query(
    "q16_see_also",
    f"""select s, p, o from ({v.GEOGRAPHY_SQL}) union all
    select 'nation.key='||n_nationkey, 'rdfs:seeAlso', 'nation_menu.key='||n_nationkey from nation""",
)
def see_also(spark, sf):
    return m.see_also(v.geography(spark, sf), r"^nation\.", "nation_menu.").select("s", "p", "o")


@query(
    "q17_dispatch_by_source",
    "select s, p, o from (" + v.REGION_SQL + " union all " + v.SUPPLIER_SQL + ")",
)
def dispatch(spark, sf):
    from sysweave.sources.tables import Providers

    providers = Providers()
    providers.register("geo", "region", lambda s: v.region_facts(s, sf))
    providers.register("geo", "nation", lambda s: v.nation_facts(s, sf))
    providers.register("trade", "supplier", lambda s: v.supplier_facts(s, sf))
    return providers.triples(spark, ["geo:region", "supplier"]).select("s", "p", "o")


@query(
    "u1_providers_about_objects",
    f"""select s, p, o from ({v.SUPPLIER_SQL}) where cast(split_part(s, '=', 2) as integer) % 3 = 1
    union all select s, p, o from ({v.CUSTOMER_SQL}) where s in (select 'customer.key=' || o_custkey from orders)""",
)
def providers_about(spark, sf):
    """Customers with orders and all suppliers are asked for: one provider of suppliers applies to a
    third of them, another is not usable, and no region is among the objects."""
    from sysweave.sources.tables import Providers

    def unread(s):
        raise AssertionError("a provider that is not to be read")

    providers = Providers()
    third = lambda keys: keys["key"].cast("long") % 3 == 1
    providers.register("trade", "supplier", lambda s: v.supplier_facts(s, sf), applies=third)
    providers.register("copy", "supplier", unread, usable=lambda s: False)
    providers.register("trade", "customer", lambda s: v.customer_facts(s, sf))
    providers.register("geo", "region", unread)
    buyers = v.table(spark, sf, "orders").select(F.concat(F.lit("customer.key="), "o_custkey").alias("node"))
    sellers = v.supplier_facts(spark, sf).select(F.col("s").alias("node"))
    return providers.about(buyers.unionByName(sellers)).select("s", "p", "o")


@query(
    "q18_merge_by_object",
    """select object, key, max_by(value, source_rank) as value from (
    select n_nationkey object, 'name' as key, n_name as value, 1 source_rank from nation
    union all select n_nationkey, 'region', cast(n_regionkey as varchar), 1 from nation
    union all select s_nationkey, 'name', min(s_name), 2 from supplier group by s_nationkey
    union all select c_nationkey, 'customers', cast(count(*) as varchar), 3 from customer group by c_nationkey)
    group by object, key""",
)
def merge_by_object(spark, sf):
    n = v.table(spark, sf, "nation")
    s = v.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("object"))
    c = v.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("object"))

    def rows(df, obj, key, value, rank):
        return df.select(
            F.col(obj).alias("object"),
            F.lit(rank).alias("source_rank"),
            F.lit(key).alias("key"),
            value.cast("string").alias("value"),
        )

    return m.merge_by_object(
        union_all(
            [
                rows(n, "n_nationkey", "name", F.col("n_name"), 1),
                rows(n, "n_nationkey", "region", F.col("n_regionkey"), 1),
                rows(s.agg(F.min("s_name").alias("v")), "object", "name", F.col("v"), 2),
                rows(c.agg(F.count(F.lit(1)).alias("v")), "object", "customers", F.col("v"), 3),
            ]
        )
    )


@query(
    "q19_bindings_to_triples",
    """select distinct 'nation.key='||n_nationkey s, u.p, u.o from nation join region on n_regionkey=r_regionkey,
    lateral (values ('name', n_name), ('rname', r_name)) u(p, o)""",
)
def bindings_to_triples(spark, sf):
    found = solve(
        v.geography(spark, sf),
        [
            ("?nation", "in_region", "?region"),
            ("?nation", "n_name", "?name"),
            ("?region", "r_name", "?rname"),
        ],
    )
    return m.bindings_to_triples(found, "nation", ["name", "rname"]).select("s", "p", "o")


def schema_tables(spark, sf):
    """Part types as classes below ``part``, brands as properties of the types that have them."""
    p = v.table(spark, sf, "part")
    classes = p.select(
        F.col("p_type").alias("cls"), F.lit("part").alias("base"), F.lit("a part type").alias("descr")
    ).distinct()
    properties = (
        p.select("p_brand", "p_type").distinct()
        .groupBy(F.col("p_brand").alias("prop"))
        .agg(F.array_sort(F.collect_set("p_type")).alias("domains"))
        .select(
            "prop",
            F.lit("string").alias("type"),
            F.lit("a brand").alias("descr"),
            "domains",
        )
    )
    return classes, properties


@query(
    "q20_class_meta_query",
    "select distinct p_type cls, p_brand prop from part where p_type like 'S%'",
)
def class_meta(spark, sf):
    ontology = m.ontology_triples(*schema_tables(spark, sf))
    found = solve(
        ontology,
        [
            ("?cls", "a", "rdfs:Class"),
            ("?cls", "rdfs:subClassOf", "part"),
            ("?prop", "rdfs:domain", "?cls"),
            ("?prop", "a", "rdf:Property"),
        ],
        select=["cls", "prop"],
    )
    return m.filter_regex(found, "cls", "^S")


@query(
    "q20_property_by_label",
    "select distinct p_brand prop, 'string' as rng from part where p_brand='Brand#7'",
)
def property_by_label(spark, sf):
    ontology = m.ontology_triples(*schema_tables(spark, sf))
    return solve(
        ontology, [("?prop", LABEL, "Brand#7"), ("?prop", "rdfs:range", "?rng")]
    )


@query(
    "q21_objects_of",
    """select 'supplier.key='||s_suppkey subject, 'nation.key='||n_nationkey object,
    'n_name' property, n_name as value from supplier join nation on s_nationkey=n_nationkey""",
)
def objects_of(spark, sf):
    facts = union_all([v.supplier_facts(spark, sf), v.nation_facts(spark, sf)])
    return m.objects_of(facts, "in_nation", "nation").select("subject", "object", "property", "value")


@query(
    "q22_associators",
    """select p_type||'.'||a.r prop, p_type association, a.r as role, 'C'||a.r leg_class,
    b.r other_role, 'C'||b.r other_class from (select distinct p_type from part),
    (values ('one'), ('two')) a(r), (values ('one'), ('two')) b(r) where a.r <> b.r""",
)
def associators(spark, sf):
    types = v.table(spark, sf, "part").select("p_type").distinct()
    legs = m.product(types, {("role",): [("one",), ("two",)]})
    properties = legs.select(
        F.concat_ws(".", "p_type", "role").alias("prop"),
        F.concat(F.lit("ref:C"), "role").alias("type"),
        F.array(F.col("p_type")).alias("domains"),
    )
    return m.associators(properties)


# Graph algebra


def half(spark, sf, even: bool):
    """Customers' facts, those with a positive balance or those of the building segment."""
    c = v.table(spark, sf, "customer")
    kept = c.where("c_acctbal > 0") if even else c.where("c_mktsegment = 'BUILDING'")
    return triples(kept, ident.node_of_integer("customer", "key", "c_custkey"), "name", "c_name")


@query(
    "g1_union",
    """select 'customer.key='||c_custkey s, c_name o from customer
    where c_acctbal > 0 or c_mktsegment='BUILDING'""",
)
def graph_union(spark, sf):
    return g.union(half(spark, sf, True), half(spark, sf, False)).select("s", "o")


@query(
    "g2_subtract",
    """select 'customer.key='||c_custkey s, c_name o from customer
    where c_acctbal > 0 and c_mktsegment<>'BUILDING'""",
)
def graph_subtract(spark, sf):
    return g.subtract(half(spark, sf, True), half(spark, sf, False)).select("s", "o")


@query("g3_size", f"select count(*) triples from (select distinct * from ({v.EVERYTHING_SQL}))")
def graph_size(spark, sf):
    return g.size(v.everything(spark, sf, layout="rows"))


@query(
    "g3_context_sizes",
    """select 'c_nation' ctx, count(distinct c_nationkey) triples from customer
    union all select 's_nation', count(distinct s_nationkey) from supplier""",
)
def context_sizes(spark, sf):
    c = v.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = v.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return g.context_sizes(
        union_all(
            [
                triples(c, F.concat(F.lit("n"), F.col("k")), "used", F.lit("yes"), ctx="c_nation"),
                triples(s, F.concat(F.lit("n"), F.col("k")), "used", F.lit("yes"), ctx="s_nation"),
            ]
        )
    )


@query(
    "g4_node_table",
    f"""with f as ({v.CUSTOMER_SQL}), d as (select distinct s, p, o, o_kind from f)
    select s node, p, o as value, o_kind from d union all
    select distinct o, null, null, null from d where o_kind<>'lit' and o not in (select s from d)""",
)
def node_table(spark, sf):
    return g.node_table(v.customer_facts(spark, sf, layout="rows"))


@query(
    "g5_objects",
    """select 'nation.key='||n_nationkey node, '' host, 'nation' cls, n_nationkey::varchar as k from nation""",
)
def objects(spark, sf):
    found = g.objects(v.geography(spark, sf, layout="rows"), "nation.key=")
    return found.select("node", "host", "cls", F.col("keys")["key"].alias("k"))


@query(
    "g6_adjacency",
    """with t as (select 'nation.key='||n_nationkey x, 'region.key='||n_regionkey y from nation
    union all select 'customer.key='||c_custkey, 'nation.key='||c_nationkey from customer)
    select x a, y b from t union select y, x from t""",
)
def adjacency(spark, sf):
    return g.adjacency(v.geography(spark, sf, layout="rows"), exclude=[TYPE])


@query(
    "g7_connected",
    """with r as (select n_regionkey rk from nation where n_nationkey=4)
    select 'region.key='||rk node from r
    union all select 'nation.key='||n_nationkey from nation, r where n_regionkey=rk
    union all select 'customer.key='||c_custkey from customer join nation on c_nationkey=n_nationkey, r
      where n_regionkey=rk""",
)
def connected(spark, sf):
    return t.connected(v.geography(spark, sf, layout="rows"), "nation.key=4", exclude=[TYPE])


@query(
    "g8_components",
    """with n as (select 'region.key='||n_regionkey r, 'nation.key='||n_nationkey x from nation),
    c as (select r, 'customer.key='||c_custkey x from customer join n on x='nation.key='||c_nationkey),
    o as (select r, 'order.key='||o_orderkey x from orders join c on x='customer.key='||o_custkey),
    a as (select r, x from n union all select r, x from c union all select r, x from o
          union all select distinct r, r from n)
    select x node, min(x) over (partition by r) component from a""",
)
def components(spark, sf):
    return t.components(
        v.tree_edges(spark, sf).select(F.col("parent").alias("a"), F.col("child").alias("b"))
    )


@query(
    "g9_closure",
    f"""with recursive e as ({v.TREE_SQL}), c as (select parent ancestor, child descendant, 1 as depth from e
    union all select c.ancestor, e.child, c.depth+1 from c join e on e.parent=c.descendant)
    select * from c""",
)
def closure(spark, sf):
    return t.closure(v.tree_edges(spark, sf))


@query(
    "g10_roots",
    f"with e as ({v.TREE_SQL}) select distinct parent node from e where parent not in (select child from e)",
)
def roots(spark, sf):
    return t.roots(v.tree_edges(spark, sf))


PAGE_PATHS_SQL = "(select regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) path from pages)"


def page_paths(spark, sf):
    return v.table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path")
    )


@query(
    "g11_path_ancestors",
    f"""with p as (select list_filter(string_split(path,'/'), lambda x: x <> '') parts from {PAGE_PATHS_SQL})
    select distinct '/'||array_to_string(parts[1:n-1], '/') parent, '/'||array_to_string(parts[1:n], '/') child
    from p, lateral (select unnest(range(1, len(parts)+1)) n)""",
)
def path_ancestors(spark, sf):
    return g.path_ancestors(page_paths(spark, sf).where("path <> '/' and path <> ''"))


@query(
    "g12_match_strings",
    f"select s, p, o from ({v.EVERYTHING_SQL}) where o_kind='lit' and regexp_matches(o, '^(?:small|Brand#1)')",
)
def match_strings(spark, sf):
    return g.match_strings(v.everything(spark, sf, layout="rows"), "small|Brand#1").select("s", "p", "o")


@query("g13_all_strings", f"select o as text from ({v.PART_SQL}) where o_kind='lit'")
def all_strings(spark, sf):
    return g.all_strings(v.part_facts(spark, sf, layout="rows"))


@query(
    "g14_find_from",
    """select * from (
    select 1 as depth, 'region.key='||n_regionkey s, 'r_name' p, r_name o
      from nation join region on n_regionkey=r_regionkey where n_nationkey=4
    union all select 1, 'customer.key='||c_custkey, 'c_name', c_name from customer where c_nationkey=4
    union all select 0, 'nation.key=4', 'n_name', n_name from nation where n_nationkey=4
    union all select 2, 'nation.key='||a.n_nationkey, 'n_name', a.n_name from nation a join nation b
      on a.n_regionkey=b.n_regionkey where b.n_nationkey=4 and a.n_nationkey<>4)
    where regexp_matches(o, '^(?:NATION|Customer#0000001)')""",
)
def find_from(spark, sf):
    return t.find_from(
        v.geography(spark, sf, layout="rows"),
        "nation.key=4",
        "NATION|Customer#0000001",
        2,
        exclude_predicates=[TYPE],
    )


@query(
    "g15_bag_distance",
    """with w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) w from conversations)
    select a.conv_id, a.turn, case when len(list_distinct(a.w || b.w)) > 0 then
      (2*len(list_distinct(a.w || b.w)) - len(a.w) - len(b.w)) * 1.0 / len(list_distinct(a.w || b.w)) else 0 end as distance
    from w a join w b on a.conv_id=b.conv_id and b.turn=a.turn+1""",
)
def bag_distance(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    turns = v.table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    both = turns.join(after, ["conv_id", "turn"])
    return both.select("conv_id", "turn", g.bag_distance(F.col("w"), F.col("w2")).alias("distance"))


def hosted_pages(spark, sf):
    """Page objects as two servers name them, with host names in different cases."""
    p = v.table(spark, sf, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1)
    one = F.concat(host, F.lit("@page.Name="), path)
    two = F.concat(F.upper(host), F.lit("@page.Name="), path)
    return p.select(one.alias("a"), two.alias("b"))


@query(
    "g16_link_same",
    """with n as (select distinct u.x as node, u.y as alias from (select regexp_extract(url, '^https?://([^/?#]+)', 1) h,
      regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) pa from pages),
      lateral (values (h||'@page.Name='||pa, 'page.Name='||pa||'@'||lower(h)),
                      (upper(h)||'@page.Name='||pa, 'page.Name='||pa||'@'||lower(h))) u(x, y)),
    l as (select lag(node) over (partition by alias order by encode(node)) s, 'alias' as p, node o from n)
    select * from l where s is not null""",
)
def link_same(spark, sf):
    p = hosted_pages(spark, sf)
    facts = triples(p, "a", "copy", "b", kind="uri")
    return g.link_same(facts).select("s", "p", "o")


@query(
    "g17_with_ontology",
    f"""with f as ({v.NATION_SQL}),
    n as (select distinct x node, split_part(x, '.', 1) cls, split_part(x, '.', 2) ident, split_part(x, '=', 2) k
      from (select s x from f union select o from f where o_kind='uri' and p<>'rdf:type'))
    select s, p, o from f union select node, 'rdf:type', cls from n
    union select node, 'rdfs:label', ident from n union select node, 'key', k from n""",
)
def with_ontology(spark, sf):
    return g.with_ontology(v.nation_facts(spark, sf, layout="rows")).select("s", "p", "o")


@query(
    "g17_derive_ontology",
    """select * from (values ('customer','rdf:type','rdfs:Class'),('nation','rdf:type','rdfs:Class'),
    ('region','rdf:type','rdfs:Class'),('r_name','rdf:type','rdf:Property'),('n_name','rdf:type','rdf:Property'),
    ('c_name','rdf:type','rdf:Property'),('c_mktsegment','rdf:type','rdf:Property'),
    ('in_nation','rdf:type','rdf:Property'),('in_region','rdf:type','rdf:Property'),
    ('r_name','rdfs:domain','region'),('n_name','rdfs:domain','nation'),('c_name','rdfs:domain','customer'),
    ('c_mktsegment','rdfs:domain','customer'),('in_nation','rdfs:domain','customer'),
    ('in_region','rdfs:domain','nation'),('in_nation','rdfs:range','nation'),('in_region','rdfs:range','region'))
    v(s, p, o)""",
)
def derive_ontology(spark, sf):
    return g.derive_ontology(v.geography(spark, sf, layout="rows")).select("s", "p", "o")


@query(
    "g9_closure_from",
    """select 'event.key='||a.event_id ancestor, 'event.key='||b.event_id descendant, b.event_id-a.event_id as depth
    from events a join events b on b.event_id > a.event_id where a.event_id % 2000 = 0""",
)
def closure_from(spark, sf):
    """Every event is followed by the next; all that come after some of them."""
    e = v.events(spark, sf)
    node = ident.node_of_integer("event", "key", "event_id")
    links = e.select(node.alias("child"), ident.node_of_integer("event", "key", F.col("event_id") - 1).alias("parent"))
    return t.closure_from(links.where("parent <> 'event.key=-1'"), e.where("event_id % 2000 = 0").select(node.alias("start")))


@query(
    "g18_rename_predicate",
    f"select s, case p when 'in_nation' then 'home' else p end p, o from ({v.CUSTOMER_SQL})",
)
def rename_predicate(spark, sf):
    return g.rename_predicate(v.customer_facts(spark, sf), "in_nation", "home").select("s", "p", "o")


@query(
    "g19_commutative",
    """select distinct least('n'||c_nationkey, 'r'||n_regionkey) s, greatest('n'||c_nationkey, 'r'||n_regionkey) o
    from customer join nation on c_nationkey=n_nationkey""",
)
def commutative(spark, sf):
    c = v.table(spark, sf, "customer").join(
        v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    a = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    b = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    both = union_all([triples(c, a, "near", b, kind="uri"), triples(c, b, "near", a, kind="uri")])
    return g.commutative(both, ["near"]).select("s", "o")


@query(
    "g20_display_split",
    f"select s, p, o from ({v.NATION_SQL}) union all select 'collapsed', 'in_nation', ''",
)
def display_split(spark, sf):
    facts = v.nation_facts(spark, sf)
    n = v.table(spark, sf, "nation").select(F.lit(g.METADATA_NODE).alias("s")).distinct()
    meta = triples(n, "s", "in_nation", F.lit(g.COLLAPSED), kind="uri")
    graph, collapsed = g.display_split(facts.unionByName(meta))
    marks = collapsed.select(F.lit("collapsed").alias("s"), "p", F.lit("").alias("o"))
    return graph.select("s", "p", "o").unionByName(marks)


@query(
    "g21_subclass_edges",
    """select p_type cls, '' base from part union select p_type||'.'||p_brand, p_type from part
    union select p_type||'.'||p_brand||'.'||p_name, p_type||'.'||p_brand from part""",
)
def subclass_edges(spark, sf):
    p = v.table(spark, sf, "part").select(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"))
    return g.subclass_edges(p)


@query(
    "g22_check_minimal",
    """select * from (values ('planet', cast(null as varchar), cast(null as varchar)),
    ('nation.key=0', 'n_name', 'Elsewhere')) v(s, p, o)""",
)
def check_minimal(spark, sf):
    facts = v.geography(spark, sf, layout="rows")
    required = spark.createDataFrame(
        [
            ("nation.key=1", TYPE, "nation"),
            ("region.key=1", None, None),
            ("planet", None, None),
            ("nation.key=0", "n_name", "Elsewhere"),
        ],
        "s string, p string, o string",
    )
    return g.check_minimal(facts, required)


@query(
    "c14_cast_literals",
    f"""select s, p, o, case o_type when 'integer' then 'integer' else 'string' end xsd,
    case when o_type='integer' then cast(o as bigint) end v from ({v.PART_SQL}) where o_kind='lit'""",
)
def typed_literals(spark, sf):
    typed = cast_literals(v.part_facts(spark, sf, layout="rows").where("o_kind = 'lit'"))
    return typed.select("s", "p", "o", "xsd", F.col("v_integer").cast("long").alias("v"))


@query("s14_tables_to_triples", f"select s, p, o, o_kind, o_type from ({v.EVERYTHING_SQL})")
def all_facts(spark, sf):
    return v.everything(spark, sf, layout="rows").select(*FACTS)


@query(
    "q22_triple_in_several_contexts",
    """select 'customer.key='||c_custkey customer, c_name as name, 'nation.key='||c_nationkey nation from customer""",
)
def several_contexts(spark, sf):
    """Each triple is there twice, once in a context of its own."""
    facts = v.customer_facts(spark, sf)
    both = facts.unionByName(facts.withColumn("ctx", F.col("s")))
    return m.match(both, [("?customer", "c_name", "?name"), ("?customer", "in_nation", "?nation")])


def mixed_kinds(spark, sf):
    """Suppliers point to their nation, every other one only by a text that reads the same."""
    s = v.table(spark, sf, "supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "uri").otherwise("lit")
    near = s.select(
        ident.node_of_integer("supplier", "key", "s_suppkey").alias("s"),
        F.lit("near").alias("p"),
        ident.node_of_integer("nation", "key", "s_nationkey").alias("o"),
        kind.alias("o_kind"),
        F.when(kind == "lit", "string").alias("o_type"),
        F.lit(None).cast("string").alias("ctx"),
    )
    seen = near.where("o_kind = 'uri'").withColumn("p", F.lit("seen"))
    return near, union_all([near, seen, v.nation_facts(spark, sf)])


@query(
    "q22_kind_of_shared_variable",
    """select 'supplier.key='||a.s_suppkey x, 'supplier.key='||b.s_suppkey y, 'nation.key='||a.s_nationkey n
    from supplier a join supplier b on a.s_nationkey=b.s_nationkey and a.s_suppkey%2=0 and b.s_suppkey%2=0""",
)
def kind_of_shared(spark, sf):
    """A text is no node, also where both are objects."""
    return solve(mixed_kinds(spark, sf)[1], [("?x", "near", "?n"), ("?y", "seen", "?n")], select=["x", "y", "n"])


@query(
    "q22_kind_of_constant",
    """select 'supplier.key='||s_suppkey x, 'literal' kind from supplier where s_nationkey=3 and s_suppkey%2=1
    union all select 'supplier.key='||s_suppkey, 'node' from supplier where s_nationkey=3 and s_suppkey%2=0""",
)
def kind_of_constant(spark, sf):
    near, _ = mixed_kinds(spark, sf)
    return union_all(
        [
            solve(near, [("?x", "near", made("nation.key=3"))]).withColumn("kind", F.lit(name))
            for made, name in ((m.Literal, "literal"), (m.Uri, "node"))
        ]
    )
