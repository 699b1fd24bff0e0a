"""The given tables seen as facts, logs, texts and listings.

Each view is derived by Spark from whole tables. Beside it stands the SQL that
states the same content straight from the tables, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sysweave.functions.identity import node_of_integer
from sysweave.model import union_all
from sysweave.session import spread
from sysweave.sources.tables import tables_to_triples


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Facts: one class per table.
def region_facts(spark, sf, **kw):
    return tables_to_triples(
        table(spark, sf, "region"), "region", {"key": "r_regionkey"}, {"r_name": "r_name"}, **kw
    )


def nation_facts(spark, sf, **kw):
    return tables_to_triples(
        table(spark, sf, "nation"),
        "nation",
        {"key": "n_nationkey"},
        {"n_name": "n_name"},
        {"in_region": ("region", {"key": "n_regionkey"})},
        **kw,
    )


def customer_facts(spark, sf, **kw):
    return tables_to_triples(
        table(spark, sf, "customer"),
        "customer",
        {"key": "c_custkey"},
        {"c_name": "c_name", "c_mktsegment": "c_mktsegment"},
        {"in_nation": ("nation", {"key": "c_nationkey"})},
        **kw,
    )


def supplier_facts(spark, sf, **kw):
    return tables_to_triples(
        table(spark, sf, "supplier"),
        "supplier",
        {"key": "s_suppkey"},
        {"s_name": "s_name"},
        {"in_nation": ("nation", {"key": "s_nationkey"})},
        **kw,
    )


def order_facts(spark, sf, **kw):
    return tables_to_triples(
        table(spark, sf, "orders"),
        "order",
        {"key": "o_orderkey"},
        {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"},
        {"by_customer": ("customer", {"key": "o_custkey"})},
        **kw,
    )


def part_facts(spark, sf, **kw):
    return tables_to_triples(
        table(spark, sf, "part"),
        "part",
        {"key": "p_partkey"},
        {"p_name": "p_name", "p_brand": "p_brand", "p_size": "p_size"},
        **kw,
    )


def line_facts(spark, sf, **kw):
    return tables_to_triples(
        table(spark, sf, "lineitem"),
        "line",
        {"order": "l_orderkey", "number": "l_linenumber"},
        {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"},
        {"of_order": ("order", {"key": "l_orderkey"}), "of_part": ("part", {"key": "l_partkey"})},
        **kw,
    )


def geography(spark, sf, **kw) -> DataFrame:
    return union_all([f(spark, sf, **kw) for f in (region_facts, nation_facts, customer_facts)])


def everything(spark, sf, **kw) -> DataFrame:
    parts = (
        region_facts, nation_facts, customer_facts, supplier_facts, order_facts, part_facts, line_facts,
    )
    return union_all([f(spark, sf, **kw) for f in parts])


def _facts_sql(tab: str, cls: str, key: str, props: dict[str, str], links: dict, name: str = "key") -> str:
    s = f"'{cls}.{name}=' || {key}"
    rows = [f"select {s} s, 'rdf:type' p, '{cls}' o, 'uri' o_kind, cast(null as varchar) o_type from {tab}"]
    for prop, kind in props.items():
        rows.append(f"select {s}, '{prop}', cast({prop} as varchar), 'lit', '{kind}' from {tab}")
    for name, (target, col) in links.items():
        rows.append(f"select {s}, '{name}', '{target}.key=' || {col}, 'uri', null from {tab}")
    return " union all ".join(rows)


REGION_SQL = _facts_sql("region", "region", "r_regionkey", {"r_name": "string"}, {})
NATION_SQL = _facts_sql(
    "nation", "nation", "n_nationkey", {"n_name": "string"}, {"in_region": ("region", "n_regionkey")}
)
CUSTOMER_SQL = _facts_sql(
    "customer", "customer", "c_custkey", {"c_name": "string", "c_mktsegment": "string"},
    {"in_nation": ("nation", "c_nationkey")},
)
SUPPLIER_SQL = _facts_sql(
    "supplier", "supplier", "s_suppkey", {"s_name": "string"}, {"in_nation": ("nation", "s_nationkey")}
)
ORDER_SQL = _facts_sql(
    "orders", "order", "o_orderkey", {"o_orderstatus": "string", "o_orderpriority": "string"},
    {"by_customer": ("customer", "o_custkey")},
)
PART_SQL = _facts_sql(
    "part", "part", "p_partkey", {"p_name": "string", "p_brand": "string", "p_size": "integer"}, {}
)
GEOGRAPHY_SQL = " union all ".join([REGION_SQL, NATION_SQL, CUSTOMER_SQL])
LINE_SQL = _facts_sql(
    "lineitem", "line", "l_orderkey || ',number=' || l_linenumber",
    {"l_returnflag": "string", "l_linestatus": "string"},
    {"of_order": ("order", "l_orderkey"), "of_part": ("part", "l_partkey")}, "order",
)
EVERYTHING_SQL = " union all ".join([GEOGRAPHY_SQL, SUPPLIER_SQL, ORDER_SQL, PART_SQL, LINE_SQL])

# Directories of the given tables: region / nation / customer, and orders below.
TREE_SQL = """
select 'region.key=' || n_regionkey parent, 'nation.key=' || n_nationkey child from nation
union all
select 'nation.key=' || c_nationkey, 'customer.key=' || c_custkey from customer
union all
select 'customer.key=' || o_custkey, 'order.key=' || o_orderkey from orders
"""


def tree_edges(spark, sf) -> DataFrame:
    n, c, o = (table(spark, sf, t) for t in ("nation", "customer", "orders"))

    def edge(df, up, up_key, down, down_key):
        return df.select(
            node_of_integer(up, "key", up_key).alias("parent"),
            node_of_integer(down, "key", down_key).alias("child"),
        )

    return union_all(
        [
            edge(n, "region", "n_regionkey", "nation", "n_nationkey"),
            edge(c, "nation", "c_nationkey", "customer", "c_custkey"),
            edge(o, "customer", "o_custkey", "order", "o_orderkey"),
        ]
    )


# Events as a log: the user is the process, the event the line, ``k`` of its
# properties the argument.
def events(spark, sf) -> DataFrame:
    return with_argument(table(spark, sf, "events"))


def with_argument(e: DataFrame) -> DataFrame:
    return e.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("long"))


def instant() -> Column:
    """``ts`` as an instant, whatever the zone of the session."""
    return F.timestamp_micros(
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    )


def stamp(ts: Column) -> Column:
    """Time of the day as a log prints it."""
    return F.date_format(ts, "HH:mm:ss.SSSSSS")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def trace_lines(spark, sf) -> DataFrame:
    """(session, seq, line): a strace log made of all events."""
    return lines_of(spread(events(spark, sf)))


def lines_of(e: DataFrame) -> DataFrame:
    k = F.col("k").cast("string")
    amount = F.round(F.col("value") * 100).cast("long").cast("string")
    child = (F.lit(100000) + F.col("user_id") * 1000 + F.col("k")).cast("string")
    kind = F.col("event_type")
    odd = F.col("k") % 2 == 1
    call = (
        F.when(
            (kind == "signup") & odd,
            _text('openat(AT_FDCWD, "data/f', k, '", O_RDONLY|O_CLOEXEC) = 3</srv/data/f', k, ">"),
        )
        .when(
            kind == "signup",
            _text('open("/out/f', k, '", O_WRONLY|O_CREAT, 0666) = 4</out/f', k, ">"),
        )
        .when(kind == "view", _text("read(3</srv/data/f", k, '>, "x, \\"y\\"", 4096) = ', amount))
        .when(kind == "click", _text("write(4</out/f", k, '>, "z"..., 512) = ', amount))
        .when((kind == "purchase") & odd, _text("close(3</srv/data/f", k, ">) = 0"))
        .when(kind == "purchase", _text("wait4(-1, [{WIFEXITED(s)}], 0, NULL) = ", child))
        .when(
            F.col("k") % 4 == 0,
            _text("clone(child_stack=0, flags=CLONE_VM|SIGCHLD) = ", child),
        )
        .when(
            F.col("k") % 4 == 1,
            _text('execve("/usr/bin/python', k, '", ["python", "run', k, '.py"], [/* 22 vars */]) = 0'),
        )
        .when(F.col("k") % 4 == 2, 'stat("/missing", 0x7ffe) = -1 ENOENT (No such file or directory)')
        .otherwise("brk(NULL) = 0x55d0")
    )
    line = F.concat(
        F.when(F.col("user_id") > 0, _text("[pid ", F.col("user_id").cast("string"), "] ")).otherwise(""),
        stamp(F.col("ts")),
        F.lit(" "),
        call,
        F.lit(" <0.000010>"),
    )
    return e.select(F.lit("events").alias("session"), F.col("event_id").alias("seq"), line.alias("line"))


CALLS_SQL = """
calls as (
 select 'events' as session, event_id seq, user_id pid, k,
   case when event_type='signup' and k%2=1 then 'openat@SYS' when event_type='signup' then 'open@SYS'
        when event_type='view' then 'read@SYS' when event_type='click' then 'write@SYS'
        when event_type='purchase' and k%2=1 then 'close@SYS' when event_type='purchase' then 'wait4@SYS'
        when k%4=0 then 'clone@SYS' when k%4=1 then 'execve@SYS' when k%4=2 then 'stat@SYS'
        else 'brk@SYS' end fn,
   case when event_type='signup' and k%2=1 then '3</srv/data/f'||k||'>'
        when event_type='signup' then '4</out/f'||k||'>'
        when event_type in ('view','click') then cast(cast(round(value*100) as bigint) as varchar)
        when event_type='purchase' and k%2=1 then '0'
        when event_type='purchase' then cast(100000+user_id*1000+k as varchar)
        when k%4=0 then cast(100000+user_id*1000+k as varchar) when k%4=1 then '0'
        when k%4=2 then '-1 ENOENT (No such file or directory)' else '0x55d0' end ret,
   case when (event_type='signup' and k%2=1) or event_type='view' or (event_type='purchase' and k%2=1)
          then '/srv/data/f'||k
        when event_type in ('signup','click') then '/out/f'||k
        when event_type='error' and k%4=2 then '/missing' end path,
   case when event_type in ('view','click') then cast(round(value*100) as bigint) end bytes,
   case when event_type='purchase' and k%2=0 or event_type='error' and k%4=0
        then 100000+user_id*1000+k end other_pid,
   strftime(ts, '%H:%M:%S.%f') t_start
 from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)
)
"""


def trace_calls(spark, sf) -> DataFrame:
    """The log above, read: calls with arguments."""
    from sysweave.sources.trace import parse_lines, split_args

    return split_args(parse_lines(trace_lines(spark, sf)))


# Events as flows without going through text: the steps that only need order.
def flow_calls(spark, sf) -> DataFrame:
    return flow_of(events(spark, sf))


def flow_of(e: DataFrame, *more: Column) -> DataFrame:
    sig = F.array((F.col("k") % 3).cast("string"))
    return e.select(
        F.lit("events").alias("session"),
        F.col("user_id").alias("pid"),
        F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit("@SYS")).alias("fn"),
        sig.alias("sig"),
        instant().alias("t_start"),
        instant().alias("t_end"),
        *more,
    )


FLOW_SQL = """
flow as (
 select 'events' as session, user_id pid, event_id seq, event_type||'@SYS' fn,
   cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint)%3 as varchar) sig,
   event_type||'@SYS:'||cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint)%3 as varchar) full_sig,
   ts as t_start
 from events
)
"""


def interrupted_calls(spark, sf) -> DataFrame:
    """Clicks begin a call, purchases resume it; the other events are whole calls."""
    return halves_of(events(spark, sf))


def halves_of(e: DataFrame, *more: Column) -> DataFrame:
    return e.select(
        F.lit("events").alias("session"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("pid"),
        F.when(F.col("event_type").isin("click", "purchase"), F.lit("read@SYS"))
        .otherwise(F.concat("event_type", F.lit("@SYS")))
        .alias("fn"),
        F.array(F.col("k").cast("string")).alias("args"),
        F.when(F.col("event_type") == "click", "unfinished")
        .when(F.col("event_type") == "purchase", "resumed")
        .otherwise("plain")
        .alias("status"),
        stamp(F.col("ts")).alias("t_start"),
        stamp(F.col("ts")).alias("t_end"),
        F.lit("strace").alias("tracer"),
        *more,
    )
