"""Relations between processes, sockets, files, packages and database objects; identity,
paths and values as columns; sources, shapes and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sysweave.functions import identity as ident
from sysweave.functions import paths, values
from sysweave.model import INFORMATION, SCRIPT, triples, union_all
from sysweave.operators import match as m
from sysweave.operators import relations as r
from sysweave.operators import shapes
from sysweave.operators import traverse as t
from sysweave.plans import views as v
from sysweave.plans.registry import query
from sysweave.streaming.run import fresh_folder
from sysweave.sources import rdf, samples, tables
from sysweave.streaming import events as ev
from sysweave.streaming import samples as st

SPO = ["s", "p", "o"]


def text(column):
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def procs(spark, sf):
    cu = v.table(spark, sf, "customer")
    return cu.select(
        F.col("c_custkey").alias("pid"),
        F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 10).cast("long")).alias("ppid"),
        F.concat(F.lit("CORP\\"), "c_mktsegment").alias("user"),
        F.col("c_name").alias("command"),
    )


@query(
    "r1_process_edges",
    """select 'process.Handle='||c_custkey s, 'rdf:type' p, 'process' o from customer
    union all select 'process.Handle='||c_custkey, 'pid', c_custkey::varchar from customer
    union all select 'process.Handle='||c_custkey, 'command', c_name from customer
    union all select 'process.Handle='||c_custkey, 'ppid', 'process.Handle='||(c_custkey//10) from customer where c_custkey>0
    union all select 'process.Handle='||c_custkey, 'user', 'user.Name='||c_mktsegment from customer""",
)
def process_edges(spark, sf):
    bare = procs(spark, sf).withColumn("user", F.substring_index("user", "\\", -1))
    return r.process_edges(bare).select(*SPO)


def conns(spark, sf):
    o = v.table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    return o.select(
        cust.alias("pid"),
        F.when(key % 5 == 0, "UNIX").otherwise("INET").alias("family"),
        F.when(key % 7 == 0, "DGRAM").otherwise("STREAM").alias("type"),
        F.concat(F.lit("10.0.0."), text(cust % 50)).alias("laddr"),
        (key % 100).alias("lport"),
        F.when(status != "O", F.concat(F.lit("10.0.0."), text(key % 50))).alias("raddr"),
        F.when(status != "O", cust % 100).alias("rport"),
        F.when(status == "F", "ESTABLISHED").when(status == "O", "LISTEN").otherwise("TIME_WAIT").alias("status"),
    )


CONNS = """conns as (select o_custkey pid, case when o_orderkey%5=0 then 'UNIX' else 'INET' end family,
   case when o_orderkey%7=0 then 'DGRAM' else 'STREAM' end typ, '10.0.0.'||(o_custkey%50) laddr, o_orderkey%100 lport,
   case when o_orderstatus<>'O' then '10.0.0.'||(o_orderkey%50) end raddr, case when o_orderstatus<>'O' then o_custkey%100 end rport,
   case o_orderstatus when 'F' then 'ESTABLISHED' when 'O' then 'LISTEN' else 'TIME_WAIT' end status from orders)"""


@query(
    "r2_socket_edges",
    f"""with {CONNS}, k as (select * from conns where family='INET' and typ='STREAM' and status='ESTABLISHED')
    select 'process.Handle='||pid s, 'has_socket' p, 'addr.Id='||laddr||':'||lport o from k
    union select 'addr.Id='||laddr||':'||lport, 'socket_end', 'addr.Id='||raddr||':'||rport from k where raddr is not null
    union select 'addr.Id='||laddr||':'||lport, 'information', status from k""",
)
def socket_edges(spark, sf):
    return r.socket_edges(conns(spark, sf), only_established=True).select(*SPO)


@query(
    "r3_socket_users",
    f"""with {CONNS}, k as (select * from conns where raddr is not null),
    e as (select pid, laddr a, lport port from k union select pid, raddr, rport from k),
    t as (select 'h'||s_suppkey host, case when s_suppkey%2=0 then '127.0.0.1' else '10.0.0.'||(s_suppkey%50) end addr, s_suppkey%100 port from supplier)
    select distinct host, addr, port, pid from e join t using (port) where a=addr or a=host""",
)
def socket_users(spark, sf):
    s = v.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    targets = s.select(
        F.concat(F.lit("h"), text(key)).alias("host"),
        F.when(key % 2 == 0, "127.0.0.1").otherwise(F.concat(F.lit("10.0.0."), text(key % 50))).alias("addr"),
        (key % 100).alias("port"),
    )
    return r.socket_users(conns(spark, sf), targets)


@query(
    "r4_connections_between",
    f"""with {CONNS}, e as (select distinct laddr||':'||lport l, raddr||':'||rport r, pid from conns where raddr is not null),
    c as (select distinct least(l,r)||'|'||greatest(l,r) as connection, l as side, pid from e)
    select connection, side, pid from c where connection in (select connection from c group by 1 having count(distinct side)=2)""",
)
def connections_between(spark, sf):
    return r.connections_between(conns(spark, sf))


def maps(spark, sf):
    li = v.table(spark, sf, "lineitem")
    part = F.col("l_partkey")
    path = (
        F.when(part % 10 == 0, "[heap]")
        .when(part % 10 == 1, F.concat(F.lit("/usr/lib/libp"), text(part), F.lit(".so")))
        .when(part % 10 == 2, F.concat(F.lit("/opt/p"), text(part), F.lit(" (deleted)")))
        .otherwise(F.concat(F.lit("/opt/p"), text(part)))
    )
    return li.select(F.col("l_suppkey").alias("pid"), path.alias("path"))


MAPS = """k as (select distinct l_suppkey pid, '/opt/p'||l_partkey path from lineitem where l_partkey%10 > 1)"""


@query(
    "r5_shared_maps",
    f"with {MAPS} select path, count(*) processes from k group by path having count(*) >= 2",
)
def shared_maps(spark, sf):
    return r.shared_maps(maps(spark, sf), min_processes=2)


@query(
    "r5_shared_map_edges",
    f"with {MAPS} select 'process.Handle='||pid s, 'memmap' p, 'file.Name='||path o from k",
)
def shared_map_edges(spark, sf):
    return r.shared_map_edges(maps(spark, sf)).select(*SPO)


def symbols(spark, sf):
    li = v.table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("/lib/s"), text("l_suppkey")).alias("library"),
        F.concat(F.lit("sym"), text("l_partkey")).alias("symbol"),
        F.when(F.col("l_linenumber") == 1, "T").when(F.col("l_linenumber") < 5, "U").otherwise("D").alias("type"),
    )


@query(
    "r6_symbol_links",
    """select distinct 'file.Name=/lib/s'||l_suppkey s, case when l_linenumber=1 then 'symbol_defined' else 'symbol_undefined' end p,
    'symbol.Name=sym'||l_partkey o from lineitem where l_linenumber < 5""",
)
def symbol_links(spark, sf):
    return r.symbol_links(symbols(spark, sf)).select(*SPO)


@query(
    "r6_resolve_symbols",
    """with d as (select l_partkey p, count(distinct l_suppkey) definers, min('/lib/s'||l_suppkey) definer from lineitem where l_linenumber=1 group by 1),
    u as (select distinct l_suppkey s, l_partkey p from lineitem where l_linenumber between 2 and 4)
    select '/lib/s'||s as library, 'sym'||p symbol, coalesce(definers, 0) definers, definer from u left join d using (p)""",
)
def resolve_symbols(spark, sf):
    return r.resolve_symbols(symbols(spark, sf))


@query(
    "r7_service_edges",
    """select distinct 'service.Name=n'||c_nationkey s, 'service' p, 'service.Name='||c_mktsegment o from customer
    union select 'service.Name=r'||n_regionkey, 'service', 'service.Name=n'||n_nationkey from nation""",
)
def service_edges(spark, sf):
    cu, n = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    down = cu.select(
        F.concat(F.lit("n"), text("c_nationkey")).alias("service"), F.col("c_mktsegment").alias("needs"),
        F.lit(None).cast("string").alias("needed_by"),
    )
    up = n.select(
        F.concat(F.lit("n"), text("n_nationkey")).alias("service"), F.lit(None).cast("string").alias("needs"),
        F.concat(F.lit("r"), text("n_regionkey")).alias("needed_by"),
    )
    return r.service_edges(down.unionByName(up)).select(*SPO)


@query("r8_user_processes", "select c_custkey pid, c_name command from customer where c_mktsegment='BUILDING'")
def user_processes(spark, sf):
    return r.user_processes(procs(spark, sf), "HOME\\BUILDING").select("pid", "command")


@query(
    "r9_user_groups",
    "select distinct 'user.Name=u'||o_custkey s, 'group' p, 'group.Name='||o_orderstatus o from orders",
)
def user_groups(spark, sf):
    o = v.table(spark, sf, "orders")
    return r.user_groups(
        o.select(F.concat(F.lit("u"), text("o_custkey")).alias("user"), F.col("o_orderstatus").alias("group"))
    ).select(*SPO)


@query(
    "r10_object_dependencies",
    """select distinct 'table.Owner=o'||o_custkey||',Name=t'||o_orderstatus s, 'depends' p,
    'view.Owner=app,Name=v'||o_custkey o from orders""",
)
def object_dependencies(spark, sf):
    o = v.table(spark, sf, "orders")
    rows = o.select(
        F.lit("app").alias("owner"), F.concat(F.lit("v"), text("o_custkey")).alias("name"), F.lit("VIEW").alias("type"),
        F.concat(F.lit("o"), text("o_custkey")).alias("ref_owner"),
        F.concat(F.lit("t"), "o_orderstatus").alias("ref_name"), F.lit("TABLE").alias("ref_type"),
    )
    return r.object_dependencies(rows, "used_by").select(*SPO)


@query(
    "r11_queue_bindings",
    """select 'queue.Vhost=n'||s_nationkey||',Name='||replace(s_name,'#','-') s, u.p, u.o from supplier,
    lateral (values ('routing_key', s_suppkey::varchar), ('destination', s_nationkey::varchar)) u(p, o)""",
)
def queue_bindings(spark, sf):
    s = v.table(spark, sf, "supplier")
    rows = s.select(
        F.concat(F.lit("n"), text("s_nationkey")).alias("vhost"), F.replace("s_name", F.lit("#"), F.lit("-")).alias("queue"),
        F.col("s_suppkey").alias("routing_key"), F.col("s_nationkey").alias("destination"),
    )
    return r.queue_bindings(rows, ["routing_key", "destination"]).select(*SPO)


@query(
    "r12_packet_edges",
    """select distinct 'addr.Id=10.0.'||((l_suppkey//256)%256)||'.'||(l_suppkey%256)||':'||(l_partkey%65536) s, 'socket_end' p,
    'addr.Id=10.1.'||((l_partkey//256)%256)||'.'||(l_partkey%256)||':'||(l_suppkey%65536) o from lineitem where l_linenumber<>3""",
)
def packet_edges(spark, sf):
    li = v.table(spark, sf, "lineitem")

    def hexed(value, digits):
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    # Every other packet has one option word, so its header is four bytes longer.
    long = F.col("l_linenumber") % 2 == 0
    packet = F.concat(
        F.when(long, "46").otherwise("45"),
        F.lit("00003C000040004000"[:16]),
        F.when(F.col("l_linenumber") == 3, F.lit("11")).otherwise("06"),
        F.lit("0000"),
        F.lit("0A00"), hexed(supp % 65536, 4),
        F.lit("0A01"), hexed(part % 65536, 4),
        F.when(long, "01010101").otherwise(""),
        hexed(part % 65536, 4), hexed(supp % 65536, 4), F.lit("00000000"),
    )
    return r.packet_edges(li.select(F.unhex(packet).alias("packet"))).select(*SPO)


@query(
    "r13_open_file_edges",
    """with k as (select distinct l_suppkey pid, '/opt/p'||l_partkey path from lineitem where l_partkey%10 > 2),
    d as (select distinct l_suppkey, '/opt/p'||l_partkey||' (deleted)' from lineitem where l_partkey%10 = 2),
    h as (select distinct l_suppkey, '[heap]' from lineitem where l_partkey%10=0),
    a as (select * from k union all select * from d union all select * from h)
    select 'process.Handle='||pid s, 'open_file' p, 'file.Name='||case when path like '%(deleted)' then
      'B64_'||rtrim(replace(replace(base64(encode(path)), '+', '-'), '/', '_'), '=')
      when path='[heap]' then 'B64_W2hlYXBd' else path end o from a where path in (select path from a group by path having count(*)>=2)""",
)
def open_file_edges(spark, sf):
    return r.open_file_edges(maps(spark, sf)).select(*SPO)


def netstat_lines(spark, sf):
    o = v.table(spark, sf, "orders")
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    line = F.concat(
        F.when(key % 3 == 0, "udp").otherwise("tcp"),
        F.lit("   0      0 10.0.0."), text(cust % 50), F.lit(":"), text(key % 100), F.lit("   "),
        F.when(key % 4 == 0, "0.0.0.0:*").otherwise(F.concat(F.lit("[fe80::1%2]:"), text(cust % 100))),
        F.lit("  "),
        F.when(status == "F", "ESTABLISHED").when(status == "P", "TIME_WAIT").otherwise("LISTEN"),
        F.lit("   "),
        F.when(status == "P", "-").otherwise(F.concat(text(cust), F.lit("/prog"))),
    )
    return o.select(line.alias("line"))


@query(
    "r14_parse_netstat",
    """with k as (select 'addr.Id=10.0.0.'||(o_custkey%50)||':'||(o_orderkey%100) l, o_orderkey, o_custkey,
      case o_orderstatus when 'F' then 'ESTABLISHED' else 'TIME_WAIT' end st from orders where o_orderkey%3<>0 and o_orderstatus in ('F','P'))
    select l s, 'information' p, st o from k
    union select l, 'socket_end', 'addr.Id=fe80::1_2:'||(o_custkey%100) from k where o_orderkey%4<>0
    union select 'process.Handle='||o_custkey, 'has_socket', l from k where st='ESTABLISHED'
    union select 'machine.Name=localhost', 'host', l from k where st='TIME_WAIT'""",
)
def parse_netstat(spark, sf):
    return r.parse_netstat(netstat_lines(spark, sf)).select(*SPO)


@query(
    "r15_parse_module_deps",
    """select distinct 'n'||c_nationkey parent, u.d child from customer, lateral (values (c_mktsegment), ('c'||c_custkey)) u(d)""",
)
def parse_module_deps(spark, sf):
    cu = v.table(spark, sf, "customer")
    line = F.concat(
        F.lit("n"), text("c_nationkey"), F.lit(": "), "c_mktsegment", F.lit("  c"), text("c_custkey")
    )
    return r.parse_module_deps(cu.select(line.alias("line")))


@query(
    "r16_parse_library_deps",
    "select distinct 'file.Name=/bin/s'||s_suppkey s, 'library_depends' p, 'file.Name=/lib64/n'||s_nationkey||'.so.1' o from supplier",
)
def parse_library_deps(spark, sf):
    s = v.table(spark, sf, "supplier")
    line = F.concat(
        F.lit("\tn"), text("s_nationkey"), F.lit(".so.1 => /lib64/n"), text("s_nationkey"), F.lit(".so.1 (0x00007f)")
    )
    other = F.lit("\tlinux-vdso.so.1 (0x00007ffd)")
    rows = s.select(
        F.concat(F.lit("/bin/s"), text("s_suppkey")).alias("library"), F.explode(F.array(line, other)).alias("line")
    )
    return r.parse_library_deps(rows).select(*SPO)


@query(
    "r17_package_edges",
    """with k as (select p_type n, p_size sz, case when p_size > 25 then replace(p_brand,'#','-') end req from part)
    select distinct 'package.Id='||n s, 'rdf:type' p, 'package' o from k union select 'package.Id='||n, 'version', sz::varchar from k
    union select 'package.Id='||n, 'requires', 'package.Id='||req from k where req is not null
    union select 'package.Id='||n, 'condition', req||'>='||sz from k where req is not null""",
)
def package_edges(spark, sf):
    p = v.table(spark, sf, "part")
    rows = p.select(
        F.col("p_type").alias("package"), text("p_size").alias("version"),
        F.when(F.col("p_size") > 25, F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("requires"),
        F.concat(F.lit(">="), text("p_size")).alias("condition"),
    )
    return r.package_edges(rows).select(*SPO)


@query(
    "r18_parse_tns",
    """select 'S'||s_suppkey as name, 'db'||s_nationkey||'.example' host, (1500+s_suppkey)::varchar port from supplier""",
)
def parse_tns(spark, sf):
    s = v.table(spark, sf, "supplier")
    key = text("s_suppkey")
    entry = F.concat(
        F.lit("# service\nS"), key, F.lit(" =\n  (DESCRIPTION = (ADDRESS = (PROTOCOL = TCP)(HOST = db"), text("s_nationkey"),
        F.lit(".example)(PORT = "), text(F.col("s_suppkey") + 1500), F.lit("))\n   (CONNECT_DATA = (SID = X))\n  )\nNOPORT"), key,
        F.lit(" = (DESCRIPTION = (HOST = none))\n"),
    )
    return r.parse_tns(s.select(entry.alias("text")))


@query(
    "r19_account_triples",
    """select distinct 'passwd.Name=c'||c_custkey s, u.p, u.o from customer, lateral (values ('rdf:type', 'passwd'), ('uid', c_custkey::varchar),
    ('gid', c_nationkey::varchar), ('comment', c_mktsegment), ('home', '/home/c'||c_custkey), ('shell', '/bin/sh')) u(p, o)""",
)
def account_triples(spark, sf):
    cu = v.table(spark, sf, "customer")
    key = text("c_custkey")
    line = F.concat_ws(
        ":", F.concat(F.lit("c"), key), F.lit("x"), key, text("c_nationkey"), "c_mktsegment",
        F.concat(F.lit("/home/c"), key), F.lit("/bin/sh"),
    )
    return r.account_triples(cu.select(line.alias("line")), "passwd").select(*SPO)


@query(
    "r20_symlink_edges",
    """with p as (select '/srv' a, '/srv/n'||c_nationkey b, '/srv/n'||c_nationkey||'/c'||c_custkey c, c_nationkey n from customer)
    select distinct 'directory.Name='||a s, 'directory' p, 'directory.Name='||b o from p
    union select 'directory.Name='||b, 'directory', 'directory.Name='||c from p
    union select 'directory.Name=/disk'||n_nationkey, 'symlink', 'directory.Name=/srv/n'||n_nationkey from nation
      where n_nationkey in (select n from p)""",
)
def symlink_edges(spark, sf):
    cu, n = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    files = cu.select(
        F.concat(F.lit("/srv/n"), text("c_nationkey"), F.lit("/c"), text("c_custkey")).alias("path")
    )
    links = n.select(
        F.concat(F.lit("/srv/n"), text("n_nationkey")).alias("path"),
        F.concat(F.lit("/disk"), text("n_nationkey")).alias("target"),
    )
    return r.symlink_edges(files, links).select(*SPO)


@query(
    "r21_env_values",
    """select c_custkey pid, u.n as name, u.v as value, u.k kind from customer, lateral (values
     ('PATH', '/bin', 'directory'), ('PATH', '/opt/c'||c_custkey, 'directory'), ('CONF', '/etc/c'||c_custkey||'.conf', 'file'),
     ('HOME', '/home/c'||c_custkey, 'directory'), ('SHELL_TEXT', '_'||c_mktsegment||'_', 'text')) u(n, v, k)""",
)
def env_values(spark, sf):
    cu = v.table(spark, sf, "customer")
    key = text("c_custkey")

    def pair(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    rows = F.array(
        pair("PATH", F.concat(F.lit("/bin:/opt/c"), key)),
        pair("CONF", F.concat(F.lit("/etc/c"), key, F.lit(".conf"))),
        pair("HOME", F.concat(F.lit("/home/c"), key)),
        pair("SHELL_TEXT", F.concat(F.lit("<"), F.col("c_mktsegment"), F.lit(">"))),
    )
    return r.env_values(cu.select(F.col("c_custkey").alias("pid"), F.explode(rows).alias("x")).select("pid", "x.*"))


@query(
    "r22_catalog_objects",
    """with k as (select 'r'||n_regionkey sc, n_name t, case when n_nationkey%2=0 then 'table' else 'view' end kind, n_nationkey n from nation),
    c as (select sc, t, kind, n, u.c from k, lateral (values ('a'), ('b')) u(c))
    select distinct 'table.Schema='||sc||',Name='||t s, 'rdf:type' p, kind o from c
    union select 'table.Schema='||sc||',Name='||t, 'rows', n::varchar from c
    union select 'schema.Name='||sc, kind, 'table.Schema='||sc||',Name='||t from c
    union select 'table.Schema='||sc||',Name='||t, 'column', 'column.Schema='||sc||',Table='||t||',Name='||c from c""",
)
def catalog_objects(spark, sf):
    n = v.table(spark, sf, "nation")
    rows = n.select(
        F.concat(F.lit("r"), text("n_regionkey")).alias("schema"), F.col("n_name").alias("table"),
        F.when(F.col("n_nationkey") % 2 == 0, "table").otherwise("view").alias("kind"),
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("column"), F.col("n_nationkey").alias("rows"),
    )
    return r.catalog_objects(rows).select(*SPO)


@query(
    "r23_session_edges",
    """select 'session.Id='||c_custkey s, 'status' p, c_mktsegment o from customer
    union select 'session.Id='||c_custkey, 'client', 'host'||c_nationkey||'@process.Handle='||c_custkey from customer
    union select 'session.Id='||o_custkey, 'query', 'query.Query=q'||o_orderkey from orders where o_custkey in (select c_custkey from customer)""",
)
def session_edges(spark, sf):
    cu, o = v.table(spark, sf, "customer"), v.table(spark, sf, "orders")
    sessions = cu.select(
        F.col("c_custkey").alias("session_id"), F.concat(F.lit("HOST"), text("c_nationkey")).alias("client_host"),
        F.col("c_custkey").alias("client_pid"), F.col("c_mktsegment").alias("status"),
    )
    requests = o.select(
        F.col("o_custkey").alias("session_id"), F.concat(F.lit("q"), text("o_orderkey")).alias("query")
    )
    return r.session_edges(sessions, requests).select(*SPO)


@query(
    "r24_parse_arp",
    """select 'addr.Id=10.0.0.'||s_suppkey s, 'interface' p, 'eth'||(s_nationkey%3) o from supplier
    union all select 'addr.Id=10.0.0.'||s_suppkey, 'mac', '54:be:'||s_nationkey from supplier where s_suppkey%2=0""",
)
def parse_arp(spark, sf):
    s = v.table(spark, sf, "supplier")
    hardware = F.when(
        F.col("s_suppkey") % 2 == 0, F.concat(F.lit("54:be:"), text("s_nationkey"), F.lit(" [ether]"))
    ).otherwise("<incomplete>")
    line = F.concat(
        F.lit("? (10.0.0."), text("s_suppkey"), F.lit(") at "), hardware, F.lit(" on eth"), text(F.col("s_nationkey") % 3)
    )
    return r.parse_arp(s.select(line.alias("line"))).select(*SPO)


@query(
    "r25_disk_usage",
    """select 'partition.Name=d'||s_suppkey s, u.p, u.o from supplier,
    lateral (values ('rdf:type', 'partition'), ('used', s_nationkey::varchar), ('free', s_suppkey::varchar)) u(p, o)""",
)
def disk_usage(spark, sf):
    s = v.table(spark, sf, "supplier")
    rows = s.select(
        F.concat(F.lit("d"), text("s_suppkey")).alias("partition"), F.col("s_nationkey").alias("used"),
        F.col("s_suppkey").alias("free"),
    )
    return r.disk_usage(rows).select(*SPO)


# Identity, paths and values


@query(
    "c1_parse_nodes",
    """select c_custkey, u.h host, u.c cls, u.k as "key" from customer, lateral (values
      (0, 'srv'||c_nationkey, 'app/customer', c_name), (1, 'srv'||c_nationkey, 'root\\cimv2:Customer', c_name),
      (2, 'http://srv'||c_nationkey||':5988', 'root/cimv2:Customer', c_name), (3, '', '', null)) u(n, h, c, k) where c_custkey%4=u.n""",
)
def parse_nodes(spark, sf):
    cu = v.table(spark, sf, "customer")
    host = F.concat(F.lit("srv"), text("c_nationkey"))
    kind = F.col("c_custkey") % 4
    encoded = F.replace("c_name", F.lit("#"), F.lit("%23"))
    node = (
        F.when(kind == 0, F.concat(host, F.lit("@app/customer.Name="), encoded))
        .when(kind == 1, F.concat(F.lit("\\\\"), host, F.lit("\\root\\cimv2:Customer.Name=\""), "c_name", F.lit('"')))
        .when(kind == 2, F.concat(F.lit("http://"), host, F.lit(":5988/root/cimv2:Customer.Name=\""), encoded, F.lit('"')))
        .otherwise(F.lit("?nothing"))
    )
    return ident.parse_nodes(cu.select("c_custkey", node.alias("node"))).select(
        "c_custkey", "host", "cls", F.col("keys")["Name"].alias("key")
    )


@query(
    "c2_split_moniker",
    "select c_custkey, c_name a, 'x, '||c_mktsegment b, c_mktsegment c from customer",
)
def split_moniker(spark, sf):
    cu = v.table(spark, sf, "customer")
    packed = F.regexp_replace(F.translate(F.base64(F.encode("c_name", "UTF-8")), "+/", "-_"), "=", "")
    moniker = F.concat(
        F.lit("A=B64_"), packed, F.lit(',B="x, '), "c_mktsegment", F.lit('",C='), "c_mktsegment"
    )
    keys = ident.split_moniker(moniker)
    return cu.select("c_custkey", keys.alias("k")).select(
        "c_custkey", F.col("k")["A"].alias("a"), F.col("k")["B"].alias("b"), F.col("k")["C"].alias("c")
    )


@query(
    "c3_make_nodes",
    """select 'customer.Id='||c_custkey||',Name=B64_'||rtrim(replace(replace(base64(encode(c_name)), '+', '-'), '/', '_'), '=')||',Segment='||c_mktsegment node from customer""",
)
def make_nodes(spark, sf):
    cu = v.table(spark, sf, "customer")
    keys = {"Id": "c_custkey", "Name": "c_name", "Segment": "c_mktsegment"}
    return ident.make_nodes(cu, "customer", keys).select("node")


@query(
    "c4_universal_alias",
    """select c_custkey, 'customer.Id='||c_custkey||'@srv'||c_nationkey as alias from customer""",
)
def universal_alias(spark, sf):
    cu = v.table(spark, sf, "customer")
    node = F.when(
        F.col("c_custkey") % 2 == 0,
        F.concat(F.lit("http://SRV"), text("c_nationkey"), F.lit(":8000/entity?xid=customer.Id="), text("c_custkey")),
    ).otherwise(F.concat(F.lit("Srv"), text("c_nationkey"), F.lit("@customer.Id="), text("c_custkey")))
    return ident.universal_alias(cu.select("c_custkey", node.alias("node"))).select("c_custkey", "alias")


@query(
    "c5_property_names",
    """select p_partkey, 'urn:sysweave#'||replace(p_name,' ','_')||'___'||replace(p_type,' ','_')||'?size='||p_size||'&key='||p_partkey uri,
    replace(p_name,' ','_')||'___'||replace(p_type,' ','_') as name, p_size::varchar as "size", p_partkey::varchar as "key" from part""",
)
def property_names(spark, sf):
    p = v.table(spark, sf, "part")
    uri = ident.property_uri([F.col("p_name"), F.col("p_type")], {"size": text("p_size"), "key": text("p_partkey")})
    return p.select("p_partkey", uri.alias("uri")).select(
        "p_partkey",
        "uri",
        ident.property_name(F.col("uri")).alias("name"),
        ident.property_args(F.col("uri"))["size"].alias("size"),
        ident.property_args(F.col("uri"))["key"].alias("key"),
    )


@query(
    "c6_clean_uris",
    """select 'part/'||replace(p_name,' ','%20')||'%5B'||p_size||'%5D' s, '%7B'||p_partkey||'%7D%5C' o from part""",
)
def clean_uris(spark, sf):
    p = v.table(spark, sf, "part")
    facts = triples(
        p,
        F.concat(F.lit("part/"), "p_name", F.lit("["), text("p_size"), F.lit("]")),
        "odd",
        F.concat(F.lit("{"), text("p_partkey"), F.lit("}\\")),
    )
    return ident.clean_uris(facts).select("s", "o")


@query(
    "c7_normalise_paths",
    """select p_partkey, case p_size%4 when 0 then '/srv/'||p_type||'/f'||p_partkey when 1 then '/work/f'||p_partkey
    when 2 then 'pipe:['||p_partkey||']' else 'stdin' end path from part""",
)
def normalise_paths(spark, sf):
    p = v.table(spark, sf, "part")
    key, kind = text("p_partkey"), F.col("p_size") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("/srv//x/../"), "p_type", F.lit("/./f"), key))
        .when(kind == 1, F.concat(F.lit("..\\f"), key))
        .when(kind == 2, F.concat(F.lit("pipe:["), key, F.lit("]")))
        .otherwise("stdin")
    )
    return p.select("p_partkey", paths.normalise_path(raw, F.lit("/work/dir")).alias("path"))


PATHS = """('/usr/lib64/libc-'||k||'.so.1', 'Shared libraries', true), ('/etc/conf'||k, 'System config files', false),
   ('/usr/share/doc/'||k, 'Other libraries', false), ('/usr/bin/p'||k, 'System executables', false), ('/proc/'||k, 'Kernel file systems', false),
   ('/tmp/'||k, 'Temporary files', false), ('pipe:['||k||']', 'Pipes and terminals', false),
   ('TCP:[1.1.1.1:1->2.2.2.2:'||k||']', 'Connected TCP sockets', false), ('UDP:['||k||']', 'Other TCP/IP sockets', false),
   ('/home/u/'||k||'.so', 'Others', true)"""


def sample_paths(spark, sf):
    p = v.table(spark, sf, "part")
    k = text("p_partkey")
    shapes_ = [
        ("/usr/lib64/libc-", ".so.1"), ("/etc/conf", ""), ("/usr/share/doc/", ""), ("/usr/bin/p", ""), ("/proc/", ""),
        ("/tmp/", ""), ("pipe:[", "]"), ("TCP:[1.1.1.1:1->2.2.2.2:", "]"), ("UDP:[", "]"), ("/home/u/", ".so"),
    ]
    return p.select(F.explode(F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in shapes_])).alias("path"))


@query(
    "c8_path_category",
    f"select u.x path, u.c category from (select p_partkey k from part) q, lateral (values {PATHS}) u(x, c, n)",
)
def path_category(spark, sf):
    return sample_paths(spark, sf).withColumn("category", paths.path_category(F.col("path")))


@query(
    "c9_is_noise_path",
    f"""select u.x path, u.x like '%.so' noise, u.x like '%.so' noise_map from (select p_partkey k from part) q, lateral (values {PATHS}) u(x, c, n)""",
)
def noise_paths(spark, sf):
    col = F.col("path")
    return sample_paths(spark, sf).select(
        "path", paths.is_noise_path(col).alias("noise"), paths.is_noise_map(col).alias("noise_map")
    )


@query(
    "c11_endpoint",
    """select o_orderkey, '10.0.0.'||(o_custkey%50) destination, (o_orderkey%100)::varchar port, 'fe80::1_'||(o_custkey%9) host, (o_custkey%100)::varchar host_port
    from orders""",
)
def endpoints(spark, sf):
    o = v.table(spark, sf, "orders")
    sock = F.concat(
        F.lit("TCPv6:[10.1.1.1:80->10.0.0."), text(F.col("o_custkey") % 50), F.lit(":"), text(F.col("o_orderkey") % 100), F.lit("]")
    )
    addr = F.concat(F.lit("[fe80::1%"), text(F.col("o_custkey") % 9), F.lit("]:"), text(F.col("o_custkey") % 100))
    return o.select(
        "o_orderkey",
        paths.destination(sock).alias("destination"),
        paths.port(sock).alias("port"),
        paths.endpoint_host(addr).alias("host"),
        paths.endpoint_port(addr).alias("host_port"),
    )


@query(
    "c12_open_mode",
    """select p_partkey, case p_size%6 when 0 then 'R' when 1 then 'W' when 2 then 'R' when 3 then 'W' when 4 then null else 'R' end as mode from part""",
)
def open_modes(spark, sf):
    p = v.table(spark, sf, "part")
    kind = F.col("p_size") % 6
    flag = (
        F.when(kind == 0, "O_RDONLY|O_CLOEXEC").when(kind == 1, "O_RDWR|O_CREAT").when(kind == 2, "0x80000")
        .when(kind == 3, "0x241").when(kind == 4, "0x9999")
    )
    return p.select("p_partkey", paths.open_mode(flag).alias("mode"))


@query(
    "c13_decode_octal",
    """select p_partkey, 'A'||p_name||chr(10)||chr(9)||'"zé\\q'||chr(8364) as text from part""",
)
def decode_octal(spark, sf):
    p = v.table(spark, sf, "part")
    raw = F.concat(F.lit("\\101"), "p_name", F.lit('\\n\\t\\"\\x7a\\303\\251\\q\\xe2\\x82\\xac'))
    return p.select("p_partkey", values.decode_octal(raw).alias("text"))


@query(
    "c15_dsn_parts",
    """select s_suppkey, 'db'||s_suppkey as server, 'Driver={SQL Server};Server=db'||s_suppkey||';UID=u;Pwd=xxx' masked, 'db'||s_suppkey as short from supplier""",
)
def dsn_parts(spark, sf):
    s = v.table(spark, sf, "supplier")
    dsn = F.concat(F.lit("Driver={SQL Server};Server=db"), text("s_suppkey"), F.lit(";UID=u;Pwd=p"), text("s_suppkey"))
    return s.select("s_suppkey", dsn.alias("dsn")).select(
        "s_suppkey",
        values.dsn_parts(F.col("dsn"))["SERVER"].alias("server"),
        values.mask_dsn(F.col("dsn")).alias("masked"),
        values.short_dsn(F.col("dsn")).alias("short"),
    )


@query(
    "c16_script_files_only",
    "select '/src/p'||p_partkey||case p_size%3 when 0 then '.PY' else '.pcc' end path from part where p_size%3<2",
)
def script_files(spark, sf):
    p = v.table(spark, sf, "part")
    ext = F.when(F.col("p_size") % 3 == 0, ".PY").when(F.col("p_size") % 3 == 1, ".pcc").otherwise(".txt")
    return values.script_files_only(p.select(F.concat(F.lit("/src/p"), text("p_partkey"), ext).alias("path")))


# Sources and shapes


@query(
    "s6_ntriples_round_trip",
    f"select s, p, o, o_kind, o_type from ({v.PART_SQL})",
)
def ntriples_round_trip(spark, sf):
    back = rdf.parse_ntriples(rdf.ntriples_text(v.part_facts(spark, sf, layout="rows")))
    return back.select("s", "p", "o", "o_kind", "o_type")


@query(
    "s7_triples_from_json",
    """select 'customer.Id='||c_custkey||',Segment='||c_mktsegment s, 'urn:sysweave#lives_in' p, 'nation.Id='||c_nationkey o, 'uri' o_kind from customer""",
)
def triples_from_json(spark, sf):
    cu = v.table(spark, sf, "customer")

    def obj(cls, **keys):
        pairs = [x for k, c in keys.items() for x in (F.lit(k), text(c))]
        return F.struct(F.lit(cls).alias("cls"), F.create_map(*pairs).alias("keys"))

    doc = F.to_json(
        F.struct(
            obj("customer", Segment="c_mktsegment", Id="c_custkey", Extra="c_name").alias("subject"),
            F.lit("lives-in").alias("predicate"),
            obj("nation", Id="c_nationkey").alias("object_node"),
        )
    )
    ontology = {"customer": ["Id", "Segment"], "nation": ["Id"]}
    return rdf.triples_from_json(cu.select(doc.alias("json")), ontology).select("s", "p", "o", "o_kind")


def monitor_lines(spark, sf, header, line):
    """A header in front of each user's lines."""
    e = v.events(spark, sf)
    base = e.select(
        F.concat(F.lit("m"), text("user_id")).alias("object"), "ts", F.col("event_id").alias("seq"), line.alias("line")
    )
    heads = e.groupBy("user_id").agg(F.min("ts").alias("ts")).select(
        F.concat(F.lit("m"), text("user_id")).alias("object"), "ts", F.lit(-1).cast("long").alias("seq"),
        F.lit(header).alias("line"),
    )
    return heads.unionByName(base)


@query(
    "s8_parse_vmstat",
    """with e as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)
    select 'm'||user_id as object, event_id, u.m metric, u.v as value from e,
    lateral (values ('vmstat.r', event_id::double), ('vmstat.b', k::double), ('vmstat.swpd', 7::double)) u(m, v) where k%5<>0""",
)
def parse_vmstat(spark, sf):
    line = F.concat(
        F.lit(" "), text("event_id"), F.lit("  "), text("k"), F.when(F.col("k") % 5 == 0, "").otherwise(" 7")
    )
    lines = monitor_lines(spark, sf, " r  b   swpd", line)
    out = samples.parse_vmstat(lines.withColumn("ts", F.col("seq")))
    return out.select("object", F.col("ts").alias("event_id"), "metric", "value")


@query(
    "s9_parse_iostat",
    """with e as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)
    select 'sd'||(k%4) as object, event_id, u.m metric, u.v as value from e,
    lateral (values ('iostat.tps', k + 0.5::double), ('iostat.kB_read/s', event_id::double)) u(m, v)""",
)
def parse_iostat(spark, sf):
    line = F.concat(
        F.lit("sd"), text(F.col("k") % 4), F.lit("    "), text("k"), F.lit(",50   "), text("event_id"), F.lit(",00")
    )
    lines = monitor_lines(spark, sf, "Device:  tps   kB_read/s", line)
    out = samples.parse_iostat(lines.withColumn("ts", F.col("seq")))
    return out.select("object", F.col("ts").alias("event_id"), "metric", "value")


@query(
    "s10_parse_tcpdump",
    """select 'addr.Id=host'||user_id||'.home:'||k s, 'socket_end' p, 'addr.Id=10.0.0.1:'||event_id o
    from (select *, regexp_extract(props, '([0-9]+)', 1) k from events) where event_type<>'error'""",
)
def parse_tcpdump(spark, sf):
    e = v.events(spark, sf)
    port = F.when(F.col("event_type") == "error", "domain").otherwise(text("k"))
    line = F.concat(
        F.lit("22:39:56.713245 IP host"), text("user_id"), F.lit(".home."), port, F.lit(" > 10.0.0.1."),
        text("event_id"), F.lit(": 52407* 1/0/0 (87)"),
    )
    return samples.parse_tcpdump(e.select(line.alias("line"))).select(*SPO)


@query(
    "s11_samples_from_counters",
    """select c_custkey as object, u.m metric, u.v as value from customer,
    lateral (values ('acct.c_acctbal', c_acctbal), ('acct.c_nationkey', c_nationkey::double)) u(m, v)""",
)
def samples_from_counters(spark, sf):
    cu = v.table(spark, sf, "customer").withColumn("ts", F.lit(0))
    out = samples.samples_from_counters(cu, "acct", ["c_acctbal", "c_nationkey"], obj="c_custkey")
    return out.select("object", "metric", "value")


@query(
    "s12_catalog_edges",
    """select 'table.Schema=r'||n_regionkey||',Name='||n_name s, 'constraint.fk'||n_nationkey p, 'table.Schema=base,Name=t'||n_regionkey o from nation""",
)
def catalog_edges(spark, sf):
    n = v.table(spark, sf, "nation")
    rows = n.select(
        F.concat(F.lit("r"), text("n_regionkey")).alias("schema"), F.col("n_name").alias("table"),
        F.lit("base").alias("referenced_schema"), F.concat(F.lit("t"), text("n_regionkey")).alias("referenced_table"),
        F.concat(F.lit("fk"), text("n_nationkey")).alias("constraint"),
    )
    return tables.catalog_edges(rows).select(*SPO)


@query(
    "s13_captured_sql",
    """select c_custkey, case when c_nationkey%2=0 then repeat('x', 1000)||c_nationkey else 'select '||c_nationkey end query
    from customer""",
)
def captured_sql(spark, sf):
    cu, n = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    key = text("n_nationkey")
    full = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.expr("repeat('x', 1000)"), key)).otherwise(
        F.concat(F.lit("select "), key)
    )
    # Every other statement is short, and has no long text.
    long = F.when(F.col("n_nationkey") % 2 == 0, full)
    statements = n.select(
        F.col("n_nationkey").alias("sql_id"), F.substring(full, 1, 1000).alias("sql_text"), long.alias("sql_fulltext")
    )
    sessions = cu.select("c_custkey", F.col("c_nationkey").alias("sql_id"))
    return tables.captured_sql(sessions, statements).select("c_custkey", "query")


@query(
    "k2_ntriples_text",
    """select '<nation.key='||n_nationkey||'> <n_name> "'||n_name||'" .' as value from nation union all
    select '<nation.key='||n_nationkey||'> <rdf:type> <nation> .' from nation union all
    select '<nation.key='||n_nationkey||'> <in_region> <region.key='||n_regionkey||'> .' from nation""",
)
def ntriples(spark, sf):
    return rdf.ntriples_text(v.nation_facts(spark, sf))


@query(
    "k2_rdf_xml_text",
    """select '<rdf:Description rdf:about="nation.key='||n_nationkey||'"><n_name>'||n_name||'</n_name></rdf:Description>' as value from nation union all
    select '<rdf:Description rdf:about="nation.key='||n_nationkey||'"><rdf:type rdf:resource="nation"/></rdf:Description>' from nation union all
    select '<rdf:Description rdf:about="nation.key='||n_nationkey||'"><in_region rdf:resource="region.key='||n_regionkey||'"/></rdf:Description>' from nation""",
)
def rdf_xml(spark, sf):
    return rdf.rdf_xml_text(v.nation_facts(spark, sf))


@query(
    "s6_rdf_xml_round_trip",
    """select '_:c'||c_custkey s, 'c_name' p, c_name||' & <co>' o, 'lit' o_kind, 'string' o_type from customer
    union all select '_:c'||c_custkey, 'nation', 'nation.key='||c_nationkey, 'uri', null from customer
    union all select '_:c'||c_custkey, 'next', '_:c'||(c_custkey+1), 'bnode', null from customer
    union all select '_:c'||c_custkey, 'number', c_custkey::varchar, 'lit', 'integer' from customer""",
)
def rdf_xml_round_trip(spark, sf):
    cu = v.table(spark, sf, "customer")
    me = F.concat(F.lit("_:c"), text("c_custkey"))
    facts = union_all(
        [
            triples(cu, me, "c_name", F.concat("c_name", F.lit(" & <co>"))),
            triples(cu, me, "nation", ident.node_of_integer("nation", "key", "c_nationkey"), kind="uri"),
            triples(cu, me, "next", F.concat(F.lit("_:c"), text(F.col("c_custkey") + 1)), kind="bnode"),
            triples(cu, me, "number", text("c_custkey"), o_type="integer"),
        ]
    )
    path = fresh_folder(spark, "rdf")
    predicates = ["c_name", "nation", "next", "number"]
    rdf.write_rdf_xml(facts, path, predicates)
    back = rdf.read_rdf_xml(spark, path, predicates)
    return back.select("s", "p", "o", "o_kind", "o_type")


@query(
    "s6_ntriples_terms",
    r"""select 'urn:'||p_partkey s, 'urn:p' p, p_name||'é"'||chr(10)||chr(92)||'u' o, 'lit' o_kind,
      case when p_size%2=0 then '@de-AT' else 'string' end o_type from part""",
)
def ntriples_terms(spark, sf):
    """Escapes of any kind, and languages."""
    p = v.table(spark, sf, "part")
    tag = F.when(F.col("p_size") % 2 == 0, "@de-AT").otherwise("")
    line = F.concat(
        F.lit("<urn:"), text("p_partkey"), F.lit('> <urn:p> "'), "p_name", F.lit('\\u00e9\\"\\n\\\\u"'), tag, F.lit(" .")
    )
    back = rdf.parse_ntriples(rdf.ntriples_text(rdf.parse_ntriples(p.select(line.alias("value")))))
    return back.select("s", "p", "o", "o_kind", "o_type")


@query(
    "u5_class_texts",
    """select 'nation.key='||n_nationkey node, 'nation' cls, 'Nation no. '||n_nationkey as label, 'N'||n_nationkey as alias, 'a nation' as information from nation
    union all select 'region.key='||r_regionkey, 'region', 'Region '||r_regionkey, 'R'||r_regionkey, 'key '||r_regionkey from region""",
)
def class_texts(spark, sf):
    classes = spark.createDataFrame(
        [
            ("nation", ["key"], "Nation no. {key}", "N{key}", "a nation"),
            ("region", ["key"], "Region {key}", "R{key}", "key {key}"),
            ("customer", ["key", "Host"], "{Host}", "{key}", ""),
        ],
        "cls string, keys array<string>, label string, alias string, information string",
    )
    return shapes.described(v.geography(spark, sf), classes)


@query(
    "k3_bindings_json",
    """select '{"nation":{"type":"url","value":"nation.key='||n_nationkey||'"},"name":{"type":"literal","value":"'||n_name||'"}}' as binding from nation""",
)
def bindings_json(spark, sf):
    found = m.match(
        v.nation_facts(spark, sf), [("?nation", "n_name", "?name")], ["nation", "name"], kinds=True
    )
    return shapes.bindings_json(found, ["nation", "name"])


@query(
    "k4_nodes",
    """select 'customer.key='||c_custkey id, u.k kind, u.n as name, u.v as value from customer, lateral (values ('node', 'customer', 'key='||c_custkey),
      ('property', 'c_name', c_name), ('property', 'c_mktsegment', c_mktsegment)) u(k, n, v)
    union all select 'nation.key='||n, 'node', 'nation', 'key='||n from (select distinct c_nationkey n from customer)
    union all select 'customer', 'node', '', ''""",
)
def nodes(spark, sf):
    return shapes.nodes_and_links(v.customer_facts(spark, sf, layout="rows"))[0]


@query(
    "k4_links",
    """select 'customer.key='||c_custkey as source, 'nation.key='||c_nationkey target, 'in_nation' property from customer
    union all select 'customer.key='||c_custkey, 'customer', 'rdf:type' from customer""",
)
def links(spark, sf):
    return shapes.nodes_and_links(v.customer_facts(spark, sf, layout="rows"))[1]


@query(
    "k5_menu_tree_two_parents",
    """with up as (select n_nationkey n, n_regionkey r from nation union select n_nationkey, (n_regionkey+1)%5 from nation),
    rs as (select distinct r from up)
    select 'region.key='||r root, 'region.key='||r path, 'region.key='||r node, 'region.key='||r as name, 0 as depth from rs
    union all select 'region.key='||r, 'region.key='||r||'/nation.key='||n, 'nation.key='||n, 'nation.key='||n, 1 from up
    union all select 'region.key='||r, 'region.key='||r||'/nation.key='||n||'/customer.key='||c_custkey, 'customer.key='||c_custkey, 'customer.key='||c_custkey, 2
      from customer join up on c_nationkey=n""",
)
def menu_tree_two_parents(spark, sf):
    """Each nation lies in two regions and has a path from either."""
    n, c = v.table(spark, sf, "nation"), v.table(spark, sf, "customer")
    nation = ident.node_of_integer("nation", "key", "n_nationkey")
    regions = F.explode(F.array(F.col("n_regionkey"), (F.col("n_regionkey") + 1) % 5)).alias("r")
    ups = n.select(nation.alias("child"), regions).select(
        ident.node_of_integer("region", "key", "r").alias("parent"), "child"
    )
    downs = c.select(
        ident.node_of_integer("nation", "key", "c_nationkey").alias("parent"),
        ident.node_of_integer("customer", "key", "c_custkey").alias("child"),
    )
    return shapes.menu_tree(triples(ups.unionByName(downs), "parent", SCRIPT, "child", kind="uri"))


@query(
    "k5_menu_tree",
    """with r as (select distinct n_regionkey k from nation)
    select 'region.key='||k root, 'Region '||k path, 'region.key='||k node, 'Region '||k as name, 0 as depth from r
    union all select 'region.key='||n_regionkey, 'Region '||n_regionkey||'/nation.key='||n_nationkey, 'nation.key='||n_nationkey, 'nation.key='||n_nationkey, 1 from nation
    union all select 'region.key='||n_regionkey, 'Region '||n_regionkey||'/nation.key='||n_nationkey||'/customer.key='||c_custkey, 'customer.key='||c_custkey, 'customer.key='||c_custkey, 2
      from customer join nation on c_nationkey=n_nationkey
    union all select 'region.key='||n_regionkey, 'Region '||n_regionkey||'/nation.key='||n_nationkey||'/customer.key='||c_custkey||'/order.key='||o_orderkey, 'order.key='||o_orderkey, 'order.key='||o_orderkey, 3
      from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey""",
)
def menu_tree(spark, sf):
    edges = v.tree_edges(spark, sf)
    regions = v.table(spark, sf, "region")
    facts = union_all(
        [
            triples(edges, "parent", SCRIPT, "child", kind="uri"),
            triples(
                regions, ident.node_of_integer("region", "key", "r_regionkey"), INFORMATION,
                F.concat(F.lit("Region "), text("r_regionkey")),
            ),
        ]
    )
    return shapes.menu_tree(facts)


@query(
    "k6_objects_by_class",
    f"select distinct split_part(s, '.', 1) cls, s, p, o from ({v.GEOGRAPHY_SQL}) where p<>'rdf:type'",
)
def objects_by_class(spark, sf):
    return shapes.objects_by_class(v.geography(spark, sf, layout="rows"))


@query(
    "k7_collapse_property",
    """select 'nation.key='||c_nationkey subject, 'customer.key='||c_custkey object, c_name, c_mktsegment from customer""",
)
def collapse_property(spark, sf):
    facts = v.customer_facts(spark, sf, layout="rows")
    cu = v.table(spark, sf, "customer")
    down = triples(
        cu, ident.node_of_integer("nation", "key", "c_nationkey"), "has",
        ident.node_of_integer("customer", "key", "c_custkey"), kind="uri",
    )
    return shapes.collapse_property(
        facts.unionByName(down), "has", ["c_mktsegment", "c_name"], priority=["c_name"]
    )


# Event store and roll-ups as tables; the streams are compared with these in the tests.


def event_store(spark, sf):
    """Each event is a triple in the context of its type; batches of a thousand numbers."""
    e = v.events(spark, sf)
    facts = triples(
        e, F.concat(F.lit("u"), text("user_id")), "did", text("k"), ctx=F.col("event_type")
    )
    numbered = e.select(
        F.concat(F.lit("u"), text("user_id")).alias("s"), F.lit("did").alias("p"), text("k").alias("o"),
        F.lit("lit").alias("o_kind"), F.lit("string").alias("o_type"), F.col("event_type").alias("ctx"),
        F.floor(F.col("event_id") / 1000).alias("batch"),
    )
    return numbered.select(*facts.columns, "batch")


STORE = """st as (select 'u'||user_id s, regexp_extract(props, '([0-9]+)', 1) o, event_type ctx, event_id//1000 batch from events)"""


@query(
    "e5_clear_events",
    f"with {STORE} select distinct s, 'did' p, o, ctx from st where ctx <> 'click'",
)
def clear_events(spark, sf):
    """Clicks are stored and cleared; what comes after that is all there is."""
    facts = event_store(spark, sf).drop("batch")
    store = fresh_folder(spark, "store")
    ev.append_batch(facts.where("ctx = 'click'"), store, 0)
    ev.clear_events(spark, store)
    ev.append_batch(facts.where("ctx <> 'click'"), store, 1)
    return ev.stored(spark, store).select(*SPO, "ctx")


@query("e2_drain", f"with {STORE} select distinct s, 'did' p, o from st where ctx='click' and batch > 2")
def drain(spark, sf):
    return ev.drain(event_store(spark, sf), seen=2, ctx="click").select(*SPO)


@query("e3_drain_all", f"with {STORE} select distinct s, 'did' p, o from st where batch > 5")
def drain_all(spark, sf):
    return ev.drain(event_store(spark, sf), seen=5, every=True).select(*SPO)


@query("e3_drain_entity", f"with {STORE} select distinct s, 'did' p, o from st where s='u3'")
def drain_entity(spark, sf):
    return ev.drain(event_store(spark, sf), entity="u3").select(*SPO)


@query(
    "e4_event_counts",
    f"""with {STORE} select ctx, count(*) events, false as total from (select distinct s, o, ctx from st) group by ctx
    union all select null, count(*), true from (select distinct s, o from st)""",
)
def event_counts(spark, sf):
    return ev.event_counts(event_store(spark, sf))


def value_samples(spark, sf):
    e = v.events(spark, sf)
    cents = e.withColumns({"cents": F.round(F.col("value") * 100), "ts": v.instant()})
    return st.sample_stream(cents, "user", ["cents"], obj="user_id")


@query(
    "e6_sample_stream",
    "select user_id as object, 'user.cents' metric, round(value*100) as value from events",
)
def sample_rows(spark, sf):
    return value_samples(spark, sf).select("object", "metric", "value")


@query(
    "e7_sample_rollup",
    """select user_id as object, 'user.cents' metric, epoch_us(time_bucket(interval 6 hours, ts)) start_us, count(*) n,
    sum(round(value*100)) / count(*) average, min(round(value*100)) least, max(round(value*100)) greatest from events group by 1, 2, 3""",
)
def sample_rollup(spark, sf):
    out = st.sample_rollup(value_samples(spark, sf), "6 hours")
    return out.select("object", "metric", F.unix_micros("start").alias("start_us"), "n", "average", "least", "greatest")


@query(
    "e7_sliding_rollup",
    """with w as (select user_id, round(value*100) v, time_bucket(interval 3 hours, ts) - interval (3*s) hours b from events, (values (0), (1)) x(s))
    select user_id as object, 'user.cents' metric, epoch_us(b) start_us, count(*) n, min(v) least, max(v) greatest from w group by 1, 2, 3""",
)
def sliding_rollup(spark, sf):
    out = st.sample_rollup(value_samples(spark, sf), "6 hours", "3 hours")
    return out.select("object", "metric", F.unix_micros("start").alias("start_us"), "n", "least", "greatest")


@query(
    "e7_activity_bursts",
    """with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 4 hours then 0 else 1 end st from events),
    b as (select *, sum(st) over (partition by user_id order by ts rows unbounded preceding) g from a)
    select user_id as object, epoch_us(min(ts)) start_us, epoch_us(max(ts) + interval 4 hours) end_us, count(*) n from b group by user_id, g""",
)
def activity_bursts(spark, sf):
    out = st.activity_bursts(value_samples(spark, sf), "4 hours")
    return out.select("object", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def homes(spark, sf):
    """Users live in a nation, nations have names."""
    users = v.events(spark, sf).select("user_id").distinct()
    return triples(
        users, F.concat(F.lit("u"), text("user_id")), "home",
        ident.node_of_integer("nation", "key", F.col("user_id") % 25), kind="uri",
    ).unionByName(v.nation_facts(spark, sf))


@query(
    "e9_standing_match",
    """select 'u'||user_id u, k, 'nation.key='||n_nationkey nation from (select *, regexp_extract(props, '([0-9]+)', 1) k from events)
    join nation on n_nationkey = user_id%25""",
)
def standing_match(spark, sf):
    from sysweave.streaming.trace import standing_match as standing

    live = triples(v.events(spark, sf), F.concat(F.lit("u"), text("user_id")), "did", text("k"))
    return standing(live, homes(spark, sf), ("?u", "did", "?k"), [("?u", "home", "?nation"), ("?nation", "n_name", "?name")]).select(
        "u", "k", "nation"
    )


@query(
    "r15_modules_below",
    """with recursive e as (select 'm'||c_custkey parent, 'm'||(c_custkey//10) child from customer where c_custkey <> c_custkey//10),
    c as (select child node, 1 as depth from e where parent='m1234' union all select e.child, c.depth+1 from c join e on e.parent=c.node)
    select node, min(depth) depth from c group by node""",
)
def modules_below(spark, sf):
    cu = v.table(spark, sf, "customer")
    line = F.concat(F.lit("m"), text("c_custkey"), F.lit(": m"), text(F.floor(F.col("c_custkey") / 10)))
    edges = r.parse_module_deps(cu.select(line.alias("line")))
    start = cu.where("c_custkey = 1234").select(F.lit("m1234").alias("start"))
    below = t.reach(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")), start)
    return below.where("depth > 0").select("node", "depth")
