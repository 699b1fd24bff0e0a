"""Relations between processes, sockets, files, packages and database objects.

Inputs are ordinary tables, or the text lines of a listing; outputs are triples
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.functions.identity import node_of_integer, node_text
from sysweave.functions.paths import (
    endpoint_host,
    endpoint_port,
    is_noise_map,
    is_noise_path,
)
from sysweave.model import INFORMATION, TYPE, as_set, triples, union_all
from sysweave.operators.graphset import path_ancestors
from sysweave.sources.samples import endpoint_node
from sysweave.sources.tables import tables_to_triples


def process_node(col="pid") -> Column:
    return node_of_integer("process", "Handle", col)


def file_node(col="path") -> Column:
    return node_text("file", {"Name": col})


def directory_node(col) -> Column:
    return node_text("directory", {"Name": col})


def process_edges(procs: DataFrame) -> DataFrame:
    """(pid, ppid, user, command) rows to pid, parent, user and command triples."""
    return tables_to_triples(
        procs,
        "process",
        {"Handle": "pid"},
        properties={"pid": "pid", "command": "command"},
        links={"ppid": ("process", {"Handle": "ppid"}), "user": ("user", {"Name": "user"})},
    )


def socket_edges(conns: DataFrame, only_established: bool = False) -> DataFrame:
    """(pid, family, type, laddr, lport, raddr, rport, status) rows of stream sockets."""
    kept = conns.where("family = 'INET' and type = 'STREAM'")
    if only_established:
        kept = kept.where("status = 'ESTABLISHED'")
    local = endpoint_node("laddr", "lport")
    far = kept.where("raddr is not null and rport is not null")
    return as_set(
        union_all(
            [
                triples(kept, process_node(), "has_socket", local, kind="uri"),
                triples(
                    far, local, "socket_end", endpoint_node("raddr", "rport"), kind="uri"
                ),
                triples(kept, local, INFORMATION, "status"),
            ]
        )
    )


def socket_users(conns: DataFrame, targets: DataFrame) -> DataFrame:
    """Processes using an endpoint on either side.

    ``targets`` has (host, addr, port). Name, address and, for a loopback target,
    the wildcards are written out, so that address and port are the join key and
    a port everybody uses is not hot by itself.
    """
    sides = F.array(
        F.struct(F.col("laddr").alias("a"), F.col("lport").alias("port")),
        F.struct(F.col("raddr").alias("a"), F.col("rport").alias("port")),
    )
    both = conns.where(
        "laddr is not null and lport is not null and raddr is not null and rport is not null"
    )
    # A process may hold many sockets to one endpoint; one row per process is enough.
    ends = (
        both.select("pid", F.explode(sides).alias("e"))
        .select("pid", F.col("e.a").alias("a"), F.col("e.port").alias("port"))
        .distinct()
    )
    # Addresses that stand for any, and the loopback address.
    wildcards = F.when(
        F.col("addr") == "127.0.0.1", F.array(*map(F.lit, ["0.0.0.0", "::", "::1"]))
    ).otherwise(F.array().cast("array<string>"))
    accepted = F.array_distinct(F.array_compact(F.concat(F.array("host", "addr"), wildcards)))
    wanted = targets.select("host", "addr", "port", F.explode(accepted).alias("a")).distinct()
    return ends.join(wanted, ["a", "port"]).select("host", "addr", "port", "pid").distinct()


def connections_between(conns: DataFrame) -> DataFrame:
    """(connection, side, pid): connections whose two ends are both in the table.

    A process pair is two rows of one connection with different sides. Pairs are
    not written out: a connection shared by n and m processes has n + m rows.
    """
    known = conns.where("raddr is not null and rport is not null").select(
        F.concat_ws(":", "laddr", F.col("lport").cast("string")).alias("l"),
        F.concat_ws(":", "raddr", F.col("rport").cast("string")).alias("r"),
        "pid",
    )
    ends = known.select(
        F.concat_ws("|", F.least("l", "r"), F.greatest("l", "r")).alias("connection"),
        F.col("l").alias("side"),
        "pid",
    ).distinct()
    mirrored = (
        ends.groupBy("connection")
        .agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        .where("lo <> hi")
        .select("connection")
    )
    return ends.join(mirrored, "connection", "left_semi")


def shared_maps(maps: DataFrame, min_processes: int = 1) -> DataFrame:
    """(pid, path) rows of memory maps to (path, processes) without noise."""
    cut = F.regexp_replace("path", r"\(deleted\)$", "")
    kept = maps.where(~is_noise_map(F.col("path"))).select(F.rtrim(cut).alias("path"), "pid")
    return (
        kept.distinct()
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("processes"))
        .where(F.col("processes") >= min_processes)
    )


def shared_map_edges(maps: DataFrame, min_processes: int = 1) -> DataFrame:
    shared = shared_maps(maps, min_processes).select("path")
    cut = F.rtrim(F.regexp_replace("path", r"\(deleted\)$", ""))
    rows = maps.where(~is_noise_map(F.col("path"))).select(cut.alias("path"), "pid").distinct()
    return triples(
        rows.join(shared, "path", "left_semi"), process_node(), "memmap", file_node(), kind="uri"
    )


def symbol_links(symbols: DataFrame) -> DataFrame:
    """(library, symbol, type) rows: type T defines a symbol, U needs it."""
    symbol = node_text("symbol", {"Name": "symbol"})
    return as_set(
        union_all(
            [
                triples(
                    symbols.where("type = 'T'"), file_node("library"), "symbol_defined", symbol,
                    kind="uri",
                ),
                triples(
                    symbols.where("type = 'U'"), file_node("library"), "symbol_undefined", symbol,
                    kind="uri",
                ),
            ]
        )
    )


def resolve_symbols(symbols: DataFrame) -> DataFrame:
    """(library, symbol, definers, definer): who may satisfy each needed symbol.

    Definers are reduced to their number and the first by name before the join,
    so a symbol that very many libraries need meets one row.
    """
    defined = (
        symbols.where("type = 'T'")
        .groupBy("symbol")
        .agg(F.countDistinct("library").alias("definers"), F.min("library").alias("definer"))
    )
    needed = symbols.where("type = 'U'").select("library", "symbol").distinct()
    return needed.join(defined, "symbol", "left").select(
        "library", "symbol", F.coalesce("definers", F.lit(0)).cast("long").alias("definers"),
        "definer",
    )


def service_edges(deps: DataFrame) -> DataFrame:
    """(service, needs) and (service, needed_by) columns to edges in one direction."""
    down = deps.where("needs is not null").select("service", F.col("needs").alias("target"))
    up = deps.where("needed_by is not null").select(
        F.col("needed_by").alias("service"), F.col("service").alias("target")
    )
    return as_set(
        triples(
            down.unionByName(up),
            node_text("service", {"Name": "service"}),
            "service",
            node_text("service", {"Name": "target"}),
            kind="uri",
        )
    )


def user_processes(procs: DataFrame, user: str) -> DataFrame:
    """Processes of a user; ``DOMAIN\\user`` is reduced to the user."""
    bare = F.substring_index("user", "\\", -1)
    return procs.where(bare == user.rsplit("\\", 1)[-1])


def association_edges(rows: DataFrame, left, predicate: str, right) -> DataFrame:
    """Rows of a two-key association to edges; ``left``, ``right`` are (class, keys)."""
    return as_set(
        triples(rows, node_text(*left), predicate, node_text(*right), kind="uri")
    )


def user_groups(rows: DataFrame) -> DataFrame:
    return association_edges(
        rows, ("user", {"Name": "user"}), "group", ("group", {"Name": "group"})
    )


def object_dependencies(rows: DataFrame, direction: str = "uses") -> DataFrame:
    """(owner, name, type, ref_owner, ref_name, ref_type): object depends on object.

    ``uses`` points from the dependent object, ``used_by`` back to it.
    """
    one = F.concat(
        F.lower("type"), F.lit("."), F.concat_ws(",", *_pairs(("Owner", "owner"), ("Name", "name")))
    )
    two = F.concat(
        F.lower("ref_type"),
        F.lit("."),
        F.concat_ws(",", *_pairs(("Owner", "ref_owner"), ("Name", "ref_name"))),
    )
    s, o = (one, two) if direction == "uses" else (two, one)
    return as_set(triples(rows, s, "depends", o, kind="uri"))


def _pairs(*pairs: tuple[str, str]) -> list[Column]:
    from sysweave.functions.identity import encode_value

    return [F.concat(F.lit(k + "="), encode_value(F.col(c))) for k, c in pairs]


def queue_bindings(rows: DataFrame, properties: list[str]) -> DataFrame:
    """(vhost, queue, ...) rows: a triple per property of the binding."""
    node = node_text("queue", {"Vhost": "vhost", "Name": "queue"})
    long = rows.select(node.alias("s"), *[F.col(p).cast("string").alias(p) for p in properties])
    return triples(long.unpivot("s", properties, "p", "o"), "s", F.col("p"), "o")


def packet_edges(packets: DataFrame) -> DataFrame:
    """(packet BINARY) rows: IPv4 TCP packets to socket-end edges.

    The transport header starts where the header length of the first byte says.
    """

    def byte(at) -> Column:
        at = at if isinstance(at, Column) else F.lit(at)
        return F.conv(F.hex(F.substr("packet", at + 1, F.lit(1))), 16, 10).cast("int")

    header = (byte(0) % 16) * 4
    tcp = packets.where(
        (F.length("packet") >= 20) & (F.floor(byte(0) / 16) == 4) & (byte(9) == 6)
    ).where(F.length("packet") >= header + 4)
    source = F.concat_ws(".", *[byte(i).cast("string") for i in range(12, 16)])
    target = F.concat_ws(".", *[byte(i).cast("string") for i in range(16, 20)])
    cells = tcp.select(
        source.alias("src"),
        (byte(header) * 256 + byte(header + 1)).alias("sport"),
        target.alias("dst"),
        (byte(header + 2) * 256 + byte(header + 3)).alias("dport"),
    )
    return as_set(
        triples(
            cells,
            endpoint_node("src", "sport"),
            "socket_end",
            endpoint_node("dst", "dport"),
            kind="uri",
        )
    )


def open_file_edges(
    rows: DataFrame, min_processes: int = 2, libraries: bool = False, fonts: bool = False
) -> DataFrame:
    """(pid, path) rows: files open in several processes; ``min_processes=1`` shows all."""
    kept = rows.where(
        ~is_noise_path(F.col("path"), libraries=not libraries, fonts=not fonts)
    ).select("pid", "path").distinct()
    edges = kept
    if min_processes > 1:
        often = (
            kept.groupBy("path")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_processes)
            .select("path")
        )
        edges = kept.join(often, "path", "left_semi")
    return triples(edges, process_node(), "open_file", file_node(), kind="uri")


def netstat_rows(lines: DataFrame) -> DataFrame:
    """(line) of a socket listing to its tcp rows; the header's place does not matter,
    since only socket rows start with ``tcp``."""
    w = F.filter(F.split("line", r"\s+"), lambda x: x != "")

    def word(n: int) -> Column:
        return F.get(w, F.lit(n))

    return lines.where(
        (word(0) == "tcp") & word(5).isin("ESTABLISHED", "TIME_WAIT")
    ).select(
        endpoint_host(word(3)).alias("lhost"),
        endpoint_port(word(3)).alias("lport"),
        word(4).alias("remote"),
        endpoint_host(word(4)).alias("rhost"),
        endpoint_port(word(4)).alias("rport"),
        word(5).alias("status"),
        F.when(word(6) != "-", F.substring_index(word(6), "/", 1)).alias("pid"),
        F.when(word(6) != "-", F.substring_index(word(6), "/", -1)).alias("program"),
    )


def parse_netstat(lines: DataFrame, machine: str = "localhost") -> DataFrame:
    rows = netstat_rows(lines)
    local = endpoint_node("lhost", "lport")
    return as_set(
        union_all(
            [
                triples(rows, local, INFORMATION, "status"),
                triples(
                    rows.where("remote <> '0.0.0.0:*'"),
                    local,
                    "socket_end",
                    endpoint_node("rhost", "rport"),
                    kind="uri",
                ),
                triples(
                    rows.where("pid is not null"), process_node(), "has_socket", local, kind="uri"
                ),
                triples(
                    rows.where("pid is null"),
                    F.lit(f"machine.Name={machine}"),
                    "host",
                    local,
                    kind="uri",
                ),
            ]
        )
    )


def parse_module_deps(lines: DataFrame) -> DataFrame:
    """``module: dep dep`` lines to (parent, child) edges; below one module by closure."""
    head = F.trim(F.substring_index("line", ":", 1))
    deps = F.filter(F.split(F.substring_index("line", ":", -1), r"\s+"), lambda x: x != "")
    return (
        lines.where(F.instr("line", ":") > 0)
        .select(head.alias("parent"), F.explode(deps).alias("child"))
        .distinct()
    )


def parse_library_deps(lines: DataFrame) -> DataFrame:
    """(library, line) ``name => path (addr)`` lines to library edges."""
    pattern = r"^.*=> *([^ ]+) \("
    found = lines.where(F.col("line").rlike(pattern)).select(
        "library", F.regexp_extract("line", pattern, 1).alias("path")
    )
    return as_set(triples(found, file_node("library"), "library_depends", file_node(), kind="uri"))


def package_edges(rows: DataFrame) -> DataFrame:
    """(package, version, requires, condition): properties, and needs with their condition."""
    node = node_text("package", {"Id": "package"})
    need = F.concat(F.col("requires"), F.coalesce("condition", F.lit("")))
    return as_set(
        union_all(
            [
                triples(rows, node, TYPE, F.lit("package"), kind="uri"),
                triples(rows, node, "version", "version"),
                triples(
                    rows.where("requires is not null"),
                    node,
                    "requires",
                    node_text("package", {"Id": "requires"}),
                    kind="uri",
                ),
                triples(rows.where("requires is not null"), node, "condition", need),
            ]
        )
    )


def parse_tns(texts: DataFrame, col: str = "text") -> DataFrame:
    """Service entries of a names file to (name, host, port); comments are stripped and
    entries without both are dropped."""
    bare = F.regexp_replace(F.col(col), r"#[^\n]*(\n|$)", "\n")
    # An entry starts at a name in the first column followed by an open parenthesis.
    entries = F.regexp_extract_all(
        bare, F.lit(r"(?m)^[ \t]*(\w[\w.,]*\s*=\s*\((?:(?!^\w)[\s\S])*)"), F.lit(1)
    )
    rows = texts.select(F.explode(entries).alias("e"))
    return rows.select(
        F.regexp_extract("e", r"^(\w+)", 1).alias("name"),
        _tns_value("HOST").alias("host"),
        _tns_value("PORT").alias("port"),
    ).where("host <> '' and port <> ''")


def _tns_value(key: str) -> Column:
    # The last of several addresses wins, as in a map filled from left to right.
    found = F.regexp_extract_all(F.col("e"), F.lit(rf"\b{key}\s*=\s*([A-Za-z0-9.-]+)"), F.lit(1))
    return F.coalesce(F.element_at(F.when(F.size(found) > 0, found), -1), F.lit(""))


# Separator and columns of system files.
ACCOUNT_FILES = {
    "passwd": (":", ["user", "x", "uid", "gid", "comment", "home", "shell"]),
    "group": (":", ["group", "x", "gid", "members"]),
    "mtab": (" ", ["device", "mount", "type", "options"]),
    "cgroups": ("\t", ["name", "hierarchy", "num_cgroups", "enabled"]),
}


def parse_accounts(lines: DataFrame, kind: str) -> DataFrame:
    """Lines of a system file to its columns; comments and short lines are dropped."""
    sep, names = ACCOUNT_FILES[kind]
    cells = F.split("line", sep)
    return lines.where(~F.col("line").startswith("#") & (F.size(cells) >= len(names))).select(
        *[F.get(cells, F.lit(n)).alias(name) for n, name in enumerate(names)]
    )


def account_triples(lines: DataFrame, kind: str) -> DataFrame:
    """Accounts as triples, each once. A line becomes many triples, so lines are dealt out first: no
    task makes and combines the triples of a whole file."""
    _, names = ACCOUNT_FILES[kind]
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parse_accounts(lines.select("line").repartition(tasks), kind)
    key = names[0]
    kept = [n for n in names[1:] if n != "x"]
    return as_set(
        tables_to_triples(rows, kind, {"Name": key}, properties={n: n for n in kept}, layout="rows")
    )


def symlink_edges(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Directory edges of each prefix of a path, and an edge from a link's target
    to the link where a prefix is in the (path, target) table."""
    steps = path_ancestors(paths)
    real = steps.where("parent <> '/'")
    linked = steps.select(F.col("child").alias("path")).join(links, "path")
    return as_set(
        union_all(
            [
                triples(
                    real, directory_node("parent"), "directory", directory_node("child"), kind="uri"
                ),
                triples(
                    linked.where("path <> target"),
                    directory_node("target"),
                    "symlink",
                    directory_node("path"),
                    kind="uri",
                ),
            ]
        )
    )


def env_values(env: DataFrame, sep: str = ":") -> DataFrame:
    """(pid, name, value) rows to (pid, name, value, kind); path lists become directories.

    The file system is not asked: an absolute path is a file when its last part
    has an extension, else a directory.
    """
    # Variables that hold lists of directories.
    is_list = F.col("name").isin("PATH", "PSMODULEPATH", "PYPATH")
    parts = F.when(is_list, F.split("value", sep)).otherwise(F.array("value"))
    rows = env.select("pid", "name", F.explode(parts).alias("value"), is_list.alias("_list"))
    absolute = F.col("value").startswith("/")
    has_ext = F.substring_index("value", "/", -1).rlike(r"^.+\..+$")
    kind = (
        F.when(F.col("_list"), "directory")
        .when(absolute & has_ext, "file")
        .when(absolute, "directory")
        .otherwise("text")
    )
    shown = F.when(kind == "text", F.translate("value", "><&\\", "____")).otherwise(F.col("value"))
    return rows.select("pid", "name", shown.alias("value"), kind.alias("kind"))


def catalog_objects(rows: DataFrame) -> DataFrame:
    """(schema, table, kind, column, rows) of a database catalog as triples."""
    table = node_text("table", {"Schema": "schema", "Name": "table"})
    column = node_text("column", {"Schema": "schema", "Table": "table", "Name": "column"})
    named = rows.where("column is not null")
    return as_set(
        union_all(
            [
                triples(rows, table, TYPE, F.col("kind"), kind="uri"),
                triples(rows, table, "rows", F.col("rows").cast("string"), o_type="long"),
                triples(
                    rows,
                    node_text("schema", {"Name": "schema"}),
                    F.col("kind"),
                    table,
                    kind="uri",
                ),
                triples(named, table, "column", column, kind="uri"),
            ]
        )
    )


def session_edges(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Database sessions (session_id, client_host, client_pid, status) and their
    requests (session_id, query)."""
    session = node_of_integer("session", "Id", "session_id")
    running = sessions.join(requests, "session_id")
    client = F.concat(
        F.lower("client_host"), F.lit("@"), node_of_integer("process", "Handle", "client_pid")
    )
    return as_set(
        union_all(
            [
                triples(sessions, session, "status", "status"),
                triples(
                    sessions.where("client_pid is not null"), session, "client", client, kind="uri"
                ),
                triples(
                    running, session, "query", node_text("query", {"Query": "query"}), kind="uri"
                ),
            ]
        )
    )


def arp_rows(lines: DataFrame) -> DataFrame:
    """``? (addr) at hw [ether] on if`` lines to (address, hardware, interface)."""
    w = F.filter(F.split("line", " +"), lambda x: x != "")

    def word(n: int) -> Column:
        return F.get(w, F.lit(n))

    at = F.when(word(4) == "on", 5).when(word(5) == "on", 6)
    return lines.where((F.size(w) >= 4) & at.isNotNull()).select(
        F.regexp_replace(word(1), r"^.|.$", "").alias("address"),
        F.when(word(3) == "<incomplete>", "").otherwise(word(3)).alias("hardware"),
        F.get(w, at).alias("interface"),
    )


def parse_arp(lines: DataFrame) -> DataFrame:
    rows = arp_rows(lines)
    node = node_text("addr", {"Id": "address"})
    return as_set(
        union_all(
            [
                triples(rows.where("hardware <> ''"), node, "mac", "hardware"),
                triples(rows, node, "interface", "interface"),
            ]
        )
    )


def disk_usage(rows: DataFrame) -> DataFrame:
    """(partition, used, free) rows as triples."""
    return tables_to_triples(
        rows, "partition", {"Name": "partition"}, properties={"used": "used", "free": "free"}
    )
