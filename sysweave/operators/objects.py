"""Processes, file accesses and dependencies out of traced calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.functions.paths import (
    NON_FILE_PREFIXES,
    fd_to_path,
    is_plain_file,
    open_mode,
    path_category,
    port,
    starts_with_any,
)
from sysweave.functions.identity import node_text
from sysweave.functions.values import decode_octal
from sysweave.model import TYPE, as_set, settled
from sysweave.operators.calls import FLOW, kind_of, normalise_pids
from sysweave.operators.ordered import scan
from sysweave.operators.relations import file_node
from sysweave.sources.tables import tables_to_triples
from sysweave.operators.textscan import SQL_CHARS, find_sql_column
from sysweave.session import cut

OPENS = ["open@SYS", "openat@SYS"]
READS = ["read@SYS", "pread@SYS", "pread64@SYS"]
WRITES = ["write@SYS", "writev@SYS"]


def process_table(calls: DataFrame) -> DataFrame:
    """(session, pid, t_create, t_end, ppid, executable, command, is_thread).

    Created at the creating call, else at the first call seen; ended at the last
    wait for it, else with the last call of the trace; parent is the process whose
    call, creating or waiting, named it last. First and last go by ``seq``, so
    times of the day will do.
    """
    named = normalise_pids(calls)
    kind = kind_of(F.col("fn"))
    is_exec = kind.isin("execute", "main") & ~F.coalesce(
        F.col("ret").contains("ENOENT"), F.lit(False)
    )
    first_arg = F.coalesce(F.get("args", F.lit(0)), F.lit(""))
    argv = F.from_json(
        F.when(kind == "main", first_arg).otherwise(F.get("args", F.lit(1))), "array<string>"
    )
    executable = F.when(kind == "main", F.get(argv, F.lit(0))).otherwise(first_arg)
    null = F.lit(None).cast("string")
    own = F.struct(
        F.col("pid").alias("pid"),
        F.lit("own").alias("role"),
        F.lit(None).cast("long").alias("by"),
        F.when(is_exec, executable).alias("executable"),
        F.when(is_exec, F.array_join(argv, " ")).alias("command"),
        F.lit(None).cast("boolean").alias("is_thread"),
    )

    def other(pid: str, role: str, thread) -> Column:
        return F.struct(
            F.col(pid).alias("pid"), F.lit(role).alias("role"), F.col("pid").alias("by"),
            null.alias("executable"), null.alias("command"), thread.alias("is_thread"),
        )

    facts = F.array(
        own,
        F.when(
            F.col("new_pid").isNotNull(), other("new_pid", "create", F.col("is_thread"))
        ),
        F.when(
            F.col("waited_pid").isNotNull(),
            other("waited_pid", "wait", F.lit(None).cast("boolean")),
        ),
    )
    rows = named.select(
        "session", "seq", "t_start", "t_end", F.explode(F.array_compact(facts)).alias("f")
    ).select("session", "seq", "t_start", "t_end", "f.*")
    role = F.col("role")
    made, waited = role == "create", role == "wait"
    per = rows.groupBy("session", "pid").agg(
        F.max_by("t_start", F.when(made, F.col("seq"))).alias("_made"),
        F.min_by("t_start", F.when(role == "own", F.col("seq"))).alias("_seen"),
        F.max_by("t_start", F.when(waited, F.col("seq"))).alias("_waited"),
        F.max_by("by", F.when((made | waited) & (F.col("by") != F.col("pid")), F.col("seq"))).alias(
            "ppid"
        ),
        F.max_by("executable", F.when(F.col("executable").isNotNull(), F.col("seq"))).alias(
            "executable"
        ),
        F.max_by("command", F.when(F.col("executable").isNotNull(), F.col("seq"))).alias("command"),
        F.max_by("is_thread", F.when(made, F.col("seq"))).alias("is_thread"),
    )
    last = calls.groupBy("session").agg(F.max_by("t_end", "seq").alias("_last"))
    return per.join(last, "session").select(
        "session",
        "pid",
        F.coalesce("_made", "_seen", "_waited").alias("t_create"),
        F.coalesce("_waited", "_last").alias("t_end"),
        "ppid",
        "executable",
        "command",
        F.coalesce("is_thread", F.lit(False)).alias("is_thread"),
    )


def process_links(processes: DataFrame) -> DataFrame:
    """(parent, child) edges of the process tree, for closure and roots."""
    def key(c):
        return F.concat_ws(":", "session", F.col(c).cast("string"))

    return processes.where("ppid is not null").select(
        key("ppid").alias("parent"), key("pid").alias("child")
    )


def touched_path(in_force: bool = False) -> Column:
    """Path of the file an access is about."""
    fn, ret = F.col("fn"), F.coalesce(F.col("ret"), F.lit(""))
    first = F.coalesce(F.get("args", F.lit(0)), F.lit(""))
    second = F.coalesce(F.get("args", F.lit(1)), F.lit(""))
    strace = F.col("tracer") != "ltrace"
    known = F.col("fd_path") if in_force else None
    return (
        F.when(fn.isin(OPENS) & strace, fd_to_path(ret))
        .when(fn == "open@SYS", first)
        .when(fn == "openat@SYS", second)
        .otherwise(fd_to_path(first, known))
    )


def accesses(calls: DataFrame, parity: bool = False) -> DataFrame:
    """One row per call that opens, closes, reads or writes: (session, pid, path, seq,
    letter, event times and bytes)."""
    fn, ret = F.col("fn"), F.col("ret")
    opened = fn.isin(["open@SYS"] if parity else OPENS)
    closed = fn == "close@SYS"
    read, written = fn.isin(READS), fn.isin(WRITES)
    flag = F.when(fn == "open@SYS", F.get("args", F.lit(1))).when(
        fn == "openat@SYS", F.get("args", F.lit(2))
    )
    letter = (
        F.when(opened, F.coalesce(open_mode(flag), F.lit("R")))
        .when(closed, "C")
        .when(read, "R")
        .when(written, "W")
    )
    amount = F.when(
        (F.col("tracer") == "ltrace") & ret.startswith("0x"),
        F.conv(F.regexp_replace(ret, "^0x", ""), 16, 10).try_cast("long"),
    ).otherwise(ret.try_cast("long"))
    as_open = opened | (closed if parity else F.lit(False))
    ok_close = closed & ~F.coalesce(ret.contains("EBADF"), F.lit(False))
    failed_open = fn.isin(OPENS) & F.coalesce(
        F.when(F.col("tracer") == "ltrace", ret.contains("-2")).otherwise(
            ret.contains("ENOENT")
        ),
        F.lit(False),
    )
    kept = calls.where(
        fn.isin([*OPENS, "close@SYS", *READS, *WRITES])
        & ~F.col("status").isin("unfinished", "matched", "resumed")
        & ~failed_open
        & ~(read & amount.isNull())
    )
    rows = kept.select(
        *FLOW,
        touched_path("fd_path" in calls.columns).alias("path"),
        "seq",
        letter.alias("letter"),
        F.when(as_open, F.col("t_start")).alias("open_at"),
        F.when(ok_close, F.col("t_end")).alias("close_at"),
        F.when(read, amount).alias("bytes_in"),
        F.when(written, amount).alias("bytes_out"),
        F.when(read | written, F.get("args", F.lit(1))).alias("buffer"),
        flag.alias("flags"),
    )
    return settled(rows).where("letter is not null")


def file_access_table(calls: DataFrame, parity: bool = False) -> DataFrame:
    """One row per (process, path): first open and close, counts, bytes, flag.

    The flag is the first letter seen, ``W`` once the file was written.
    ``parity=True`` counts a close as an open and lets ``openat`` record none.
    """
    rows = accesses(calls, parity)
    return rows.groupBy(*FLOW, "path").agg(
        F.min_by("open_at", F.when(F.col("open_at").isNotNull(), F.col("seq"))).alias("t_open"),
        F.min_by("close_at", F.when(F.col("close_at").isNotNull(), F.col("seq"))).alias("t_close"),
        F.count("open_at").alias("n_open"),
        F.count("bytes_in").alias("n_read"),
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_read"),
        F.count("bytes_out").alias("n_write"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_written"),
        F.when(F.max(F.col("letter") == "W"), F.lit("W"))
        .otherwise(F.min_by("letter", "seq"))
        .alias("flag"),
    )


MESSAGE = [*FLOW, "path", "dir"]


def fragments(calls: DataFrame, decode: bool = True) -> DataFrame:
    """(session, pid, path, dir, seq, text, _full): what reads and writes show of their
    data; ``_full`` marks fragments of a round block size that are shown whole. Plain
    files are skipped."""
    rows = accesses(calls).where(
        F.col("buffer").isNotNull()
        & (F.col("buffer") != "")
        & F.coalesce("bytes_in", "bytes_out").isNotNull()
        & ~is_plain_file(F.col("path"))
    )
    text = decode_octal(F.col("buffer")) if decode else F.col("buffer")
    size = F.coalesce("bytes_in", "bytes_out")
    # Block sizes, by the range they count in.
    block = (
        ((size % 0x100 == 0) & (size <= 0x1000))
        | ((size % 0x1000 == 0) & (size <= 0x10000))
        | ((size % 0x10000 == 0) & (size <= 0x100000))
        | (size % 0x100000 == 0)
    )
    shown = rows.select(
        *FLOW,
        "path",
        F.when(F.col("bytes_in").isNotNull(), "read").otherwise("write").alias("dir"),
        "seq",
        text.alias("text"),
        block.alias("_block"),
        size.alias("_size"),
    ).where("text is not null")
    full = F.col("_block") & (F.col("_size") == F.octet_length("text"))
    return shown.select(*MESSAGE, "seq", "text", full.alias("_full"))


def rebuild_buffers(calls: DataFrame, decode: bool = True) -> DataFrame:
    """(session, pid, path, dir, seq, text, closed): messages of reads and writes.

    Fragments of a round block size that are shown whole belong to one message;
    the first fragment that is not ends it and is a message of its own. A
    message nothing ended has ``closed`` false. Plain files are skipped. A message is
    one text here; ``message_parts`` leaves long ones in parts.
    """
    ends = F.when(F.col("_full"), 0).otherwise(1)
    runs = scan(fragments(calls, decode), MESSAGE, sums={"_ends": ends})
    # A group is the full fragments since the last short one, and the one that ends them.
    parts = F.array_sort(
        F.collect_list(F.when(F.col("_full"), F.struct("seq", "text")))
    )
    last = F.max(F.when(~F.col("_full"), F.struct("seq", "text")))
    groups = (
        runs.withColumn("_group", F.col("_ends") - ends)
        .groupBy(*MESSAGE, "_group")
        .agg(parts.alias("_parts"), last.alias("_last"))
    )
    glued = F.when(
        F.size("_parts") > 0,
        F.struct(
            F.get("_parts", F.lit(0))["seq"].alias("seq"),
            F.array_join(F.col("_parts.text"), "").alias("text"),
            F.col("_last").isNotNull().alias("closed"),
        ),
    )
    short = F.when(
        F.col("_last").isNotNull(),
        F.struct(
            F.col("_last.seq").alias("seq"),
            F.col("_last.text").alias("text"),
            F.lit(True).alias("closed"),
        ),
    )
    messages = F.explode(F.array_compact(F.array(glued, short)))
    return groups.select(*MESSAGE, messages.alias("m")).select(*MESSAGE, "m.*")


def message_parts(calls: DataFrame, decode: bool = True) -> DataFrame:
    """(session, pid, path, dir, seq, part, text, closed): the messages of ``rebuild_buffers``,
    a row for each fragment, numbered from 0 in each message.

    ``seq`` is that of the first fragment and names the message. No task holds a message:
    its rows meet one row of facts about it.
    """
    ends = F.when(F.col("_full"), 0).otherwise(1)
    runs = cut(
        scan(
            fragments(calls, decode), MESSAGE,
            sums={"_ends": ends, "_fulls": F.col("_full").cast("int")},
        ).withColumn("_group", F.col("_ends") - ends)
    )
    heads = runs.groupBy(*MESSAGE, "_group").agg(
        F.min(F.when(F.col("_full"), F.col("seq"))).alias("_first"),
        F.min(F.when(F.col("_full"), F.col("_fulls"))).alias("_base"),
        F.max(~F.col("_full")).alias("closed"),
    ).where("_first is not null")
    long = runs.where("_full").join(heads, [*MESSAGE, "_group"]).select(
        *MESSAGE, F.col("_first").alias("seq"), (F.col("_fulls") - F.col("_base")).alias("part"),
        "text", "closed",
    )
    short = runs.where("not _full").select(
        *MESSAGE, "seq", F.lit(0).cast("long").alias("part"), "text", F.lit(True).alias("closed")
    )
    return long.unionByName(short)


# Named scanners of buffers: text column -> array of (kind, text).
SCANNERS: dict[str, Callable[[Column], Column]] = {"SqlQuery": find_sql_column}
# The characters a find of a scanner may hold, as a class of a pattern.
SCANNED = {"SqlQuery": SQL_CHARS}


def _hits(name: str, scanner: Callable[[Column], Column]) -> Column:
    return F.transform(
        scanner(F.col("text")),
        lambda h: F.struct(
            F.lit(name).alias("scanner"), h["kind"].alias("kind"), h["text"].alias("hit")
        ),
    )


def buffer_hits(buffers: DataFrame, scanners=None) -> DataFrame:
    """(session, pid, path, dir, seq, scanner, kind, hit) of the scanners' finds."""
    chosen = scanners or SCANNERS
    found = F.flatten(F.array(*[_hits(name, scanner) for name, scanner in chosen.items()]))
    return buffers.select(*FLOW, "path", "dir", "seq", F.explode(found).alias("h")).select(
        *FLOW, "path", "dir", "seq", "h.*"
    )


def part_hits(parts: DataFrame, scanners=None, scanned=None) -> DataFrame:
    """(session, pid, path, dir, seq, scanner, kind, hit): the finds of ``buffer_hits`` in
    messages that are left in parts, those over borders of parts included.

    ``scanned`` names for each scanner the class of characters its finds are made of. So
    no find goes over another character, and what a scanner sees is a part from its first
    such character to its last, and the stretches between one part's last and the next
    one's first, with parts that have none in between. Only a stretch without such a
    character is put together, never a message.
    """
    chosen, of = scanners or SCANNERS, scanned or SCANNED
    keys = [*MESSAGE, "seq"]
    out = None
    for name, scanner in chosen.items():
        begin = F.regexp_extract("text", f"^{of[name]}*+", 0)
        end = F.reverse(F.regexp_extract(F.reverse("text"), f"^{of[name]}*+", 0))
        split = parts.select(*keys, "part", "text", begin.alias("_begin"), end.alias("_end"))
        broken = F.length("_begin") < F.length("text")
        counted = scan(split, keys, "part", sums={"_breaks": broken.cast("int")})
        inner = F.expr("substring(text, length(_begin) + 1, length(text) - length(_begin) - length(_end))")
        before = F.col("_breaks") - broken.cast("int")
        piece = lambda at, text: F.struct(at.alias("at"), text.alias("text"))
        pieces = F.when(
            broken, F.array(piece(before, F.col("_begin")), piece(F.col("_breaks"), F.col("_end")))
        ).otherwise(F.array(piece(before, F.col("text"))))
        borders = (
            counted.select(*keys, "part", F.explode(pieces).alias("p"))
            .where("p.text <> ''")
            .groupBy(*keys, "p.at")
            .agg(F.array_sort(F.collect_list(F.struct("part", F.col("p.text").alias("text")))).alias("_p"))
            .select(*keys, F.array_join("_p.text", "").alias("text"))
        )
        seen = borders.unionByName(counted.where(broken).select(*keys, inner.alias("text")))
        found = buffer_hits(seen, {name: scanner})
        out = found if out is None else out.unionByName(found)
    return out


def build_rules(file_accesses: DataFrame, processes: DataFrame) -> DataFrame:
    """(session, pid, role, path, cwd, command): make-like rules, a rule per process.

    Rows with role ``target`` depend on all rows with role ``input`` of the same
    process. Only plain files outside the standard places count, and only
    processes with inputs. A target per input is not written out, so a process
    with many files has as many rows as files.
    """
    # Places of standard files.
    plain = file_accesses.where(
        is_plain_file(F.col("path"))
        & ~starts_with_any(F.col("path"), ["/usr/", "/lib64/", "/etc/"])
    ).select(
        *FLOW, "path", F.when(F.col("flag") == "R", "input").otherwise("target").alias("role")
    )
    both = (
        plain.groupBy(*FLOW)
        .agg(F.count_distinct("role").alias("_roles"))
        .where("_roles = 2")
        .select(*FLOW)
    )
    cwd = F.col("cwd") if "cwd" in processes.columns else F.lit(None).cast("string")
    about = processes.select(
        *FLOW, cwd.alias("cwd"), F.coalesce("command", "executable", F.lit("")).alias("command")
    )
    return (
        plain.join(both, FLOW, "left_semi")
        .join(about, FLOW, "left")
        .select(*FLOW, "role", "path", "cwd", "command")
    )


def dataflow(file_accesses: DataFrame) -> DataFrame:
    """(session, path, role, pid): files one process writes and another reads.

    Writers and readers are the two ends of the flow through the file; pairs of
    processes are not written out, so a file with n accesses has n rows.
    """
    ends = file_accesses.select(
        "session", "path", "pid",
        F.explode(
            F.array_compact(
                F.array(
                    F.when((F.col("n_write") > 0) | (F.col("flag") == "W"), F.lit("writer")),
                    F.when(F.col("n_read") > 0, F.lit("reader")),
                )
            )
        ).alias("role"),
    ).distinct()
    writer, reader = F.col("role") == "writer", F.col("role") == "reader"
    both = (
        ends.groupBy("session", "path")
        .agg(
            F.min(F.when(writer, F.col("pid"))).alias("w0"),
            F.max(F.when(writer, F.col("pid"))).alias("w1"),
            F.min(F.when(reader, F.col("pid"))).alias("r0"),
            F.max(F.when(reader, F.col("pid"))).alias("r1"),
        )
        # Someone reads and someone else writes.
        .where("w0 is not null and r0 is not null and not (w0 = w1 and r0 = r1 and w0 = r0)")
        .select("session", "path")
    )
    return ends.join(both, ["session", "path"], "left_semi")


# Places no package owns.
UNPACKAGED = ["/home/", "/tmp/", "/sys/", "/var/cache/", *NON_FILE_PREFIXES]


def needed_packages(files: DataFrame, index: DataFrame) -> DataFrame:
    """(path, package): owner of each file, the first by name; null when nobody owns it."""
    owners = index.groupBy("path").agg(F.min("package").alias("package"))
    paths = files.select("path").distinct()
    local = starts_with_any(F.col("path"), UNPACKAGED)
    return paths.join(owners, "path", "left").select(
        "path", F.when(~local, F.col("package")).alias("package")
    )


def python_packages(files: DataFrame) -> DataFrame:
    """Distinct packages: the part after ``site-packages`` or ``dist-packages``."""
    parts = F.split("path", "/")
    site = F.array_position(parts, "site-packages")
    dist = F.array_position(parts, "dist-packages")
    at = F.when(site > 0, site).otherwise(dist).cast("int")
    name = F.when(at > 0, F.get(parts, at))
    return (
        files.select(name.alias("package"))
        .where("package is not null")
        .where(~F.col("package").rlike(r"\.pyc?$"))
        .distinct()
    )


def interpreter_kind(processes: DataFrame) -> DataFrame:
    exe = F.coalesce("executable", F.lit(""))
    kind = (
        F.when(exe.contains("/python") | exe.startswith("python"), "Python scripts")
        .when(exe.contains("/perl"), "Perl scripts")
        .otherwise("Binary programs")
    )
    return processes.withColumn("kind", kind)


def exposed_ports(files: DataFrame) -> DataFrame:
    return files.select(port(F.col("path")).alias("port")).where("port is not null").distinct()


def env_read(calls: DataFrame) -> DataFrame:
    """(session, name, value): variables read; the last value wins, ``nil`` is empty."""
    fn = F.col("fn")
    value = F.when(F.col("ret") == "nil", "").otherwise(F.col("ret"))
    return (
        calls.where(fn == "getenv")
        .groupBy("session", F.get("args", F.lit(0)).alias("name"))
        .agg(F.max_by(value, "seq").alias("value"))
    )


def files_by_category(files: DataFrame, executed: DataFrame | None = None) -> DataFrame:
    """(category, path); files a process executed are in a category of their own."""
    paths = files.select("path").distinct().withColumn("category", path_category(F.col("path")))
    if executed is None:
        return paths.select("category", "path")
    ran = executed.select(F.col("executable").alias("path")).where("path is not null").distinct()
    run = paths.join(ran, "path", "left_semi").withColumn("category", F.lit("Executed"))
    rest = paths.join(ran, "path", "left_anti")
    return rest.unionByName(run).select("category", "path")


def category_counts(categorised: DataFrame) -> DataFrame:
    return categorised.groupBy("category").agg(F.count(F.lit(1)).alias("files"))


def changes_only(facts: DataFrame) -> DataFrame:
    """(object, cls, attribute, value, seq) rows to the triples that tell something new.

    A value is kept when it differs from the one before it; the first fact of an
    object is preceded by its type.
    """
    seen = scan(
        facts, ["object", "attribute"], previous={"_was": F.struct(F.col("value").alias("v"))}
    )
    new = seen.where(F.col("_was").isNull() | ~F.col("_was.v").eqNullSafe(F.col("value")))
    changes = new.select(
        F.col("object").alias("s"), F.col("attribute").alias("p"), F.col("value").alias("o"),
        F.lit("lit").alias("o_kind"), F.col("seq"),
    )
    types = facts.groupBy("object").agg(
        F.min_by("cls", "seq").alias("o"), F.min("seq").alias("seq")
    ).select(
        F.col("object").alias("s"), F.lit(TYPE).alias("p"), "o", F.lit("uri").alias("o_kind"), "seq"
    )
    return types.unionByName(changes)


def trace_to_triples(processes: DataFrame, file_accesses: DataFrame) -> DataFrame:
    """Processes, files and accesses as a graph; each table is read once.

    A process is named by its session and number, so numbers may come again.
    """
    procs = tables_to_triples(
        processes,
        "process",
        {"Session": "session", "Handle": "pid"},
        properties={"t_create": "t_create", "t_end": "t_end", "command": "command"},
        links={
            "ppid": ("process", {"Session": "session", "Handle": "ppid"}),
            "executable": ("file", {"Name": "executable"}),
        },
        layout="rows",
    )

    def fact(s, p: str, o, kind: str) -> Column:
        o_type = F.lit("string") if kind == "lit" else F.lit(None).cast("string")
        return F.struct(
            s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
            o_type.alias("o_type"),
        )

    file, process = file_node(), node_text("process", {"Session": "session", "Handle": "pid"})
    facts = F.array(
        fact(file, TYPE, F.lit("file"), "uri"),
        fact(file, "category", path_category(F.col("path")), "lit"),
        F.when(F.col("n_read") > 0, fact(process, "reads", file, "uri")),
        F.when(F.col("n_write") > 0, fact(process, "writes", file, "uri")),
    )
    files = file_accesses.select(F.explode(F.array_compact(facts)).alias("t")).select(
        "t.*", F.lit(None).cast("string").alias("ctx")
    )
    return as_set(procs.unionByName(files))
