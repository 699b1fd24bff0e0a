"""What single calls touch, and the joining of interrupted calls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.functions.paths import fd_to_path, normalise_path
from sysweave.operators.ordered import scan
from sysweave.session import cut

FLOW = ["session", "pid"]

# System calls without side effects.
IGNORED = [
    "arch_prctl", "brk", "futex", "clock_getres", "clock_gettime", "getegid", "geteuid",
    "getgid", "getpgid", "getpid", "getpgrp", "getppid", "getresgid", "getrlimit", "gettid",
    "getuid", "lseek", "mlock", "mprotect", "rt_sigaction", "rt_sigprocmask", "rt_sigreturn",
    "sched_getaffinity", "set_robust_list", "set_tid_address", "setpgid", "setpgrp", "times",
]

# Modelled functions by where the touched object is found.
RULES = {
    "stream": [
        "close", "read", "pread", "pread64", "write", "writev", "ioctl", "dup2", "fstat",
        "fstat64", "fstatfs", "fadvise64", "fchdir", "fcntl", "fcntl64", "fchown", "ftruncate",
        "fsync", "fchmod", "getdents", "getdents64", "sendmsg", "sendmmsg", "recvmsg",
        "recvfrom", "getsockname", "getpeername", "connect", "bind", "sendto", "shutdown",
    ],
    "map": ["mmap", "mmap2"],
    "path": ["stat", "lstat", "access"],
    "open": ["open"],
    "openat": ["openat"],
    "at": ["newfstatat"],
    "result": ["socket"],
    "dup": ["dup"],
    "pair": ["pipe", "pipe2"],
    "create": ["clone", "vfork"],
    "wait": ["wait4"],
    "execute": ["execve"],
    "poll": ["poll"],
    "select": ["select"],
    "return": ["setsockopt"],
    "nothing": ["munmap", "exit_group"],
}
LIBRARY_RULES = {"main": ["__libc_start_main"], "getenv": ["getenv"]}

# Functions that are usable without their return.
UNFINISHED_OK = ["__libc_start_main"]
RESUMED_OK = ["vfork@SYS"]
# Calls that create or replace a process are never repeats of each other.
NEVER_EQUAL = ["clone@SYS", "vfork@SYS", "execve@SYS", "__libc_start_main"]


def rule_table(more: Mapping[str, str] | None = None) -> dict[str, str]:
    """Function name -> kind of extraction; ``more`` adds or replaces rows."""
    table = {f"{fn}@SYS": kind for kind, fns in RULES.items() for fn in fns}
    table.update({fn: kind for kind, fns in LIBRARY_RULES.items() for fn in fns})
    table.update(more or {})
    return table


def kind_of(fn: Column, more: Mapping[str, str] | None = None) -> Column:
    cells = [F.lit(x) for pair in rule_table(more).items() for x in pair]
    return F.element_at(F.create_map(*cells), fn)


def drop_ignored(calls: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
    """Without the calls that have no side effect, and without unknown functions."""
    return calls.where(
        ~F.col("fn").isin([f"{fn}@SYS" for fn in IGNORED])
        & F.col("fn").isin(list(rule_table(rules)))
    )


def failed(calls_have_args: bool = True) -> Column:
    """True for calls that touched nothing because they failed."""
    fn, ret = F.col("fn"), F.coalesce(F.col("ret"), F.lit(""))
    done = ~F.col("status").isin("unfinished", "matched", "resumed")
    missing = F.when(F.col("tracer") == "ltrace", ret.contains("-2")).otherwise(
        ret.contains("ENOENT")
    )
    tests = (
        F.when(fn.isin("open@SYS", "stat@SYS"), missing)
        .when(fn == "execve@SYS", ret.contains("ENOENT"))
        .when(fn.isin("ioctl@SYS", "fstat@SYS"), ret.contains("EBADF"))
        .when(fn == "read@SYS", ret.try_cast("long").isNull())
    )
    if calls_have_args:
        flags = F.coalesce(F.get("args", F.lit(3)), F.lit(""))
        no_file = flags.contains("MAP_ANONYMOUS")
        tests = tests.when(
            fn == "mmap@SYS", no_file | F.coalesce(F.get("args", F.lit(4)) == "-1", F.lit(False))
        ).when(fn == "mmap2@SYS", no_file)
    return done & F.coalesce(tests, F.lit(False))


def drop_failed(calls: DataFrame) -> DataFrame:
    return calls.where(~failed("args" in calls.columns))


def created_pid(ret: Column, tracer: Column) -> Column:
    """Process id a call returned: hexadecimal with ltrace, decimal with strace."""
    hexed = F.conv(F.regexp_replace(ret, "^0x", ""), 16, 10).try_cast("long")
    first = F.substring_index(F.trim(ret), " ", 1).try_cast("long")
    return F.when(tracer == "ltrace", hexed).otherwise(first)


def normalise_pids(calls: DataFrame) -> DataFrame:
    """Add ``new_pid``, ``is_thread`` and ``waited_pid``."""
    ret, tracer = F.col("ret"), F.col("tracer")
    pid = created_pid(ret, tracer)
    creates = F.col("fn").isin("clone@SYS", "vfork@SYS")
    thread = F.when(tracer == "ltrace", True).otherwise(
        F.coalesce(F.get("args", F.lit(1)).contains("CLONE_VM"), F.lit(False))
    )
    no_child = F.when(tracer == "ltrace", ret.contains("-10")).otherwise(ret.contains("ECHILD"))
    return calls.withColumns(
        {
            "new_pid": F.when(creates & (pid > 0), pid),
            "is_thread": F.when(F.col("fn") == "clone@SYS", thread),
            "waited_pid": F.when((F.col("fn") == "wait4@SYS") & ~no_child & (pid > 0), pid),
        }
    )


def open_fds(calls: DataFrame, scope: str = "process") -> DataFrame:
    """Add ``fd_path``: the path last opened under the call's descriptor.

    For logs that print bare descriptors. ``scope='global'`` shares descriptors
    between the processes of a session.
    """
    opens = F.col("fn").isin("open@SYS", "openat@SYS")
    path = F.when(F.col("fn") == "open@SYS", F.get("args", F.lit(0))).when(
        F.col("fn") == "openat@SYS", F.get("args", F.lit(1))
    )
    descriptor = F.when(opens, F.col("ret")).otherwise(F.get("args", F.lit(0)))
    with_fd = calls.withColumn("_fd", F.coalesce(descriptor, F.lit("")))
    keys = (FLOW if scope == "process" else ["session"]) + ["_fd"]
    return scan(with_fd, keys, last_before={"fd_path": path}).drop("_fd")


def track_cwd(calls: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Add ``cwd``: the process's current directory when the call was made.

    A process starts in the directory its parent had when creating it; the top
    process in the one of its session.
    """
    change = F.when(F.col("fn") == "fchdir@SYS", fd_to_path(F.get("args", F.lit(0))))
    own = scan(calls, FLOW, last_before={"_own": change})
    created = normalise_pids(own).where("new_pid is not null")
    start = created.groupBy("session", F.col("new_pid").alias("pid")).agg(
        F.min_by(F.struct("_own", "pid"), "seq").alias("c"), F.min("seq").alias("at")
    )
    # base: directory known at the start; up: the process to ask when it is not; at: when
    # the one asked was created. Links go back in time only: a process whose number
    # was used before it was created asks no further, so the rounds end.
    known = cut(
        start.select(
            "session",
            "pid",
            F.col("c._own").alias("base"),
            F.when(F.col("c._own").isNull(), F.col("c.pid")).alias("up"),
            "at",
        )
    )
    while not known.where("up is not null").isEmpty():
        above = known.select(
            "session",
            F.col("pid").alias("up"),
            F.col("base").alias("_base"),
            F.col("up").alias("_up"),
            F.col("at").alias("_at"),
        )
        before = F.coalesce(F.col("_at") < F.col("at"), F.lit(False))
        base = F.coalesce("base", F.when(before, F.col("_base")))
        step = known.join(above, ["session", "up"], "left").select(
            "session",
            "pid",
            base.alias("base"),
            # A parent nobody created is a top process: it starts in the session's.
            F.when(before & base.isNull(), F.col("_up")).alias("up"),
            F.when(before, F.col("_at")).otherwise(F.col("at")).alias("at"),
        )
        known = cut(step)
    out = own.join(known.select("session", "pid", "base"), ["session", "pid"], "left")
    cwd = F.coalesce("_own", "base")
    if sessions is not None:
        out = out.join(
            sessions.select("session", F.col("cwd").alias("_top")), "session", "left"
        )
        cwd = F.coalesce("_own", "base", "_top")
    return out.select(*calls.columns, cwd.alias("cwd"))


def significant_args(calls: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``sig``: what the call touches, by the rule of its function.

    ``fd_path`` (open_fds) and ``cwd`` (track_cwd) are used when present.
    """
    has = set(calls.columns)
    in_force = F.col("fd_path") if "fd_path" in has else None
    cwd = F.coalesce(F.col("cwd"), F.lit("")) if "cwd" in has else F.lit("")
    kind = kind_of(F.col("fn"), rules)
    strace = F.col("tracer") != "ltrace"
    ret = F.coalesce(F.col("ret"), F.lit(""))

    def arg(n: int) -> Column:
        return F.coalesce(F.get("args", F.lit(n)), F.lit(""))

    def listed(n: int) -> Column:
        return F.coalesce(F.from_json(arg(n), "array<string>"), F.array().cast("array<string>"))

    def paths(fds: Column) -> Column:
        return F.transform(fds, lambda x: fd_to_path(x))

    at_dir = F.when(arg(0) == "AT_FDCWD", cwd).otherwise(fd_to_path(arg(0)))
    pid = created_pid(ret, F.col("tracer")).cast("string")
    groups = F.coalesce(
        F.from_json(arg(0), "array<array<string>>"), F.array().cast("array<array<string>>")
    )
    polled = F.transform(
        F.flatten(groups), lambda e: F.when(e.startswith("fd="), F.substr(e, F.lit(4)))
    )
    selected = F.flatten(
        F.transform(
            F.concat(listed(1), listed(2), listed(3)), lambda e: F.split(e, " ")
        )
    )
    empty = F.array().cast("array<string>")
    stream = fd_to_path(arg(0), in_force)
    sig = (
        F.when(F.col("status").isin("unfinished", "matched"), F.col("args"))
        .when((F.col("status") == "resumed") & ~F.col("fn").isin(RESUMED_OK), F.col("args"))
        .when(kind == "stream", F.array(stream))
        .when(kind == "map", F.array(fd_to_path(arg(4))))
        .when(kind == "path", F.array(arg(0)))
        .when(kind == "open", F.array(F.when(strace, fd_to_path(ret)).otherwise(arg(0))))
        .when(
            kind == "openat",
            F.array(F.when(strace, fd_to_path(ret)).otherwise(normalise_path(arg(1), at_dir))),
        )
        .when(kind == "at", F.array(normalise_path(arg(1), at_dir)))
        .when(kind == "result", F.array(fd_to_path(ret)))
        .when(kind == "dup", F.array(stream, fd_to_path(ret)))
        .when(kind == "pair", paths(F.slice(listed(0), 1, 2)))
        .when(kind == "create", F.array(pid))
        .when(kind == "wait", F.when(pid.isNotNull(), F.array(pid)).otherwise(empty))
        .when(kind == "execute", F.when(strace, F.array(arg(0), arg(1))).otherwise(F.array(arg(0))))
        .when(kind == "main", F.array(F.get(listed(0), F.lit(0)), arg(0)))
        .when(kind == "poll", F.when(strace, paths(F.array_compact(polled))).otherwise(empty))
        .when(kind == "select", F.when(strace, paths(selected)).otherwise(empty))
        .when(kind == "return", F.array(ret))
        .when(kind == "getenv", F.array(arg(0)))
        .when(kind == "nothing", empty)
        .otherwise(F.col("args"))
    )
    return calls.withColumn("sig", sig)


def match_interrupted(calls: DataFrame) -> DataFrame:
    """Join unfinished calls with their resumption, last in first out per process
    and function.

    Adds ``partner_seq``. An unfinished call that is resumed becomes ``matched``;
    its resumption becomes ``merged`` and carries the arguments of both.
    """
    two_halves = F.col("status").isin("unfinished", "resumed") & ~(
        (F.col("status") == "unfinished") & F.col("fn").isin(UNFINISHED_OK)
    )
    opens = F.col("status") == "unfinished"
    halves = calls.where(two_halves)
    rest = calls.where(~two_halves).withColumn("partner_seq", F.lit(None).cast("long"))
    keys = [*FLOW, "fn"]
    step = F.when(opens, 1).otherwise(-1)
    deep = scan(halves, keys, depth={"_depth": step})
    # At one level of nesting, halves alternate: each resumption follows its call.
    level = F.when(opens, F.col("_depth")).otherwise(F.col("_depth_before"))
    levelled = cut(deep.withColumn("_level", level).drop("_depth", "_depth_before"))
    alone = levelled.where("_level = 0").withColumn("partner_seq", F.lit(None).cast("long"))
    args = F.col("args") if "args" in calls.columns else F.col("args_text")
    paired = scan(
        levelled.where("_level > 0"),
        [*keys, "_level"],
        previous={"_call": F.struct(F.col("seq").alias("seq"), args.alias("args"))},
        following={"_resume": F.col("seq")},
    )
    name = "args" if "args" in calls.columns else "args_text"
    joined = (
        F.concat(F.col("_call.args"), args)
        if name == "args"
        else F.concat_ws(", ", F.col("_call.args"), args)
    )
    paired = paired.withColumns(
        {
            "partner_seq": F.when(opens, F.col("_resume")).otherwise(F.col("_call.seq")),
            name: F.when(~opens, joined).otherwise(args),
            "status": F.when(~opens, F.lit("merged"))
            .when(F.col("_resume").isNotNull(), "matched")
            .otherwise(F.col("status")),
        }
    )
    columns = [*calls.columns, "partner_seq"]
    return (
        rest.select(*columns)
        .unionByName(alone.select(*columns))
        .unionByName(paired.select(*columns))
    )


def drop_adjacent_matched(calls: DataFrame) -> DataFrame:
    """Without the unfinished halves whose resumption is the next call of the flow."""
    nxt = scan(calls, FLOW, following={"_next": F.col("seq")})
    gone = (F.col("status") == "matched") & F.col("_next").eqNullSafe(F.col("partner_seq"))
    return nxt.where(~gone).drop("_next")


def unmatched(calls: DataFrame) -> DataFrame:
    """Unfinished calls nobody resumed, of a table ``match_interrupted`` returned."""
    return calls.where(
        (F.col("status") == "unfinished") & ~F.col("fn").isin(UNFINISHED_OK)
    )


def flow_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy(*FLOW).agg(F.count(F.lit(1)).alias("calls"))
