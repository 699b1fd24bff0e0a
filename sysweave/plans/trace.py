"""Reading of logs, and what calls, flows, processes and files tell."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sysweave.functions import paths
from sysweave.operators import calls as c
from sysweave.operators import flows as f
from sysweave.operators import objects as ob
from sysweave.operators import ordered
from sysweave.operators import shapes
from sysweave.operators import traverse as t
from sysweave.plans import views as v
from sysweave.plans.registry import query
from sysweave.session import cut
from sysweave.sources import trace as tr

def micros(*names):
    """Instants as whole microseconds."""
    return [F.unix_micros(n).alias(n) for n in names]


CALLS = "with " + v.CALLS_SQL
FLOW = "with " + v.FLOW_SQL


@query(
    "s1_parse_strace",
    CALLS + "select session, seq, pid, fn, ret, t_start, 0.00001::double dur, 'plain' status from calls",
)
def parse_strace(spark, sf):
    calls = tr.parse_lines(v.trace_lines(spark, sf))
    return calls.select("session", "seq", "pid", "fn", "ret", "t_start", "dur", "status")


@query(
    "s2_parse_ltrace",
    """select event_id seq, user_id pid, case event_type when 'signup' then 'signup@SYS' when 'click' then 'click@SYS'
      when 'view' then 'view' when 'error' then 'error@SYS' else 'purchase@SYS' end fn,
    case when event_type='error' then 'resumed' when event_type='purchase' then 'unfinished' else 'plain' end status,
    case when event_type<>'purchase' then '0x'||k end ret
    from (select *, regexp_extract(props, '([0-9]+)', 1) k from events)""",
)
def parse_ltrace(spark, sf):
    e = v.events(spark, sf)
    k = F.col("k").cast("string")
    kind = F.col("event_type")
    call = (
        F.when(kind == "signup", F.concat(F.lit("SYS_signup("), k, F.lit(") = 0x"), k))
        .when(kind == "click", F.concat(F.lit("click@SYS("), k, F.lit(") = 0x"), k))
        .when(kind == "view", F.concat(F.lit('lib.so.1->view("'), k, F.lit('") = 0x'), k))
        .when(kind == "error", F.concat(F.lit("<... error resumed> , "), k, F.lit(") = 0x"), k))
        .otherwise(F.concat(F.lit("purchase@SYS("), k, F.lit(" <unfinished ...>")))
    )
    end = F.when(kind == "purchase", "").otherwise(" <0.000100>")
    line = F.concat(
        F.lit("[pid "), F.col("user_id").cast("string"), F.lit("] "), v.stamp(F.col("ts")), F.lit(" "),
        call, end,
    )
    lines = e.select(F.lit("l").alias("session"), F.col("event_id").alias("seq"), line.alias("line"))
    return tr.parse_lines(lines, "ltrace").select("seq", "pid", "fn", "status", "ret")


@query("s3_parse_pydbg", "select event_id seq, user_id pid, event_type fn from events")
def parse_pydbg(spark, sf):
    e = v.events(spark, sf)
    lines = e.select(
        F.lit("w").alias("session"),
        F.col("event_id").alias("seq"),
        F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("line"),
    )
    return tr.parse_lines(lines, "pydbg").select("seq", "pid", "fn")


@query(
    "s4_stitch_lines",
    """with e as (select *, case when event_type in ('view','purchase') then 1 else 0 end fin from events),
    r as (select *, coalesce(sum(fin) over (order by event_id rows between unbounded preceding and 1 preceding), 0) rec from e)
    select min(event_id) seq, count(*) n, string_agg('p'||event_id||case when fin=1 then ' <0.5>' else '' end, chr(10) order by event_id) line
    from r group by rec""",
)
def stitch_lines(spark, sf):
    e = v.events(spark, sf)
    ends = F.col("event_type").isin("view", "purchase")
    lines = e.select(
        F.lit("x").alias("session"),
        F.col("event_id").alias("seq"),
        F.concat(
            F.lit("p"), F.col("event_id").cast("string"), F.when(ends, " <0.5>").otherwise("")
        ).alias("line"),
    )
    out = tr.stitch_lines(lines)
    return out.select("seq", F.size(F.split("line", "\n")).cast("long").alias("n"), "line")


@query(
    "s5_session_rows",
    """select 'c'||c_custkey as session, c_custkey top_pid, '/home/'||c_name cwd, '2020-05-17' as date,
    c_mktsegment host, 'linux' os from customer""",
)
def session_rows(spark, sf):
    cu = v.table(spark, sf, "customer")
    lines = cu.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session"),
        F.explode(
            F.array(
                F.concat(F.lit("TopProcessId="), F.col("c_custkey").cast("string")),
                F.concat(F.lit("CurrentDirectory=/home/"), "c_name"),
                F.lit("CurrentDate=2020-05-17"),
                F.lit("; a comment=1"),
                F.concat(F.lit("CurrentHostname="), "c_mktsegment"),
                F.lit("CurrentOSType=linux"),
            )
        ).alias("line"),
    )
    keys = ["TopProcessId", "CurrentDirectory", "CurrentDate", "CurrentHostname", "CurrentOSType"]
    return tr.session_rows(lines, keys).withColumn("date", F.col("date").cast("string"))


@query(
    "s5_with_dates",
    """with e as (select event_id, user_id%4 g, strftime(ts, '%H:%M:%S.%f') t,
      epoch_us(ts) - epoch_us(date_trunc('day', ts)) us from events),
    j as (select *, case when lag(us) over (partition by g order by event_id) - us > 43200000000 then 1 else 0 end jump from e)
    select event_id seq, strftime(date '2020-05-17' + cast(sum(jump) over (partition by g order by event_id rows unbounded preceding) as integer),
      '%Y-%m-%d')||' '||t stamp from j""",
)
def with_dates(spark, sf):
    e = v.events(spark, sf)
    group = (F.col("user_id") % 4).cast("string")
    calls = e.select(
        group.alias("session"), F.col("event_id").alias("seq"), v.stamp(F.col("ts")).alias("t_start")
    )
    sessions = e.select(group.alias("session"), F.lit("2020-05-17").cast("date").alias("date")).distinct()
    dated = tr.with_dates(calls, sessions)
    return dated.select("seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"))


# The arguments of the calls of the log, put together.
ARGS_TEXT = r"""case fn
      when 'openat@SYS' then 'AT_FDCWD;data/f'||k||';O_RDONLY|O_CLOEXEC'
      when 'open@SYS' then '/out/f'||k||';O_WRONLY|O_CREAT;0666'
      when 'read@SYS' then '3</srv/data/f'||k||'>;x, \"y\;4096'
      when 'write@SYS' then '4</out/f'||k||'>;z...;512'
      when 'close@SYS' then '3</srv/data/f'||k||'>'
      when 'wait4@SYS' then '-1;[["WIFEXITED(s)"]];0;NULL'
      when 'clone@SYS' then 'child_stack=0;flags=CLONE_VM|SIGCHLD'
      when 'execve@SYS' then '/usr/bin/python'||k||';["python", "run'||k||'.py"];["/* 22 vars */"]'
      when 'stat@SYS' then '/missing;0x7ffe' else 'NULL' end"""


@query(
    "t1_split_args",
    CALLS
    + "select seq, " + ARGS_TEXT + " as args from calls",
)
def split_args(spark, sf):
    return v.trace_calls(spark, sf).select("seq", F.array_join("args", ";").alias("args"))


@query("t2_drop_ignored", CALLS + "select seq, fn from calls where fn <> 'brk@SYS'")
def drop_ignored(spark, sf):
    return c.drop_ignored(tr.parse_lines(v.trace_lines(spark, sf))).select("seq", "fn")


@query("t3_drop_failed", CALLS + "select seq, fn from calls where fn <> 'stat@SYS'")
def drop_failed(spark, sf):
    return c.drop_failed(tr.parse_lines(v.trace_lines(spark, sf))).select("seq", "fn")


@query(
    "t4_significant_args",
    CALLS
    + """select seq, fn, case when fn in ('clone@SYS','wait4@SYS') then cast(other_pid as varchar)
      when fn='execve@SYS' then '/usr/bin/python'||k||';["python", "run'||k||'.py"]'
      when fn='brk@SYS' then 'NULL' else path end sig from calls""",
)
def significant_args(spark, sf):
    named = c.significant_args(v.trace_calls(spark, sf))
    return named.select("seq", "fn", F.array_join("sig", ";").alias("sig"))


#: (tracer, function, status, return, fourth and fifth argument) of calls that did or did not fail.
OUTCOMES = [
    ("strace", "open@SYS", "plain", "-1 ENOENT (No such file or directory)", "", ""),
    ("strace", "open@SYS", "plain", "3", "", ""),
    ("ltrace", "open@SYS", "plain", "-2", "", ""),
    ("ltrace", "open@SYS", "plain", "ENOENT", "", ""),
    ("strace", "stat@SYS", "plain", "-1 ENOENT (No such file or directory)", "", ""),
    ("strace", "stat@SYS", "plain", "-1 EACCES (Permission denied)", "", ""),
    ("ltrace", "stat@SYS", "plain", "-2", "", ""),
    ("strace", "execve@SYS", "plain", "-1 ENOENT (No such file or directory)", "", ""),
    ("ltrace", "execve@SYS", "plain", "-2", "", ""),
    ("strace", "ioctl@SYS", "plain", "-1 EBADF (Bad file descriptor)", "", ""),
    ("strace", "ioctl@SYS", "plain", "-1 ENOTTY", "", ""),
    ("strace", "fstat@SYS", "plain", "-1 EBADF (Bad file descriptor)", "", ""),
    ("strace", "read@SYS", "plain", "-1 EAGAIN", "", ""),
    ("strace", "read@SYS", "plain", "12", "", ""),
    ("strace", "mmap@SYS", "plain", "0x7f", "MAP_PRIVATE|MAP_ANONYMOUS", "3</lib/c.so>"),
    ("strace", "mmap@SYS", "plain", "0x7f", "MAP_PRIVATE", "-1"),
    ("strace", "mmap@SYS", "plain", "0x7f", "MAP_PRIVATE", "3</lib/c.so>"),
    ("strace", "mmap2@SYS", "plain", "0x7f", "MAP_PRIVATE|MAP_ANONYMOUS", "3</lib/c.so>"),
    ("strace", "mmap2@SYS", "plain", "0x7f", "MAP_PRIVATE", "-1"),
    ("strace", "read@SYS", "unfinished", None, "", ""),
    ("strace", "open@SYS", "resumed", "-1 ENOENT (No such file or directory)", "", ""),
    ("strace", "open@SYS", "merged", "-1 ENOENT (No such file or directory)", "", ""),
    ("strace", "openat@SYS", "plain", "-1 ENOENT (No such file or directory)", "", ""),
    ("strace", "read@SYS", "plain", None, "", ""),
    ("strace", "read@SYS", "matched", "-1 EAGAIN", "", ""),
]


@query(
    "t3_drop_failed_rules",
    """select event_id seq, event_id % 25 kind from events where event_id % 25 in (1, 3, 5, 8, 10, 13, 16, 18, 19, 20, 22, 24)""",
)
def drop_failed_rules(spark, sf):
    """Every rule of failed calls, met and just not met, of both tracers and of halves."""
    names = ["tracer", "fn", "status", "ret", "a", "b"]
    cases = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(names, case)]) for case in OUTCOMES])
    kind = (F.col("event_id") % len(OUTCOMES)).alias("kind")
    calls = v.events(spark, sf).select(F.col("event_id").alias("seq"), kind).withColumn("c", F.get(cases, F.col("kind")))
    none = F.lit("")
    calls = calls.select("seq", "kind", "c.*").withColumn("args", F.array(none, none, none, F.col("a"), F.col("b")))
    return c.drop_failed(calls).select("seq", "kind")


#: (tracer, function, status, arguments, return) of calls on the objects numbered K.
TOUCHING = [
    ("strace", "read@SYS", "plain", ["3</d/fK>", "x", "1"], "1"),
    ("strace", "mmap@SYS", "plain", ["NULL", "4096", "PROT_READ", "MAP_PRIVATE", "3</lib/lK.so>"], "0x7f"),
    ("strace", "stat@SYS", "plain", ["/d/fK"], "0"),
    ("strace", "open@SYS", "plain", ["fK"], "3</o/fK>"),
    ("ltrace", "open@SYS", "plain", ["/l/fK"], "3"),
    ("strace", "openat@SYS", "plain", ["AT_FDCWD", "fK"], "4</o/fK>"),
    ("ltrace", "openat@SYS", "plain", ["3</d>", "fK"], "4"),
    ("strace", "newfstatat@SYS", "plain", ["5</d>", "e/../fK"], "0"),
    ("strace", "socket@SYS", "plain", ["AF_INET"], "5<TCP:[K]>"),
    ("strace", "dup@SYS", "plain", ["3</d/fK>"], "4</d/gK>"),
    ("strace", "pipe@SYS", "plain", ['["3<pipe:[K]>", "4<pipe:[K]>"]'], "0"),
    ("strace", "clone@SYS", "plain", ["child_stack=NULL"], "1K"),
    ("ltrace", "clone@SYS", "plain", ["0"], "0x1f"),
    ("strace", "wait4@SYS", "plain", ["-1"], "1K"),
    ("strace", "wait4@SYS", "plain", ["-1"], "? ERESTARTSYS"),
    ("strace", "execve@SYS", "plain", ["/bin/pK", '["p", "K"]', "env"], "0"),
    ("ltrace", "execve@SYS", "plain", ["/bin/pK", "0x5", "0x6"], "0"),
    ("ltrace", "__libc_start_main", "plain", ['["pK", "a"]', "2"], None),
    ("strace", "poll@SYS", "plain", ['[["fd=3<TCP:[K]>", "events=POLLIN"], ["fd=4</d/fK>", "events=POLLOUT"]]'], "1"),
    ("ltrace", "poll@SYS", "plain", ["0x5", "1"], "1"),
    ("strace", "select@SYS", "plain", ["6", '["3</d/fK> 5</d/gK>"]', "[]", '["5</d/hK>"]'], "1"),
    ("strace", "setsockopt@SYS", "plain", ["5<TCP:[K]>"], "0"),
    ("ltrace", "getenv", "plain", ["VAR_K"], "x"),
    ("strace", "munmap@SYS", "plain", ["0x7f", "4096"], "0"),
    ("strace", "read@SYS", "unfinished", ["3</d/fK>"], None),
    ("strace", "read@SYS", "resumed", ["yK", "2"], "2"),
    ("strace", "vfork@SYS", "resumed", ["z"], "1K"),
    ("strace", "unknown", "plain", ["aK", "b"], "0"),
]


@query(
    "t4_significant_args_kinds",
    """select event_id seq, n, case n when 0 then '/d/f'||k when 1 then '/lib/l'||k||'.so' when 2 then '/d/f'||k
      when 3 then '/o/f'||k when 4 then '/l/f'||k when 5 then '/o/f'||k when 6 then '/d/f'||k when 7 then '/d/f'||k
      when 8 then 'TCP:['||k||']' when 9 then '/d/f'||k||';/d/g'||k when 10 then 'pipe:['||k||'];pipe:['||k||']'
      when 11 then '1'||k when 12 then '31' when 13 then '1'||k when 14 then ''
      when 15 then '/bin/p'||k||';["p", "'||k||'"]' when 16 then '/bin/p'||k when 17 then 'p'||k||';["p'||k||'", "a"]'
      when 18 then 'TCP:['||k||'];/d/f'||k when 19 then '' when 20 then '/d/f'||k||';/d/g'||k||';/d/h'||k
      when 21 then '0' when 22 then 'VAR_'||k when 23 then '' when 24 then '3</d/f'||k||'>' when 25 then 'y'||k||';2'
      when 26 then '1'||k else 'a'||k||';b' end sig
    from (select event_id, event_id % 28 n, cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as varchar) k from events)""",
)
def significant_args_kinds(spark, sf):
    """Every kind of extraction, of both tracers where they differ, and of halves."""
    names = ["tracer", "fn", "status"]
    cases = F.array(
        *[
            F.struct(
                *[F.lit(x).alias(n) for n, x in zip(names, case)],
                F.array(*[F.lit(a) for a in case[3]]).alias("args"),
                F.lit(case[4]).cast("string").alias("ret"),
            )
            for case in TOUCHING
        ]
    )
    e = v.events(spark, sf).select(F.col("event_id").alias("seq"), (F.col("event_id") % len(TOUCHING)).alias("n"), "k")
    calls = e.withColumn("c", F.get(cases, F.col("n"))).select("seq", "n", "k", "c.*")
    number = F.col("k").cast("string")
    calls = calls.withColumns(
        {
            "args": F.transform("args", lambda a: F.regexp_replace(a, F.lit("K"), number)),
            "ret": F.regexp_replace("ret", F.lit("K"), number),
        }
    )
    return c.significant_args(calls).select("seq", "n", F.array_join("sig", ";").alias("sig"))


@query(
    "u2_added_call_model",
    CALLS
    + """select seq, fn, case when fn in ('clone@SYS','wait4@SYS') then cast(other_pid as varchar)
      when fn='execve@SYS' then '/usr/bin/python'||k||';["python", "run'||k||'.py"]'
      when fn='brk@SYS' then '' else path end sig from calls""",
)
def added_call_model(spark, sf):
    """A rule of one's own: ``brk`` touches nothing."""
    named = c.significant_args(v.trace_calls(spark, sf), {"brk@SYS": "nothing"})
    return named.select("seq", "fn", F.array_join("sig", ";").alias("sig"))


@query(
    "t5_normalise_pids",
    CALLS
    + """select seq, case when fn='clone@SYS' then other_pid end new_pid, case when fn='clone@SYS' then true end is_thread,
    case when fn='wait4@SYS' then other_pid end waited_pid from calls""",
)
def normalise_pids(spark, sf):
    return c.normalise_pids(v.trace_calls(spark, sf)).select("seq", "new_pid", "is_thread", "waited_pid")


def bare_fd_calls(spark, sf):
    """Signups open a descriptor of five, the others read it, as a tracer without paths prints."""
    e = v.events(spark, sf)
    k = F.col("k")
    fd = (k % 5 + 3).cast("string")
    opens = F.col("event_type") == "signup"
    path = F.concat(F.lit("/data/f"), k.cast("string"))
    return e.select(
        F.lit("fds").alias("session"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("pid"),
        F.when(opens, "open@SYS").otherwise("read@SYS").alias("fn"),
        F.when(opens, F.array(path, F.lit("0"))).otherwise(F.array(fd, F.lit("0x1"))).alias("args"),
        F.when(opens, fd).otherwise("10").alias("ret"),
        F.lit("ltrace").alias("tracer"),
        F.lit("plain").alias("status"),
    )


@query(
    "t6_open_fds",
    """with e as (select event_id seq, user_id pid, event_type, k, k%5+3 fd,
      case when event_type='signup' then '/data/f'||k end opened
      from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events))
    select seq, pid, last_value(opened ignore nulls) over (partition by pid, fd order by seq
      rows between unbounded preceding and 1 preceding) fd_path from e""",
)
def open_fds(spark, sf):
    return c.open_fds(bare_fd_calls(spark, sf)).select("seq", "pid", "fd_path")


@query(
    "c10_fd_to_path",
    """with e as (select event_id seq, user_id pid, event_type, k%5+3 fd,
      case when event_type='signup' then '/data/f'||k end opened
      from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)),
    w as (select *, last_value(opened ignore nulls) over (partition by fd order by seq
      rows between unbounded preceding and 1 preceding) p from e)
    select seq, coalesce(p, 'UnknownFileDescr:'||fd) path from w where event_type<>'signup'""",
)
def fd_paths(spark, sf):
    known = c.open_fds(bare_fd_calls(spark, sf), scope="global").where("fn = 'read@SYS'")
    fd = F.get("args", F.lit(0))
    return known.select("seq", paths.fd_to_path(fd, F.col("fd_path")).alias("path"))


@query(
    "t7_track_cwd",
    """with e as (select event_id seq, user_id pid, event_type, case when event_type='signup' then '/home/d'||k end d
      from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)),
    o as (select *, last_value(d ignore nulls) over (partition by pid order by seq rows between unbounded preceding and 1 preceding) own from e),
    child as (select 1000000 + seq pid, seq, own, pid as up from o where event_type='error')
    select seq, pid, coalesce(own, '/top') cwd from o union all
    select 10000000 + seq, pid, coalesce(own, '/top') from child""",
)
def track_cwd(spark, sf):
    e = v.events(spark, sf)
    seq, pid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    fd = F.concat(F.lit("3</home/d"), F.col("k").cast("string"), F.lit(">"))
    group = (pid % 4).cast("string")
    parent = F.struct(
        group.alias("session"), seq.alias("seq"), pid.alias("pid"),
        F.when(kind == "signup", "fchdir@SYS").when(kind == "error", "clone@SYS").otherwise("read@SYS").alias("fn"),
        F.array(fd, F.lit("")).alias("args"),
        F.when(kind == "error", (seq + 1000000).cast("string")).otherwise("0").alias("ret"),
    )
    # Each created process makes one call of its own.
    child = F.struct(
        group.alias("session"), (seq + 10000000).alias("seq"), (seq + 1000000).alias("pid"), F.lit("read@SYS").alias("fn"),
        F.array(F.lit("1"), F.lit("")).alias("args"), F.lit("0").alias("ret"),
    )
    both = F.when(kind == "error", F.array(parent, child)).otherwise(F.array(parent))
    calls = e.select(F.explode(both).alias("x")).select(
        "x.*", F.lit("strace").alias("tracer"), F.lit("plain").alias("status")
    )
    sessions = e.select(group.alias("session"), F.lit("/top").alias("cwd")).distinct()
    return c.track_cwd(calls, sessions).select("seq", "pid", "cwd")


CREATOR = """s{n} as (select s.pid, case when s.base<>'' then s.base when m.since < s.since then m.base else '' end base,
      case when s.base='' and m.since < s.since and m.base='' then m.up end up,
      case when m.since < s.since then m.since else s.since end since from s{p} s left join s0 m on m.pid=s.up),
"""


@query(
    "t7_track_cwd_reused_pids",
    """with e as (select event_id seq, user_id pid, event_type,
      case when event_type='signup' then '/home/d'||regexp_extract(props, '([0-9]+)', 1) end d from events),
    o as (select *, last_value(d ignore nulls) over (partition by pid order by seq rows between unbounded preceding and 1 preceding) own from e),
    s0 as (select pid%100+1 pid, min(seq) since, min_by(pid, seq) up, coalesce(min_by(coalesce(own, ''), seq), '') base from o
      where event_type='error' group by 1),
"""
    + "".join(CREATOR.format(n=n, p=n - 1) for n in range(1, 13)).rstrip(",\n")
    + """
    select seq, o.pid, coalesce(own, nullif(base, ''), '/top') cwd from o left join s12 using (pid)""",
)
def track_cwd_reused(spark, sf):
    """Each process creates the next of a hundred numbers, so that numbers create each other in a ring."""
    e = v.events(spark, sf)
    kind = F.col("event_type")
    fd = F.concat(F.lit("3</home/d"), F.col("k").cast("string"), F.lit(">"))
    calls = e.select(
        F.lit("ring").alias("session"), F.col("event_id").alias("seq"), F.col("user_id").alias("pid"),
        F.when(kind == "signup", "fchdir@SYS").when(kind == "error", "clone@SYS").otherwise("read@SYS").alias("fn"),
        F.array(fd, F.lit("")).alias("args"),
        F.when(kind == "error", (F.col("user_id") % 100 + 1).cast("string")).otherwise("0").alias("ret"),
        F.lit("strace").alias("tracer"), F.lit("plain").alias("status"),
    )
    sessions = e.select(F.lit("ring").alias("session"), F.lit("/top").alias("cwd")).distinct()
    return c.track_cwd(calls, sessions).select("seq", "pid", "cwd")


@query("t8_flow_counts", "select user_id pid, count(*) calls from events group by 1")
def flow_counts(spark, sf):
    return c.flow_counts(v.flow_calls(spark, sf)).select("pid", "calls")


# Nesting levels as plain windows; a click opens, a purchase closes.
HALVES = """with h as (select event_id seq, user_id pid, regexp_extract(props, '([0-9]+)', 1) k,
   case event_type when 'click' then 1 else -1 end d from events where event_type in ('click','purchase')),
 a as (select *, sum(d) over (partition by pid order by seq rows unbounded preceding) r from h),
 b as (select *, r - least(0, min(r) over (partition by pid order by seq rows unbounded preceding)) depth from a),
 l as (select *, coalesce(lag(depth) over (partition by pid order by seq), 0) before from b),
 n as (select *, case when d=1 then depth else before end lev from l),
 m as (select *, lag(seq) over w ps, lag(k) over w pk, lead(seq) over w ns from n where lev>0
   window w as (partition by pid, lev order by seq))
"""


@query(
    "t9_match_interrupted",
    HALVES
    + """select seq, pid, case when d=1 then ns else ps end partner_seq,
      case when d=-1 then 'merged' when ns is not null then 'matched' else 'unfinished' end status,
      case when d=-1 then pk||','||k else k end args from m
    union all select seq, pid, null, 'resumed', k from n where lev=0
    union all select event_id, user_id, null, 'plain', regexp_extract(props, '([0-9]+)', 1) from events
      where event_type not in ('click','purchase')""",
)
def match_interrupted(spark, sf):
    joined = c.match_interrupted(v.interrupted_calls(spark, sf))
    return joined.select("seq", "pid", "partner_seq", "status", F.array_join("args", ",").alias("args"))


GAPS = "seq * 1000000000 + seq * seq % 999999937"


@query(
    "t9_match_interrupted_gaps",
    HALVES
    + f""", r as (select event_id, row_number() over (order by event_id) - 1 i from events),
    t as (select seq, pid, case when d=1 then ns else ps end partner,
      case when d=-1 then 'merged' when ns is not null then 'matched' else 'unfinished' end status from m
     union all select seq, pid, null, 'resumed' from n where lev=0
     union all select event_id, user_id, null, 'plain' from events where event_type not in ('click','purchase'))
    select r.i seq, {GAPS} given, pid, p.i partner_seq, status
    from t join r on r.event_id = seq left join r p on p.event_id = partner""",
)
def match_interrupted_gaps(spark, sf):
    """Numbers with wide, uneven gaps, counted anew before halves are joined."""
    calls = v.interrupted_calls(spark, sf).withColumn("seq", F.expr(GAPS))
    joined = c.match_interrupted(ordered.numbered(calls, ["session"], was="given"))
    return joined.select("seq", "given", "pid", "partner_seq", "status")


@query(
    "t12_squeeze_repeats_gaps",
    FLOW
    + f""", g as (select *, row_number() over (order by seq) - 1 rank from flow),
    a as (select *, case when full_sig = lag(full_sig) over (partition by pid order by seq) then 0 else 1 end st from g),
    b as (select *, sum(st) over (partition by pid order by seq rows unbounded preceding) i from a)
    select pid, min(rank) seq, min(fn) fn, min(sig) sig, count(*) occurrences from b group by pid, i""",
)
def squeeze_repeats_gaps(spark, sf):
    calls = v.flow_calls(spark, sf).withColumn("seq", F.expr(GAPS))
    runs = f.squeeze_repeats(ordered.numbered(calls, ["session"]))
    return runs.select("pid", "seq", "fn", F.array_join("sig", "&").alias("sig"), "occurrences")


@query(
    "t10_drop_adjacent_matched",
    HALVES
    + """, e as (select event_id seq, user_id pid, lead(event_id) over (partition by user_id order by event_id) nx from events)
    select e.seq, e.pid from e left join m on m.seq=e.seq where not (m.d is not null and m.d=1 and m.ns is not null and m.ns=e.nx)""",
)
def drop_adjacent_matched(spark, sf):
    joined = c.match_interrupted(v.interrupted_calls(spark, sf))
    return c.drop_adjacent_matched(joined).select("seq", "pid")


@query(
    "t11_unmatched",
    HALVES + "select seq, pid, 'read@SYS' fn from m where d=1 and ns is null",
)
def unmatched(spark, sf):
    joined = c.match_interrupted(v.interrupted_calls(spark, sf))
    return c.unmatched(joined).select("seq", "pid", "fn")


@query(
    "t12_squeeze_repeats",
    FLOW
    + """, a as (select *, case when full_sig = lag(full_sig) over (partition by pid order by seq) then 0 else 1 end st from flow),
    b as (select *, sum(st) over (partition by pid order by seq rows unbounded preceding) i from a)
    select pid, min(seq) seq, min(fn) fn, min(sig) sig, epoch_us(min(t_start)) t_start, epoch_us(max(t_start)) t_end,
    count(*) occurrences from b group by pid, i""",
)
def squeeze_repeats(spark, sf):
    runs = f.squeeze_repeats(v.flow_calls(spark, sf))
    return runs.select(
        "pid", "seq", "fn", F.array_join("sig", "&").alias("sig"), *micros("t_start", "t_end"), "occurrences"
    )


def pass_sql(table: str, n: int, least: int) -> str:
    """The views of one replacement pass over ``table``, the last named ``table`` and ``n``."""
    x = f"{table}{n}"
    return f""", {x}a as (select *, fn||':'||array_to_string(sig, '&') s, row_number() over w pos, lead(fn) over w nf, lead(sig) over w ng,
      lead(t_end) over w nt, lead(fn||':'||array_to_string(sig, '&')) over w ns
      from {table}{n - 1 if n > 1 else ""} window w as (partition by pid order by seq)),
    {x}b as (select *, ns is not null and count(*) over (partition by pid, s, ns) > {least} often from {x}a),
    {x}o as (select *, pos - coalesce(max(case when not often then pos end) over (partition by pid order by pos
       rows between unbounded preceding and 1 preceding), 0) off from {x}b),
    {x}k as (select pid, seq, pos, off, t_start, often and off%2=1 taken,
       case when often and off%2=1 then '('||fn||'+'||nf||')' else fn end fn,
       case when often and off%2=1 then list_concat(sig, list_filter(ng, lambda g: not list_contains(sig, g))) else sig end sig,
       case when often and off%2=1 then nt else t_end end t_end, case when often and off%2=1 then 'Rept' else style end style,
       case when often and off%2=1 then 1 else occurrences end occurrences from {x}o where not (off>1 and off%2=0)),
    {x}i as (select *, case when taken and lag(taken) over w and lag(fn) over w=fn and lag(sig) over w=sig then 0 else 1 end st
       from {x}k window w as (partition by pid order by pos)),
    {x}j as (select *, sum(st) over (partition by pid order by pos rows unbounded preceding) g from {x}i),
    {x} as (select pid, min(seq) seq, min_by(fn, seq) fn, min_by(sig, seq) sig, min_by(t_start, seq) t_start, max_by(t_end, seq) t_end,
      min_by(style, seq) style, sum(occurrences)::bigint occurrences, sum(case when taken then 1 else 0 end)::bigint taken
      from {x}j group by pid, g)"""


#: Passes written out for the oracles; flows settle in fewer, and further passes change nothing.
PASSES = 8


def passes_sql(table: str, least: int) -> str:
    return "".join(pass_sql(table, n, least) for n in range(1, PASSES + 1))


def squeezed_sql(table: str, source: str) -> str:
    """``table``: runs of equal calls of ``source`` (pid, seq, fn, sig, t_start, t_end) as one."""
    return f""", {table}_a as (select *, case when fn = lag(fn) over w and sig = lag(sig) over w then 0 else 1 end st
      from {source} window w as (partition by pid order by seq)),
    {table}_b as (select *, sum(st) over (partition by pid order by seq rows unbounded preceding) i from {table}_a),
    {table} as (select pid, min(seq) seq, min(fn) fn, min_by(sig, seq) sig, min_by(t_start, seq) t_start, max_by(t_end, seq) t_end,
      'Orig' style, count(*) occurrences from {table}_b group by pid, i)"""


FLOW_LISTS = FLOW + """, calls0 as (select pid, seq, fn, [sig] as sig, t_start, t_start as t_end, 'Orig' style, 1::bigint occurrences from flow)"""


@query(
    "t13_bigram_pass",
    FLOW_LISTS + pass_sql("calls0", 1, 1)
    + """ select pid, seq, fn, array_to_string(sig, '&') sig, occurrences, taken, epoch_us(t_start) t_start, epoch_us(t_end) t_end from calls01""",
)
def bigram_pass(spark, sf):
    step = f.bigram_pass(f.as_flow(v.flow_calls(spark, sf)), min_count=1)
    return step.select(
        "pid", "seq", "fn", F.array_join("sig", "&").alias("sig"), "occurrences", "taken", *micros("t_start", "t_end")
    )


@query(
    "t13_cluster_bigrams",
    FLOW_LISTS
    + squeezed_sql("sq", "calls0")
    + passes_sql("sq", 1)
    + f""" select pid, seq, fn, array_to_string(sig, '&') sig, style, occurrences, epoch_us(t_start) t_start, epoch_us(t_end) t_end
    from sq{PASSES}""",
)
def cluster_bigrams(spark, sf):
    out = f.cluster_bigrams(f.squeeze_repeats(v.flow_calls(spark, sf)), min_count=1)
    return out.select(
        "pid", "seq", "fn", F.array_join("sig", "&").alias("sig"), "style", "occurrences", *micros("t_start", "t_end")
    )


ARGS_RUNS = (
    FLOW
    + """, a as (select *, case when sig = lag(sig) over (partition by pid order by seq) then 0 else 1 end st from flow),
    b as (select *, sum(st) over (partition by pid order by seq rows unbounded preceding) i from a)"""
)


@query(
    "t14_cluster_by_args",
    ARGS_RUNS
    + """select pid, min(seq) seq, case when count(*)>1 then '('||string_agg(fn, '+' order by seq)||')' else min(fn) end fn,
    min(sig) sig, case when count(*)>1 then 'Args' else 'Orig' end style, count(*) calls from b group by pid, i""",
)
def cluster_by_args(spark, sf):
    runs = f.cluster_by_args(v.flow_calls(spark, sf))
    return runs.select("pid", "seq", "fn", F.array_join("sig", "&").alias("sig"), "style", "calls")


@query(
    "t15_sequence_duration",
    ARGS_RUNS
    + """select pid, min(seq) seq, (epoch_us(max_by(t_start, seq)) - epoch_us(min_by(t_start, seq))) / 1000000 duration
      from b group by pid, i""",
)
def sequence_duration(spark, sf):
    runs = f.sequence_duration(f.cluster_by_args(v.flow_calls(spark, sf)))
    return runs.select("pid", "seq", "duration")


def periods_sql(longest: int) -> str:
    """Tandem repeats length by length: where a block starts follows from where the last one ended."""
    text = """with recursive l0 as (select user_id seq_id, event_id pos, row_number() over (partition by user_id order by event_id) n,
      [event_type] as block, 1::bigint times, 1::bigint width from events)"""
    for k in range(1, longest + 1):
        text += f""", n{k} as (select *, case when times=1 and len(block)=1 then block[1] else to_json(block)::varchar||'*'||times end label from l{k - 1}),
    e{k} as (select *, coalesce(label = lead(label, {k}) over (partition by seq_id order by n), false) same from n{k}),
    r{k} as (select *, coalesce(min(case when not same then n end) over (partition by seq_id order by n
       rows between current row and unbounded following), n) - n run from e{k}),
    j{k} as (select *, case when run >= {k} then 1 + run // {k} else 1 end t from r{k}),
    c{k} as (select seq_id, n, pos, t from j{k} where n = 1 union all
      select j.seq_id, j.n, j.pos, j.t from c{k} c join j{k} j on j.seq_id = c.seq_id and j.n = c.n + case when c.t > 1 then c.t * {k} else 1 end),
    l{k} as (select c.seq_id, c.pos, row_number() over (partition by c.seq_id order by c.n) n,
      list(e.label order by e.n) filter (e.n < c.n + case when c.t > 1 then {k} else 1 end) as block, c.t::bigint times, sum(e.width)::bigint width
      from c{k} c join n{k} e on e.seq_id = c.seq_id and e.n >= c.n and e.n < c.n + case when c.t > 1 then c.t * {k} else 1 end
      group by c.seq_id, c.pos, c.n, c.t)"""
    return text + f" select seq_id, pos, array_to_string(block, ' ') block, times, width from l{longest}"


@query("t16_squeeze_periods", periods_sql(3))
def squeeze_periods(spark, sf):
    symbols = v.events(spark, sf).select(
        F.col("user_id").alias("seq_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("symbol")
    )
    out = f.squeeze_periods(symbols, 3)
    return out.select("seq_id", "pos", F.array_join("block", " ").alias("block"), "times", "width")


@query(
    "t16_inflate",
    "select user_id seq_id, event_type symbol, row_number() over (partition by user_id order by event_id) as place from events",
)
def inflate_periods(spark, sf):
    symbols = v.events(spark, sf).select(
        F.col("user_id").alias("seq_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("symbol")
    )
    back = f.inflate(f.squeeze_levels(symbols, 2))
    in_flow = Window.partitionBy("seq_id").orderBy("pos", "order")
    return back.select("seq_id", "symbol", F.row_number().over(in_flow).cast("long").alias("place"))


@query(
    "t17_bigram_stats",
    FLOW
    + """, a as (select pid, full_sig "first", lead(full_sig) over (partition by pid order by seq) "second" from flow)
    select pid, "first", "second", count(*) n from a where "second" is not null group by all""",
)
def bigram_stats(spark, sf):
    return f.bigram_stats(v.flow_calls(spark, sf)).select("pid", "first", "second", "n")


@query(
    "t18_principal_period",
    """with w as (select p_partkey, repeat(left(p_brand, 3), p_size) s from part)
    select p_partkey, case when strpos(substr(s||s, 2, 2*length(s)-2), s) > 0 then strpos(substr(s||s, 2, 2*length(s)-2), s) else -1 end period
    from w""",
)
def principal_period(spark, sf):
    text = F.expr("repeat(left(p_brand, 3), p_size)")
    return v.table(spark, sf, "part").select(
        "p_partkey", f.principal_period(text).cast("long").alias("period")
    )


@query(
    "t18_principal_period_rows",
    """with e as (select user_id, event_type, row_number() over (partition by user_id order by event_id) - 1 i,
      count(*) over (partition by user_id) n, event_id from events),
    q as (select 'kinds' as kind, user_id, event_id, event_type as symbol from e
      union all select 'turns', user_id, event_id, cast(i % (n // (user_id % 4 + 1)) as varchar) from e),
    w as (select kind, user_id, count(*) n, string_agg(symbol||';', '' order by event_id) s from q group by all),
    t as (select *, left(s, strpos(substr(s||s, 2, 2*length(s)-2), s)) head from w)
    select kind, user_id, n, case when head <> '' then length(head) - length(replace(head, ';', '')) else -1 end period from t""",
)
def principal_period_rows(spark, sf):
    """The kinds of each user's events, and their numbers modulo a part of how many there are."""
    e = v.events(spark, sf)
    counts = e.groupBy("user_id").agg(F.count("*").alias("n"))
    placed = ordered.scan(e.select("user_id", "event_id"), ["user_id"], "event_id", sums={"i": F.lit(1)})
    turns = placed.join(counts, "user_id").select(
        F.lit("turns").alias("kind"), "user_id", "event_id",
        F.expr("cast((i - 1) % (n div (user_id % 4 + 1)) as string)").alias("symbol"),
    )
    kinds = e.select(F.lit("kinds").alias("kind"), "user_id", "event_id", F.col("event_type").alias("symbol"))
    return f.principal_periods(kinds.unionByName(turns), ["kind", "user_id"], "event_id", "symbol")


PROCS = (
    CALLS
    + """, own as (select pid, min_by(t_start, seq) seen,
      max_by('/usr/bin/python'||k, seq) filter (fn='execve@SYS') executable,
      max_by('python run'||k||'.py', seq) filter (fn='execve@SYS') command from calls group by pid),
    made as (select other_pid pid, max_by(t_start, seq) made from calls where fn='clone@SYS' group by 1),
    waited as (select other_pid pid, max_by(t_start, seq) waited from calls where fn='wait4@SYS' group by 1),
    named as (select other_pid pid, max_by(pid, seq) parent from calls where fn in ('clone@SYS','wait4@SYS') group by 1),
    ids as (select pid from own union select pid from made union select pid from waited),
    procs as (select ids.pid, coalesce(made, seen, waited) t_create, coalesce(waited, (select max_by(t_start, seq) from calls)) t_end,
      parent ppid, executable, command, made is not null is_thread
      from ids left join own using (pid) left join made using (pid) left join waited using (pid)
      left join named using (pid))
"""
)


def trace_processes(spark, sf):
    return ob.process_table(v.trace_calls(spark, sf))


@query("t19_process_table", PROCS + "select * from procs")
def process_table(spark, sf):
    return trace_processes(spark, sf).drop("session")


@query(
    "t19_process_tree",
    PROCS + """select 'events:'||ppid ancestor, 'events:'||pid descendant, 1 as depth from procs where ppid is not null""",
)
def process_tree(spark, sf):
    return t.closure(ob.process_links(trace_processes(spark, sf)))


ACCESSES = (
    CALLS
    + """, acc as (select pid, path, min_by(t_start, seq) filter (fn in ('open@SYS','openat@SYS')) t_open,
      min_by(t_start, seq) filter (fn='close@SYS') t_close, count(*) filter (fn in ('open@SYS','openat@SYS')) n_open,
      count(*) filter (fn='read@SYS') n_read, coalesce(sum(bytes) filter (fn='read@SYS'), 0)::bigint bytes_read,
      count(*) filter (fn='write@SYS') n_write, coalesce(sum(bytes) filter (fn='write@SYS'), 0)::bigint bytes_written,
      case when bool_or(fn in ('open@SYS','write@SYS')) then 'W' else
        min_by(case fn when 'close@SYS' then 'C' else 'R' end, seq) end flag
      from calls where fn in ('open@SYS','openat@SYS','read@SYS','write@SYS','close@SYS') group by pid, path)
"""
)


def trace_accesses(spark, sf):
    return ob.file_access_table(v.trace_calls(spark, sf))


@query("t20_file_access_table", ACCESSES + "select * from acc")
def file_access_table(spark, sf):
    return trace_accesses(spark, sf).drop("session")


def socket_calls(spark, sf):
    """Views and signups read a socket, the others write it; two fragments of three are full blocks."""
    e = v.events(spark, sf)
    read = F.col("event_type").isin("view", "signup")
    full = F.col("k") % 3 > 0
    port = (F.col("user_id") % 7).cast("string")
    fd = F.concat(F.lit("5<TCP:[10.0.0.1:99->10.0.0.2:300"), port, F.lit("]>"))
    piece = F.concat(F.lit("select a"), F.col("k").cast("string"), F.lit(" from t"), F.col("k").cast("string"), F.lit(";"))
    text = F.when(full, F.rpad(piece, 256, ".")).otherwise(piece)
    return e.select(
        F.lit("net").alias("session"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("pid"),
        F.when(read, "read@SYS").otherwise("write@SYS").alias("fn"),
        F.array(fd, text, F.lit("256")).alias("args"),
        F.length(text).cast("string").alias("ret"),
        v.stamp(F.col("ts")).alias("t_start"),
        v.stamp(F.col("ts")).alias("t_end"),
        F.lit("strace").alias("tracer"),
        F.lit("plain").alias("status"),
    )


BUFFERS = """with e as (select event_id seq, user_id pid, 'TCP:[10.0.0.1:99->10.0.0.2:300'||(user_id%7)||']' path,
   case when event_type in ('view','signup') then 'read' else 'write' end dir, k, k%3>0 ful, 'select a'||k||' from t'||k||';' piece
   from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)),
 r as (select *, sum(case when ful then 0 else 1 end) over (partition by pid, path, dir order by seq rows unbounded preceding) ends,
   max(case when ful then 0 else 1 end * seq) over (partition by pid, path, dir) last_short from e),
 b as (select pid, path, dir, min(seq) seq, string_agg(rpad(piece, 256, '.'), '' order by seq) as text,
   min(seq) < max(last_short) closed from r where ful group by pid, path, dir, ends
   union all select pid, path, dir, seq, piece, true from r where not ful)
"""


@query("t21_rebuild_buffers", BUFFERS + "select * from b")
def rebuild_buffers(spark, sf):
    return ob.rebuild_buffers(socket_calls(spark, sf)).drop("session")


@query(
    "t22_buffer_hits",
    BUFFERS
    + """select pid, path, dir, seq, 'SqlQuery' scanner, 'SELECT' kind, unnest(regexp_extract_all(text,
    '(?i)select\\s+[ ,a-z_0-9\\.=''"+\\-*$()%]*\\s+from\\s+[ ,a-z_0-9\\.=''"+\\-*$()%]*', 0)) hit from b""",
)
def buffer_hits(spark, sf):
    return ob.buffer_hits(ob.rebuild_buffers(socket_calls(spark, sf))).drop("session")


@query(
    "t21_message_parts",
    BUFFERS
    + """, m as (select *, min(seq) over g first, row_number() over (partition by pid, path, dir, ends order by seq) - 1 part,
       min(seq) over g < last_short closed from r where ful window g as (partition by pid, path, dir, ends))
    select pid, path, dir, first seq, part, rpad(piece, 256, '.') as text, closed from m
    union all select pid, path, dir, seq, 0, piece, true from r where not ful""",
)
def message_parts(spark, sf):
    return ob.message_parts(socket_calls(spark, sf)).drop("session")


def broken_calls(spark, sf):
    """Statements that begin in one fragment and end in a later one; some fragments between are
    made of nothing else, the last of a message is short."""
    calls = socket_calls(spark, sf)
    k = F.regexp_extract(F.col("args")[1], "select a([0-9]+)", 1)
    number = k.cast("long")
    begin = F.concat(F.lit(" and c"), k, F.lit(" from t"), k)
    end = F.concat(F.lit("; select a"), k, F.lit(", b "))
    between = F.rpad(F.concat(F.lit(", d"), k, F.lit(" ")), 256, "e, ")
    broken = F.concat(F.rpad(begin, 236, "#"), F.lpad(end, 20, "#"))
    text = F.when(number % 3 == 0, begin).when(number % 3 == 1, broken).otherwise(between)
    return calls.withColumns({"args": F.array(F.col("args")[0], text, F.lit("256")), "ret": F.length(text).cast("string")})


@query(
    "t22_part_hits",
    """with e as (select event_id seq, user_id pid, 'TCP:[10.0.0.1:99->10.0.0.2:300'||(user_id%7)||']' path,
   case when event_type in ('view','signup') then 'read' else 'write' end dir, k, ' and c'||k||' from t'||k head, k%3>0 ful
   from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) k from events)),
 x as (select *, case when k%3=0 then head when k%3=1 then rpad(head, 236, '#')||lpad('; select a'||k||', b ', 20, '#')
   else substr(', d'||k||' '||repeat('e, ', 90), 1, 256) end piece from e),
 r as (select *, sum(case when ful then 0 else 1 end) over (partition by pid, path, dir order by seq rows unbounded preceding) ends from x),
 b as (select pid, path, dir, min(seq) seq, string_agg(piece, '' order by seq) as text from r where ful group by pid, path, dir, ends
   union all select pid, path, dir, seq, piece from r where not ful)
 select pid, path, dir, seq, 'SqlQuery' scanner, 'SELECT' kind, unnest(regexp_extract_all(text,
    '(?i)select\\s+[ ,a-z_0-9\\.=''"+\\-*$()%]*\\s+from\\s+[ ,a-z_0-9\\.=''"+\\-*$()%]*', 0)) hit from b""",
)
def part_hits(spark, sf):
    return ob.part_hits(ob.message_parts(broken_calls(spark, sf))).drop("session")


RULES = """, rl as (select pid, case when flag='R' then 'input' else 'target' end as role, path from acc),
 ok as (select pid from rl group by pid having bool_or(role='input') and bool_or(role='target'))"""


@query(
    "t23_build_rules",
    ACCESSES
    + RULES
    + """, ex as (select pid, max_by('python run'||k||'.py', seq) command from calls where fn='execve@SYS' group by pid)
    select rl.pid, role, path, coalesce(command, '') command from rl join ok using (pid) left join ex using (pid)""",
)
def build_rules(spark, sf):
    rules = ob.build_rules(trace_accesses(spark, sf), trace_processes(spark, sf))
    return rules.select("pid", "role", "path", "command")


@query(
    "t24_dataflow",
    """with e as (select *, '/shared/f'||regexp_extract(props, '([0-9]+)', 1) path from events),
    ends as (select distinct path, case when event_type in ('view','signup') then 'reader' else 'writer' end as role, user_id pid from e),
    ok as (select distinct w.path from ends w join ends r on w.path=r.path and w.role='writer' and r.role='reader' and w.pid<>r.pid)
    select ends.* from ends join ok using (path)""",
)
def dataflow(spark, sf):
    calls = v.events(spark, sf)
    # Files shared by users: views and signups read the file of the argument, the others write it.
    reads = F.col("event_type").isin("view", "signup")
    acc = calls.groupBy(
        F.lit("s").alias("session"),
        F.col("user_id").alias("pid"),
        F.concat(F.lit("/shared/f"), F.col("k").cast("string")).alias("path"),
    ).agg(
        F.count(F.when(reads, 1)).alias("n_read"),
        F.count(F.when(~reads, 1)).alias("n_write"),
        F.max(F.when(reads, "R").otherwise("W")).alias("flag"),
    )
    return ob.dataflow(acc).select("path", "role", "pid")


@query(
    "t25_needed_packages",
    """with f as (select distinct regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) path from pages
      union select distinct '/home'||regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) from pages)
    select path, case when path not like '/home/%' then
      case when cast(nullif(regexp_extract(path, '([0-9]+)$', 1), '') as bigint)%2=0 then 'pkg-a' end end package from f""",
)
def needed_packages(spark, sf):
    paths_ = v.table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path")
    )
    number = F.regexp_extract("path", r"(\d+)$", 1).try_cast("long")
    # Two packages own the files with even numbers; the first by name is taken.
    index = paths_.where(number % 2 == 0).select(
        "path", F.explode(F.array(F.lit("pkg-b"), F.lit("pkg-a"))).alias("package")
    )
    home = paths_.select(F.concat(F.lit("/home"), "path").alias("path"))
    return ob.needed_packages(paths_.unionByName(home), index)


@query(
    "t26_python_packages",
    "select distinct split_part(p_name, ' ', 2) package from part where p_size > 10",
)
def python_packages(spark, sf):
    p = v.table(spark, sf, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    path = F.when(
        F.col("p_size") > 10,
        F.concat(F.lit("/usr/lib/python3/site-packages/"), word, F.lit("/core.py")),
    ).otherwise(F.concat(F.lit("/usr/lib/python3/dist-packages/"), word, F.lit(".py")))
    return ob.python_packages(p.select(path.alias("path")))


@query(
    "t27_interpreter_kind",
    """select p_partkey, case when p_size%3=0 then 'Python scripts' when p_size%3=1 then 'Perl scripts' else 'Binary programs' end kind
    from part""",
)
def interpreter_kind(spark, sf):
    p = v.table(spark, sf, "part")
    size = F.col("p_size") % 3
    exe = F.when(size == 0, "/usr/bin/python3").when(size == 1, "/usr/bin/perl").otherwise("/bin/sh")
    return ob.interpreter_kind(p.select("p_partkey", exe.alias("executable"))).select("p_partkey", "kind")


@query(
    "t28_exposed_ports",
    "select distinct cast(300 + c_nationkey as varchar) port from customer",
)
def exposed_ports(spark, sf):
    cu = v.table(spark, sf, "customer")
    far = (F.lit(300) + F.col("c_nationkey")).cast("string")
    name = F.concat(F.lit("TCP:[10.0.0.1:41->10.0.0.2:"), far, F.lit("]"))
    files = cu.select(F.explode(F.array(name, F.concat(F.lit("/f"), far))).alias("path"))
    return ob.exposed_ports(files)


@query(
    "t29_env_read",
    """select 'V'||k as name, max_by(case when event_type='view' then '' else event_type end, event_id) as value
    from (select *, regexp_extract(props, '([0-9]+)', 1) k from events) group by k""",
)
def env_read(spark, sf):
    e = v.events(spark, sf)
    calls = e.select(
        F.lit("env").alias("session"),
        F.col("event_id").alias("seq"),
        F.lit("getenv").alias("fn"),
        F.array(F.concat(F.lit("V"), F.col("k").cast("string"))).alias("args"),
        F.when(F.col("event_type") == "view", "nil").otherwise(F.col("event_type")).alias("ret"),
    )
    return ob.env_read(calls).select("name", "value")


@query(
    "t30_files_by_category",
    ACCESSES + """select 'Others' category, count(distinct path) files from acc
    union all select 'Executed', count(distinct executable) from (select '/usr/bin/python'||k executable from calls where fn='execve@SYS')""",
)
def files_by_category(spark, sf):
    calls = cut(v.trace_calls(spark, sf), "zstd")  # parsed once, read twice
    ran = calls.where("fn = 'execve@SYS'").select(F.get("args", F.lit(0)).alias("path"))
    files = ob.file_access_table(calls).select("path").unionByName(ran)
    executed = ran.select(F.col("path").alias("executable"))
    return ob.category_counts(ob.files_by_category(files, executed))


@query(
    "t31_changes_only",
    """with a as (select event_id seq, 'u'||user_id s, event_type o,
      lag(event_type) over (partition by user_id order by event_id) was from events)
    select s, 'state' p, o, seq from a where was is null or was <> o
    union all select 'u'||user_id, 'rdf:type', 'user', min(event_id) from events group by user_id""",
)
def changes_only(spark, sf):
    facts = v.events(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("object"),
        F.lit("user").alias("cls"),
        F.lit("state").alias("attribute"),
        F.col("event_type").alias("value"),
        F.col("event_id").alias("seq"),
    )
    return ob.changes_only(facts).select("s", "p", "o", "seq")


@query(
    "t32_trace_to_triples",
    PROCS.replace("procs as (", "procs as (", 1)
    + ACCESSES[len(CALLS):]
    + """, t as (select 'process.Session=events,Handle='||pid s, 'rdf:type' p, 'process' o from procs
    union select 'process.Session=events,Handle='||pid, 't_create', t_create from procs
    union select 'process.Session=events,Handle='||pid, 't_end', t_end from procs
    union select 'process.Session=events,Handle='||pid, 'command', command from procs where command is not null
    union select 'process.Session=events,Handle='||pid, 'ppid', 'process.Session=events,Handle='||ppid from procs where ppid is not null
    union select 'process.Session=events,Handle='||pid, 'executable', 'file.Name='||executable from procs where executable is not null
    union select 'file.Name='||path, 'rdf:type', 'file' from acc
    union select 'file.Name='||path, 'category', 'Others' from acc
    union select 'process.Session=events,Handle='||pid, 'reads', 'file.Name='||path from acc where n_read>0
    union select 'process.Session=events,Handle='||pid, 'writes', 'file.Name='||path from acc where n_write>0)
    select * from t""",
)
def trace_to_triples(spark, sf):
    calls = cut(v.trace_calls(spark, sf), "zstd")  # parsed once, read by both tables
    facts = ob.trace_to_triples(ob.process_table(calls), ob.file_access_table(calls))
    return facts.select("s", "p", "o")


@query(
    "k1_call_rows",
    CALLS
    + """select pid, 1 as occurrences, 'Orig' as style, 'plain' as status, fn as function, ret as "return", t_start as start, t_start as "end",
    """ + ARGS_TEXT + """ as arguments from calls""",
)
def call_rows(spark, sf):
    calls = v.trace_calls(spark, sf).withColumn("args", F.array(F.array_join("args", ";")))
    rows = shapes.call_rows(calls)
    return rows.select(*shapes.CALL_COLUMNS)


@query(
    "k8_summary",
    PROCS
    + ACCESSES[len(CALLS):]
    + """select 'Processes' section, cast(pid as varchar) item,
      concat_ws('|', executable, t_create, t_end, cast(ppid as varchar)) detail from procs
    union all select distinct 'Others', path, '' from acc""",
)
def summary(spark, sf):
    return shapes.summary(trace_processes(spark, sf), trace_accesses(spark, sf), ["Others"])


@query(
    "u3_factorise",
    HALVES
    + """, u0 as (select seq, pid, 'read@SYS' fn, case when d=-1 then ['UnknownFileDescr:'||pk] else [k] end sig,
        case when d=1 then ns end partner from m
      union all select seq, pid, 'read@SYS', [k], null from n where lev=0
      union all select event_id, user_id, event_type||'@SYS', [regexp_extract(props, '([0-9]+)', 1)], null from events
        where event_type not in ('click','purchase')),
    u1 as (select *, lead(seq) over (partition by pid order by seq) nx from u0),
    u2 as (select *, 0 t_start, 0 t_end from u1 where partner is null or nx is null or partner <> nx)"""
    + squeezed_sql("sq", "u2")
    + passes_sql("sq", 5)
    + f""", ra as (select *, case when sig = lag(sig) over (partition by pid order by seq) then 0 else 1 end st from sq{PASSES}),
    rb as (select *, sum(st) over (partition by pid order by seq rows unbounded preceding) i from ra)
    select pid, min(seq) seq, case when count(*)>1 then '('||string_agg(fn, '+' order by seq)||')' else min(fn) end fn,
      case when count(*)>1 then 'Args' else min(style) end style, case when count(*)>1 then 1 else sum(occurrences) end::bigint occurrences,
      count(*) calls from rb group by pid, i""",
)
def factorise(spark, sf):
    joined = c.significant_args(c.match_interrupted(v.interrupted_calls(spark, sf)).withColumn("ret", F.lit("0")))
    out = f.AGGREGATORS["clusters"](joined)
    return out.select("pid", "seq", "fn", "style", "occurrences", "calls")
