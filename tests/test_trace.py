"""Logs written for these tests, read from files and checked by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sysweave.operators import calls as c
from sysweave.operators import objects as ob
from sysweave.sources import trace as tr
from sysweave.sources.lines import read_lines

LOG = """\
10:00:00.000001 execve("/usr/bin/make", ["make", "all"], [/* 9 vars */]) = 0 <0.000300>
10:00:00.000100 openat(AT_FDCWD, "Makefile", O_RDONLY) = 3</src/Makefile> <0.000010>
10:00:00.000200 read(3</src/Makefile>, "all: a.o\\n", 4096) = 9 <0.000010>
10:00:00.000300 close(3</src/Makefile>) = 0 <0.000010>
10:00:00.000400 clone(child_stack=0, flags=CLONE_CHILD_SETTID|SIGCHLD) = 200 <0.000040>
10:00:00.000500 wait4(-1,  <unfinished ...>
[pid 200] 10:00:01.000000 execve("/usr/bin/gcc", ["gcc", "a.c"], 0x7ffe /* 9 vars */) = 0 <0.0003>
[pid 200] 10:00:01.100000 open("/missing", O_RDONLY) = -1 ENOENT (No such file or directory) <0.00001>
[pid 200] 10:00:01.200000 open("/src/a.c", O_RDONLY) = 3</src/a.c> <0.00001>
[pid 200] 10:00:01.300000 read(3</src/a.c>, "int main"..., 4096) = 100 <0.00001>
[pid 200] 10:00:01.400000 open("/src/a.o", O_WRONLY|O_CREAT, 0666) = 4</src/a.o> <0.00001>
[pid 200] 10:00:01.500000 write(4</src/a.o>, "\\177ELF"..., 512) = 512 <0.00001>
[pid 200] 10:00:01.600000 write(5<TCP:[10.0.0.1:4000->10.0.0.9:3306]>, "select a from b", 15) = 15 <0.00001>
[pid 200] 10:00:01.700000 --- SIGCHLD {si_signo=SIGCHLD, si_pid=201} ---
[pid 200] 10:00:01.800000 +++ exited with 0 +++
10:00:01.900000 <... wait4 resumed> [{WIFEXITED(s) && WEXITSTATUS(s) == 0}], 0, NULL) = 200 <1.4>
10:00:02.000000 exit_group(0)           = ?
"""


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "make.strace.log"
    path.write_text(LOG)
    return str(path)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = tmp_path / "long.log"
    path.write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = read_lines(spark, str(path))
        assert lines.select("session").rdd.getNumPartitions() >= 1
        got = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2000
    assert all(r.line == f"line {r.seq}" for r in got)


def test_read_trace(spark, log):
    calls = tr.read_trace(spark, log, top_pid=100).orderBy("seq").collect()
    assert len(calls) == 15  # the signal and the exit line are gone
    first, last = calls[0], calls[-1]
    assert (first.pid, first.fn, first.ret, first.dur) == (100, "execve@SYS", "0", 0.0003)
    assert (last.fn, last.ret) == ("exit_group@SYS", "?")
    wait = [r for r in calls if r.fn == "wait4@SYS"]
    assert [r.status for r in wait] == ["unfinished", "resumed"]
    assert wait[1].ret == "200"


def analysed(spark, log):
    calls = tr.split_args(tr.read_trace(spark, log, top_pid=100))
    return c.drop_failed(c.drop_ignored(c.match_interrupted(calls)))


def test_processes(spark, log):
    procs = {r.pid: r for r in ob.process_table(analysed(spark, log)).collect()}
    assert procs[200].ppid == 100 and procs[100].ppid is None
    assert procs[200].t_create == "10:00:00.000400"
    assert procs[200].t_end == "10:00:01.900000"
    assert procs[200].executable == "/usr/bin/gcc" and procs[200].command == "gcc a.c"
    assert procs[200].is_thread is False


def test_file_accesses_and_rules(spark, log):
    calls = analysed(spark, log)
    acc = {(r.pid, r.path): r for r in ob.file_access_table(calls).collect()}
    read = acc[(100, "/src/Makefile")]
    assert (read.n_open, read.n_read, read.bytes_read, read.flag) == (1, 1, 9, "R")
    assert read.t_close == "10:00:00.000300"
    assert (200, "/missing") not in acc
    wrote = acc[(200, "/src/a.o")]
    assert (wrote.n_write, wrote.bytes_written, wrote.flag) == (1, 512, "W")
    parity = {(r.pid, r.path): r for r in ob.file_access_table(calls, parity=True).collect()}
    assert parity[(100, "/src/Makefile")].n_open == 1  # the close, not the openat
    rules = ob.build_rules(ob.file_access_table(calls), ob.process_table(calls)).collect()
    assert {(r.role, r.path, r.command) for r in rules} == {
        ("input", "/src/a.c", "gcc a.c"),
        ("target", "/src/a.o", "gcc a.c"),
    }


def test_buffers(spark, log):
    hits = ob.buffer_hits(ob.rebuild_buffers(analysed(spark, log))).collect()
    assert [(h.kind, h.hit, h.dir) for h in hits] == [("SELECT", "select a from b", "write")]
    ports = ob.exposed_ports(ob.file_access_table(analysed(spark, log))).collect()
    assert [p.port for p in ports] == ["3306"]


def block(rnd, tokens):
    """A text of 256 bytes of UTF-8 out of tokens."""
    text = ""
    while len((text + (token := rnd.choice(tokens))).encode()) <= 256:
        text += token
    return text + " " * (256 - len(text.encode()))


def test_hits_over_borders_of_parts(spark, small_pieces):
    """Messages in parts give the finds of whole messages, wherever a statement is cut."""
    rnd = random.Random(5)
    words = ["select ", "SELECT", " from ", "t1", ", ", "a=b", "\n", "insert x into", " update a set "]
    rows = []
    for n in range(160):
        # One flow has most fragments, and long stretches without a character that ends a find.
        pid = 1 if n % 4 else n % 3
        tokens = words * (6 if n % 5 else 1) + ["#", "; é", "€"]
        short = "c from d;" if n % 40 == 39 else None
        text = short or block(rnd, words if 40 < n < 55 else tokens)
        rows.append((n, pid, text, str(len(text.encode()))))
    calls = spark.createDataFrame(rows, "seq long, pid long, text string, ret string").selectExpr(
        "'s' session", "seq", "pid", "'read@SYS' fn", "ret", "'strace' tracer", "'plain' status",
        "array('5<TCP:[10.0.0.1:99->10.0.0.2:3001]>', text, '256') args",
        "'10:00:00.000001' t_start", "'10:00:00.000002' t_end",
    )
    whole = ob.rebuild_buffers(calls, decode=False)
    parts = ob.message_parts(calls, decode=False).collect()
    glued = {}
    for r in sorted(parts, key=lambda r: r.part):
        glued.setdefault((r.pid, r.path, r.dir, r.seq, r.closed), []).append(r.text)
    assert {(*k, "".join(v)) for k, v in glued.items()} == {
        (r.pid, r.path, r.dir, r.seq, r.closed, r.text) for r in whole.collect()
    }
    want = sorted(tuple(r) for r in ob.buffer_hits(whole).collect())
    got = sorted(tuple(r) for r in ob.part_hits(ob.message_parts(calls, decode=False)).collect())
    assert got == want and len(want) > 50
    assert max(len(r[-1]) for r in want) > 256
    assert ob.part_hits(ob.message_parts(calls.limit(0))).collect() == []


def test_stitched_records(spark):
    lines = [
        (1, "[pid 7] 10:00:00.000001 wait4(8,"),
        (2, " NULL) = 8 <0.5>"),
        (3, "10:00:00.000002 close(3) = 0 <0.1>"),
        (4, "10:00:00.000003 write(1, \"a"),
        (5, "b\", 3) = 3 <0.1>"),
        (6, "10:00:00.000004 read(0,"),
    ]
    df = spark.createDataFrame([("s", n, t) for n, t in lines], "session string, seq bigint, line string")
    got = {r.seq: r.line for r in tr.stitch_lines(df).collect()}
    assert got == {
        1: lines[0][1] + "\n" + lines[1][1],
        3: lines[2][1],
        4: lines[3][1] + "\n" + lines[4][1],
        6: lines[5][1],
    }


def made_argument(rnd, depth):
    """(text, value) of a random argument, by the grammar of a printed call: a bare word, a
    descriptor with what it is, a quoted text that may hold separators, or a group of arguments."""
    kind = rnd.choice(["word", "descriptor", "text", "cut", "group"] if depth else ["word", "descriptor", "text", "cut"])
    if kind == "word":
        text = rnd.choice(["NULL", "0x1f", "17", "O_RDWR|O_EXCL", "len=4", "port=htons(80)", "f(1, 2)", "0x5 /* 3 vars */"])
        return text, text
    if kind == "descriptor":
        text = rnd.choice(["7</data/a b>", "3<pipe:[99]>", "8<TCP:[9.8.7.6:1->5.4.3.2:10]>", '2<UNIX:[5,"/run/q"]>'])
        return text, text
    # Blanks a text begins with are not kept.
    inner = "".join(rnd.choice("ab, ([{<>]})=") for _ in range(rnd.randint(0, 8))).lstrip(" ")
    if kind == "text":
        return f'"{inner}"', inner
    if kind == "cut":
        return f'"{inner}"...', inner + "..."
    parts = [made_argument(rnd, depth - 1) for _ in range(rnd.randint(1, 3))]
    left, right = rnd.choice(["[]", "{}"])
    return left + ", ".join(p[0] for p in parts) + right, [p[1] for p in parts]


@pytest.mark.parametrize("seed", range(40))
def test_argument_splitting(seed):
    rnd = random.Random(seed)
    # A call that is cut off loses closing marks at its end, so the last one is a number.
    parts = [made_argument(rnd, 2) for _ in range(rnd.randint(1, 5))] + [("9", "9")]
    text = ", ".join(p[0] for p in parts)
    for tail in ("", ") = 5 <0.000010>", " <unfinished ...>"):
        got, end = tr.split_text(text + tail)
        assert got == [p[1] for p in parts]
        assert len(text) <= end <= len(text) + 2


def test_nested_groups_are_json(spark):
    df = spark.createDataFrame([('"/bin/ls", ["ls", "-l"]',)], "args_text string")
    assert tr.split_args(df).first().args == ["/bin/ls", json.dumps(["ls", "-l"])]


def test_midnight(spark):
    calls = spark.createDataFrame(
        [("s", 1, "23:59:59.900000"), ("s", 2, "00:00:00.100000"), ("s", 3, "08:00:00.000000")],
        "session string, seq bigint, t_start string",
    )
    sessions = spark.createDataFrame([("s", "2020-05-17")], "session string, date string").withColumn(
        "date", F.col("date").cast("date")
    )
    got = [str(r.ts) for r in tr.with_dates(calls, sessions).orderBy("seq").collect()]
    assert got == ["2020-05-17 23:59:59.900000", "2020-05-18 00:00:00.100000", "2020-05-18 08:00:00"]


def test_session_file(spark, tmp_path):
    (tmp_path / "a.ini").write_text(
        "; made by hand\nTopProcessId=1234\nCurrentDirectory=/home/me\nCurrentDate=2020-05-17\n"
        "CurrentHostname=box\nCurrentOSType=linux\n"
    )
    row = tr.read_session(spark, str(tmp_path / "a.ini")).first()
    assert (row.top_pid, row.cwd, str(row.date), row.host, row.os) == (
        1234, "/home/me", "2020-05-17", "box", "linux",
    )


def test_ltrace_and_pydbg(spark):
    lines = spark.createDataFrame(
        [
            ("s", 1, "[pid 11] 09:00:22.600426 SYS_read(3 <unfinished ...>"),
            ("s", 2, '[pid 11] 09:00:22.600494 <... read resumed> , "abc", 3) = 3 <0.000068>'),
            ("s", 3, '[pid 11] 09:00:22.600495 libc.so.6->getenv("HOME") = "/home/me" <0.01>'),
            ("s", 4, "error: maximum array length seems negative"),
        ],
        "session string, seq bigint, line string",
    )
    got = {r.seq: r for r in tr.parse_lines(lines, "ltrace").collect()}
    assert got[1].fn == got[2].fn == "read@SYS"
    assert got[3].fn == "getenv"
    assert got[4].fn == ""
    joined = c.match_interrupted(tr.split_args(tr.parse_lines(lines, "ltrace"))).where("seq = 2").first()
    assert joined.status == "merged" and joined.args == ["3", "", "abc", "3"]
    dbg = spark.createDataFrame([("s", 1, "42 CreateFileW")], "session string, seq bigint, line string")
    row = tr.parse_lines(dbg, "pydbg").first()
    assert (row.pid, row.fn) == (42, "CreateFileW")
