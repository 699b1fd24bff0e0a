"""What the plans of queries on large tables may not do."""

import datetime

from __spark_entry__ import queries
from sysweave.model import TRIPLE_SCHEMA
from sysweave.operators import flows as f
from sysweave.operators import graphset as g
from sysweave.operators import relations as r


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_only_facts_of_required_subjects_are_grouped(spark, capsys):
    facts = spark.createDataFrame([(f"n{i}", "p", "1", "lit", "string", None) for i in range(50)], TRIPLE_SCHEMA)
    required = spark.createDataFrame(
        [("n1", "p", "1"), ("n1", "p", "2"), ("n2", None, None), ("gone", None, None), ("gone", "p", "1"), (None, None, None)],
        "s string, p string, o string",
    )
    missing = g.check_minimal(facts, required)
    got = sorted(map(tuple, missing.collect()), key=str)
    assert got == sorted([("n1", "p", "2"), ("gone", None, None), ("gone", "p", "1"), (None, None, None)], key=str)
    assert plan(missing, capsys).count("LeftSemi") >= 2


def test_account_lines_are_dealt_out_before_they_become_triples(spark, capsys):
    lines = spark.createDataFrame([(f"u{i % 7}:x:{i % 7}:1:c:/home/u:/bin/sh",) for i in range(40)], "line string")
    found = r.account_triples(lines, "passwd")
    assert found.count() == 7 * 6
    assert "REPARTITION_BY_NUM" in plan(found, capsys)


def test_a_log_is_parsed_once(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    kinds = ["signup", "view", "click", "purchase", "error"]
    rows = [(n, start + datetime.timedelta(minutes=n), n % 3, kinds[n % 5], n / 7, f'{{"k": {n % 11}}}') for n in range(60)]
    spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("t30_files_by_category", "t32_trace_to_triples"):
        found = queries()[name](spark, str(tmp_path))
        assert found.count() and not [f for f in found.inputFiles() if "events.parquet" in f]


def test_pairs_of_calls_are_told_by_numbers_and_dealt_out_once(spark, monkeypatch):
    written, cut = [], f.cut
    monkeypatch.setattr(f, "cut", lambda df, *a, **kw: written.append(df) or cut(df, *a, **kw))
    start = datetime.datetime(2024, 1, 1)
    calls = [("s", 1, n, "abcabd"[n % 6], ["x"], start, start + datetime.timedelta(seconds=n)) for n in range(18)]
    calls = spark.createDataFrame(
        calls, "session string, pid long, seq long, fn string, sig array<string>, t_start timestamp, t_end timestamp"
    )
    got = f.bigram_pass(f.as_flow(calls), min_count=3).orderBy("seq").collect()
    # Only a+b comes more than three times; its end is that of its second call.
    assert [r.fn for r in got] == ["(a+b)", "c", "(a+b)", "d"] * 3
    assert [r.taken for r in got] == [1, 0] * 6
    assert [(r.t_end - start).seconds for r in got] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14, 16, 17]
    names = [c for df in written for c, kind in df.dtypes if kind == "string"]
    assert set(names) == {"session", "fn", "style"}
    assert not [df for df in written if "_next" in df.columns]
    assert [sum("_often" in df.columns for df in written)] == [1]
