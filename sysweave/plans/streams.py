"""Streams over the events, run to the end of what is there, next to their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sysweave.model import triples
from sysweave.plans import views as v
from sysweave.plans.registry import query
from sysweave.plans.relations import STORE, homes, text
from sysweave.plans.trace import CALLS, HALVES
from sysweave.streaming import events as ev
from sysweave.streaming import samples as st
from sysweave.streaming import trace as live
from sysweave.streaming.run import fresh_folder, keyed_state, run_to_end, run_to_table


def event_stream(spark, sf):
    schema = v.table(spark, sf, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return v.with_argument(files.parquet(sf))


@query("e1_append_events", f"with {STORE} select distinct s, 'did' p, o, ctx from st")
def append_events(spark, sf):
    facts = triples(
        event_stream(spark, sf), F.concat(F.lit("u"), text("user_id")), "did", text("k"),
        ctx=F.col("event_type"),
    )
    store = fresh_folder(spark, "store")
    ev.append_events(facts, store, f"{store}-checkpoint").awaitTermination()
    return ev.stored(spark, store).select("s", "p", "o", "ctx")


def cents_stream(spark, sf):
    cents = event_stream(spark, sf).withColumn("cents", F.round(F.col("value") * 100))
    return st.sample_stream(cents.withColumn("ts", v.instant()), "user", ["cents"], obj="user_id")


@query(
    "e6_sample_stream_live",
    "select user_id as object, 'user.cents' metric, round(value*100) as value from events",
)
def sample_stream(spark, sf):
    return run_to_table(cents_stream(spark, sf).select("object", "metric", "value"))


@query(
    "e7_stream_rollup",
    """select user_id as object, 'user.cents' metric, epoch_us(time_bucket(interval 6 hours, ts)) start_us, count(*) n,
      min(round(value*100)) least, max(round(value*100)) greatest from events group by 1, 2, 3""",
)
def stream_rollup(spark, sf):
    rolled = run_to_end(
        cents_stream(spark, sf), "ts", lambda samples: st.sample_rollup(samples, "6 hours", late="10 minutes")
    )
    return rolled.select("object", "metric", F.unix_micros("start").alias("start_us"), "n", "least", "greatest")


@query(
    "e9_standing_stream",
    """select 'u'||user_id u, k, 'nation.key='||n_nationkey nation from (select *, regexp_extract(props, '([0-9]+)', 1) k from events)
    join nation on n_nationkey = user_id%25""",
)
def standing_stream(spark, sf):
    facts = triples(event_stream(spark, sf), F.concat(F.lit("u"), text("user_id")), "did", text("k"))
    patterns = [("?u", "home", "?nation"), ("?nation", "n_name", "?name")]
    found = live.standing_match(facts, homes(spark, sf), ("?u", "did", "?k"), patterns)
    return run_to_table(found.select("u", "k", "nation"))


def timed_facts(spark, sf, kind):
    """What users did, with the time it was done at."""
    did = event_stream(spark, sf).where(F.col("event_type") == kind)
    return did.select(
        F.concat(F.lit("u"), text("user_id")).alias("s"), F.col("event_type").alias("p"), text("k").alias("o"),
        F.lit("lit").alias("o_kind"), F.lit("string").alias("o_type"), v.instant().alias("ts"),
    )


@query(
    "e9_two_live_patterns",
    """with e as (select user_id, event_type, regexp_extract(props, '([0-9]+)', 1) k, ts from events)
    select 'u'||a.user_id u, a.k seen, b.k bought, 'nation.key='||n_nationkey nation, n_name as name, epoch_us(a.ts) first_us, epoch_us(b.ts) second_us
    from e a join e b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase'
      and b.ts >= a.ts and b.ts <= a.ts + interval 12 hours join nation on n_nationkey = a.user_id%25""",
)
def two_live_patterns(spark, sf):
    """What a user bought within twelve hours of a view, and where that user lives."""
    found = live.standing_pair(
        timed_facts(spark, sf, "view"), ("?u", "view", "?seen"),
        timed_facts(spark, sf, "purchase"), ("?u", "purchase", "?bought"),
        "12 hours", "1 hour", homes(spark, sf), [("?u", "home", "?nation"), ("?nation", "n_name", "?name")],
    )
    found = run_to_table(found)
    return found.select(
        "u", "seen", "bought", "nation", "name",
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("second_ts").alias("second_us"),
    )


@query(
    "t12_squeeze_stream",
    "with " + v.FLOW_SQL
    + """, a as (select *, case when full_sig = lag(full_sig) over (partition by pid order by seq) then 0 else 1 end st from flow),
    b as (select *, sum(st) over (partition by pid order by seq rows unbounded preceding) i from a)
    select pid, min(seq) seq, min(fn) fn, count(*) occurrences, max(seq) last_seq from b group by pid, i""",
)
def squeeze_stream(spark, sf):
    keyed_state(spark)
    runs = run_to_end(
        event_stream(spark, sf),
        "ts",
        lambda e: live.squeeze_stream(v.flow_of(e, v.instant().alias("at")), "at", "1 hour", "1 day"),
    )
    return live.settled_runs(runs).select("pid", "seq", "fn", "occurrences", "last_seq")


@query(
    "t31_changes_stream",
    """with a as (select event_id seq, 'u'||user_id s, event_type o,
      lag(event_type) over (partition by user_id order by event_id) was from events)
    select s as object, o as value, seq from a where was is null or was <> o""",
)
def changes_stream(spark, sf):
    keyed_state(spark)

    def changes(e):
        facts = e.select(
            F.concat(F.lit("u"), text("user_id")).alias("object"), F.lit("state").alias("attribute"),
            F.col("event_type").alias("value"), F.col("event_id").alias("seq"), v.instant().alias("at"),
        )
        return live.changes_stream(facts, "at", "1 hour", "1 day")

    return run_to_end(event_stream(spark, sf), "ts", changes).select("object", "value", "seq")


@query(
    "e8_trace_stream",
    CALLS
    + """select seq, pid, fn, case when fn in ('clone@SYS','wait4@SYS') then cast(other_pid as varchar)
      when fn='execve@SYS' then '/usr/bin/python'||k||';["python", "run'||k||'.py"]' else path end sig
      from calls where fn <> 'brk@SYS'""",
)
def trace_stream(spark, sf):
    calls = live.trace_stream(v.lines_of(event_stream(spark, sf)))
    return run_to_table(calls.select("seq", "pid", "fn", F.array_join("sig", ";").alias("sig")))


@query(
    "e8_match_interrupted_stream",
    HALVES
    + """select seq, pid, case when d=1 then ns else ps end partner_seq,
      case when d=-1 then 'merged' when ns is not null then 'matched' else 'unfinished' end status,
      case when d=-1 then pk||','||k else k end args from m
    union all select seq, pid, null, 'resumed', k from n where lev=0""",
)
def match_interrupted_stream(spark, sf):
    keyed_state(spark)
    halves = run_to_end(
        event_stream(spark, sf),
        "ts",
        lambda e: live.match_interrupted_stream(
            v.halves_of(e, v.instant().alias("at")), time="at", late="1 hour", slot="1 day"
        ),
    )
    joined = live.settled_halves(halves)
    return joined.select("seq", "pid", "partner_seq", "status", F.array_join("args", ",").alias("args"))
