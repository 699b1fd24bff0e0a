"""Repeats, pairs and sequences in the flows of calls.

A flow table has (session, pid, seq, fn, sig, t_start, t_end); ``sig`` are the
significant arguments. Every step works piecewise (operators/ordered.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sysweave.operators.calls import FLOW, NEVER_EQUAL, drop_adjacent_matched, flow_counts
from sysweave.operators.ordered import PIECE, islands, piece_of, scan
from sysweave.session import cut

ROW = ["fn", "sig", "t_start", "t_end"]


def signature(fn: Column, sig: Column) -> Column:
    return F.concat(fn, F.lit(":"), F.array_join(sig, "&", "None"))


def squeeze_repeats(calls: DataFrame, chunk: int | None = None) -> DataFrame:
    """Runs of equal calls as one row with ``occurrences``, from the first start to the last end."""
    single = F.when(F.col("fn").isin(NEVER_EQUAL), F.col("seq"))
    runs = islands(
        calls.select(*FLOW, "seq", *ROW),
        FLOW,
        {"fn": F.col("fn"), "sig": F.col("sig"), "single": single},
        chunk=chunk,
    )
    return (
        runs.groupBy(*FLOW, "island")
        .agg(
            F.min_by(F.struct("seq", "fn", "sig", "t_start"), "seq").alias("_first"),
            F.max_by("t_end", "seq").alias("t_end"),
            F.count(F.lit(1)).alias("occurrences"),
        )
        .select(*FLOW, "_first.*", "t_end", "occurrences")
    )


def bigram_stats(calls: DataFrame) -> DataFrame:
    """(session, pid, first, second, n): how often one call follows another."""
    named = calls.select(*FLOW, "seq", signature(F.col("fn"), F.col("sig")).alias("first"))
    pairs = scan(named, FLOW, following={"second": F.col("first")})
    return (
        pairs.where("second is not null")
        .groupBy(*FLOW, "first", "second")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bigram_pass(flow: DataFrame, min_count: int = 5, chunk: int | None = None) -> DataFrame:
    """One replacement pass over frequent pairs.

    A pair seen more than ``min_count`` times in its flow is replaced by a
    sequence, left to right without overlap: inside a run of frequent starts,
    every second one is taken. Neighbouring equal sequences become one.
    ``taken`` tells how many pairs a row stands for in this pass.
    """
    after = scan(
        flow,
        FLOW,
        following={"_next": F.struct(signature(F.col("fn"), F.col("sig")).alias("text"))},
        sums={"_pos": F.lit(1)},
        chunk=chunk,
    )
    # A pair is told by 128 bits of its text: names get longer with each pass, and rows are dealt out by pair.
    text = F.concat_ws("+", signature(F.col("fn"), F.col("sig")), "_next.text")
    pair = {"_pair": F.xxhash64(text), "_pair2": F.xxhash64(F.lit(1), text)}
    more = F.col("_next").isNotNull().alias("_more")
    # Written, since the counts and the replacement both read it.
    after = cut(after.withColumns(pair).select(*flow.columns, "_pos", more, *pair), compression="zstd")
    frequent = (
        after.where("_more")
        .groupBy(*FLOW, *pair)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > min_count)
        .select(*FLOW, *pair, F.lit(True).alias("_often"))
    )
    often = F.col("_often").isNotNull() & F.col("_more")
    marked = after.join(frequent, [*FLOW, *pair], "left").select(*flow.columns, "_pos", often.alias("_often"))
    # Written, so that the rows are dealt out by pair once and not for both reads of the scan. The next call is
    # looked up again, by the same order, so that it does not travel with the pair.
    marked = cut(marked, compression="zstd")
    run = scan(
        marked,
        FLOW,
        "_pos",
        following={"_next": F.struct("fn", "sig", "t_end")},
        last_before={"_break": F.when(~F.col("_often"), F.col("_pos"))},
        chunk=chunk,
    ).withColumn("_off", F.col("_pos") - F.coalesce(F.col("_break"), F.lit(0)))
    taken = F.col("_often") & (F.col("_off") % 2 == 1)
    # The second call of a pair is the row after an odd offset of the run.
    absorbed = (F.col("_off") > 1) & (F.col("_off") % 2 == 0)
    kept = cut(run.where(~absorbed).select(
        *FLOW,
        "seq",
        F.when(taken, F.concat(F.lit("("), "fn", F.lit("+"), F.col("_next.fn"), F.lit(")")))
        .otherwise(F.col("fn"))
        .alias("fn"),
        F.when(taken, F.array_distinct(F.concat("sig", F.col("_next.sig"))))
        .otherwise(F.col("sig"))
        .alias("sig"),
        "t_start",
        F.when(taken, F.col("_next.t_end")).otherwise(F.col("t_end")).alias("t_end"),
        F.when(taken, F.lit("Rept")).otherwise(F.col("style")).alias("style"),
        F.when(taken, F.lit(1).cast("long")).otherwise(F.col("occurrences")).alias("occurrences"),
        taken.cast("int").alias("_taken"),
    ), compression="zstd")
    merged = islands(
        kept,
        FLOW,
        {
            "alone": F.when(F.col("_taken") == 0, F.col("seq")),
            "fn": F.col("fn"),
            "sig": F.col("sig"),
        },
        chunk=chunk,
    )
    return (
        merged.groupBy(*FLOW, "island")
        .agg(
            F.min_by(F.struct("seq", "fn", "sig", "t_start", "style"), "seq").alias("_f"),
            F.max_by("t_end", "seq").alias("t_end"),
            F.sum("occurrences").alias("occurrences"),
            F.sum("_taken").alias("taken"),
        )
        .select(*FLOW, "_f.*", "t_end", "occurrences", "taken")
    )


def as_flow(calls: DataFrame) -> DataFrame:
    """Calls with the ``style`` and ``occurrences`` the passes carry along."""
    has = set(calls.columns)
    return calls.select(
        *FLOW,
        "seq",
        *ROW,
        (F.col("style") if "style" in has else F.lit("Orig")).alias("style"),
        (F.col("occurrences") if "occurrences" in has else F.lit(1)).cast("long").alias("occurrences"),
    )


def cluster_bigrams(calls: DataFrame, min_count: int = 5, chunk: int | None = None) -> DataFrame:
    """Replace frequent pairs until none is left.

    Counts are per pass and per flow. A flow without replacement is finished and
    is not read again; each pass is written to the shared folder, and so are the flows
    it changed, so that their size is known and few of them do not move the rows.
    """
    active = cut(as_flow(calls), compression="zstd")
    done: DataFrame | None = None
    while True:
        step = cut(bigram_pass(active, min_count, chunk), compression="zstd")
        busy = cut(step.where("taken > 0").select(*FLOW).distinct())
        finished = step.join(busy, FLOW, "left_anti").drop("taken")
        done = finished if done is None else done.unionByName(finished)
        active = step.join(busy, FLOW, "left_semi").drop("taken")
        if active.isEmpty():
            return done


def argument_runs(calls: DataFrame, chunk: int | None = None) -> DataFrame:
    """Calls with ``island``: the runs of calls with the same arguments."""
    return islands(calls, FLOW, {"sig": F.col("sig")}, chunk=chunk)


def cluster_by_args(calls: DataFrame, chunk: int | None = None) -> DataFrame:
    """Runs of two or more calls with the same arguments as one sequence, style ``Args``.

    Calls without arguments stay alone. A run is one row, whatever pieces of the
    flow it lies in: names are put together by piece first, then by run.
    """
    runs = argument_runs(as_flow(calls), chunk).withColumn(PIECE, piece_of("seq", chunk))
    runs = runs.withColumn("_alone", F.when(F.size("sig") == 0, F.col("seq")))
    group = [*FLOW, "island", "_alone"]
    names = F.array_sort(F.collect_list(F.struct("seq", "fn")))
    parts = runs.groupBy(*group, PIECE).agg(
        F.min_by(F.struct("seq", "fn", "sig", "t_start", "style"), "seq").alias("_first"),
        F.max_by("t_end", "seq").alias("_end"),
        F.array_join(F.transform(names, lambda x: x["fn"]), "+").alias("_names"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("occurrences").alias("_occurrences"),
    )
    pieces = F.array_sort(F.collect_list(F.struct(PIECE, "_names")))
    whole = parts.groupBy(*group).agg(
        F.min_by("_first", PIECE).alias("_f"),
        F.max_by("_end", PIECE).alias("t_end"),
        F.array_join(F.transform(pieces, lambda x: x["_names"]), "+").alias("_text"),
        F.sum("_n").alias("calls"),
        F.sum("_occurrences").alias("_occurrences"),
    )
    many = F.col("calls") > 1
    return whole.select(
        *FLOW,
        F.col("_f.seq").alias("seq"),
        F.when(many, F.concat(F.lit("("), "_text", F.lit(")")))
        .otherwise(F.col("_f.fn"))
        .alias("fn"),
        F.col("_f.sig").alias("sig"),
        F.col("_f.t_start").alias("t_start"),
        "t_end",
        F.when(many, F.lit("Args")).otherwise(F.col("_f.style")).alias("style"),
        F.when(many, F.lit(1)).otherwise(F.col("_occurrences")).cast("long").alias("occurrences"),
        "calls",
    )


def sequence_duration(sequences: DataFrame) -> DataFrame:
    """Add ``duration`` in seconds: end of the last call less start of the first.

    Both are instants; ``with_dates`` makes them out of the times of the day a
    log prints.
    """
    micros = F.unix_micros("t_end") - F.unix_micros("t_start")
    return sequences.withColumn("duration", micros / 1_000_000)


def factorise(calls: DataFrame, min_count: int = 5) -> DataFrame:
    """The whole chain: adjacent halves dropped, repeats, frequent pairs, equal arguments."""
    halves = drop_adjacent_matched(calls) if "partner_seq" in calls.columns else calls
    return cluster_by_args(cluster_bigrams(squeeze_repeats(halves), min_count))


# Named ways to shorten flows; callers may add their own.
AGGREGATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "counts": flow_counts,
    "clusters": factorise,
}


def squeeze_periods(
    symbols: DataFrame, max_len: int, keys=("seq_id",), pos: str = "pos", chunk: int | None = None
) -> DataFrame:
    """(keys, pos, symbol) to blocks: for each length 1..max_len, tandem repeats of that
    many elements become one block with ``times``; elements are blocks of the
    lengths before.

    ``block`` lists the labels of the elements, ``width`` counts the symbols the
    block expands to, ``pos`` is the position of its first symbol. An element that
    is not repeated keeps its own label, so this is the simplified form.
    """
    return squeeze_levels(symbols, max_len, keys, pos, chunk)[-1]


def squeeze_levels(
    symbols: DataFrame, max_len: int, keys=("seq_id",), pos: str = "pos", chunk: int | None = None
) -> list[DataFrame]:
    """The written tables of ``squeeze_periods``, one per length, from 0 (the symbols)."""
    keys = list(keys)
    level = symbols.select(
        *keys, F.col(pos).alias("pos"), F.array("symbol").alias("block"),
        F.lit(1).cast("long").alias("times"), F.lit(1).cast("long").alias("width"),
    )
    levels = [cut(level)]
    for k in range(1, max_len + 1):
        levels.append(cut(_squeeze_level(levels[-1], k, keys, chunk)))
    return levels


def label(block: Column, times: Column) -> Column:
    """Text that identifies a block: a symbol is its own label."""
    return F.when((times == 1) & (F.size(block) == 1), F.get(block, F.lit(0))).otherwise(
        F.concat(F.to_json(block), F.lit("*"), times.cast("string"))
    )


def inflate(levels: list[DataFrame], keys=("seq_id",)) -> DataFrame:
    """(keys, pos, order, symbol): the sequence ``squeeze_levels`` started from.

    ``order`` sorts the symbols a row of the last level expands to. Repeats are
    made as rows in two steps, so that a long run is never one array.
    """
    keys = list(keys)
    rows = levels[-1].withColumn("order", F.array().cast("array<bigint>"))
    step = 1 << 16
    for below in reversed([None, *levels[:-1]]):
        parts = rows.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / step))))
        least = F.least(F.col("times") - F.col("_p") * step, F.lit(step))
        turns = parts.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), (least - 1).cast("long"))))
        turn = (F.col("_p") * step + F.col("_t")).cast("long")
        items = turns.select(
            *keys, "pos", "order", turn.alias("_turn"), F.posexplode("block").alias("_at", "label")
        ).select(
            *keys,
            "pos",
            F.concat("order", F.array(F.col("_turn"), F.col("_at").cast("long"))).alias("order"),
            "label",
        )
        if below is None:
            return items.withColumnRenamed("label", "symbol")
        # A label stands for one block of the level below.
        blocks = below.select(label(F.col("block"), F.col("times")).alias("label"), "block", "times")
        rows = items.join(blocks.dropDuplicates(["label"]), "label").drop("label")
    raise ValueError("no levels")


def _squeeze_level(level: DataFrame, k: int, keys: list[str], chunk: int) -> DataFrame:
    """Greedy tandem repeats of ``k`` elements, left to right.

    A maximal run of L elements equal to the one k later, L >= k, holds
    1 + floor(L / k) blocks. Blocks of one run may reach into the next by less
    than k elements, so the start of a run is moved to the end of the run
    before; these moves are repeated until none changes.
    """
    named = level.withColumn("_label", label(F.col("block"), F.col("times")))
    named = cut(scan(named, keys, "pos", sums={"n": F.lit(1)}, chunk=chunk))
    # The element k further on; numbers are unique in a flow.
    ahead = named.select(*keys, (F.col("n") - k).alias("n"), F.col("_label").alias("_ahead"))
    equal = F.coalesce(F.col("_label") == F.col("_ahead"), F.lit(False))
    flagged = cut(
        named.select(*keys, "pos", "n", "_label")
        .join(ahead, [*keys, "n"], "left")
        .select(*keys, "pos", "n", equal.alias("_same"))
    )
    runs = scan(
        flagged, keys, "pos", last_before={"_gap": F.when(~F.col("_same"), F.col("n"))}, chunk=chunk
    ).withColumn("_run", F.coalesce("_gap", F.lit(0)))
    lengths = (
        runs.where("_same")
        .groupBy(*keys, "_run")
        .agg(F.count(F.lit(1)).alias("len"))
        .where(F.col("len") >= k)
        .withColumn("start", F.col("_run") + 1)
        .withColumn("stop", F.col("_run") + F.col("len"))
    )
    # from: where the run may begin, after the blocks of the run before it.
    found = cut(lengths.withColumn("from", F.col("start")))
    while k > 1:  # blocks of one element cannot reach into the next run
        left = F.col("stop") - F.col("from") + 1
        end = F.when(left >= k, F.col("from") + (1 + F.floor(left / k)) * k)
        moved = scan(found, keys, "start", last_before={"_end": end}, chunk=chunk)
        new = cut(
            moved.withColumn(
                "to", F.greatest("start", F.coalesce("_end", F.lit(0))).cast("long")
            ).drop("_end")
        )
        settled = new.where(F.col("to") != F.col("from")).isEmpty()
        found = new.withColumn("from", F.col("to")).drop("to")
        if settled:
            break
    blocks = found.withColumn(
        "times", (1 + F.floor((F.col("stop") - F.col("from") + 1) / k)).cast("long")
    ).where(F.col("stop") - F.col("from") + 1 >= k)
    heads = blocks.select(*keys, F.col("from").alias("n"), "times")
    marked = named.join(
        heads.withColumnRenamed("times", "_times"), [*keys, "n"], "left"
    )
    # Elements inside the blocks of a run belong to its head.
    owner = scan(
        marked,
        keys,
        "pos",
        last={
            "_head": F.when(
                F.col("_times").isNotNull(), F.struct(F.col("n").alias("n"), F.col("_times").alias("t"))
            )
        },
        chunk=chunk,
    )
    inside = F.col("_head").isNotNull() & (F.col("n") < F.col("_head.n") + F.col("_head.t") * k)
    offset = F.col("n") - F.col("_head.n")
    alone = owner.where(~F.coalesce(inside, F.lit(False))).select(
        *keys, "pos", F.array("_label").alias("block"), F.lit(1).cast("long").alias("times"), "width"
    )
    # A block has k elements, whatever the number of its repeats.
    shape = F.array_sort(F.collect_list(F.when(F.col("_o") < k, F.struct("_o", "_label"))))
    repeated = (
        owner.where(inside)
        .withColumns({"_o": offset, "_h": F.col("_head.n"), "_t": F.col("_head.t")})
        .groupBy(*keys, "_h", "_t")
        .agg(
            F.min("pos").alias("pos"),
            F.transform(shape, lambda x: x["_label"]).alias("block"),
            F.sum("width").alias("width"),
        )
        .select(*keys, "pos", "block", F.col("_t").alias("times"), "width")
    )
    return alone.unionByName(repeated)


def principal_period(text: Column) -> Column:
    """Least rotation that maps a text to itself, -1 when there is none."""
    twice = F.substr(F.concat(text, text), F.lit(2), F.greatest(F.length(text) * 2 - 2, F.lit(0)))
    at = F.position(text, twice)
    return F.when(at > 0, at).otherwise(-1)


def principal_periods(rows: DataFrame, keys: list[str], seq: str, symbol: str) -> DataFrame:
    """(keys, n, period): the least rotation that maps each sequence of rows to itself, -1 when there is none.

    A rotation divides the length n, and rotations that map a sequence to itself have
    their greatest common divisor among them. So from the rotation n, one prime factor at a time
    is taken away as long as what is left still maps: at most log2 n rounds for all
    sequences together, each one aggregation by place modulo the rotation tried. A long
    sequence is spread over as many groups as that rotation has places; nulls are equal to
    each other. Places are numbered piecewise (``scan``).
    """
    numbered = scan(rows.select(*keys, seq, symbol), keys, seq, sums={"_place": F.lit(1)})
    value = F.xxhash64(F.col(symbol).isNull(), symbol), F.coalesce(F.col(symbol).cast("string"), F.lit(""))
    placed = cut(
        numbered.select(*keys, (F.col("_place") - 1).alias("_place"), F.struct(*value).alias("_symbol"))
    )
    state = cut(
        placed.groupBy(*keys).agg(F.count("*").alias("n")).withColumns({"period": F.col("n"), "_rest": F.col("n")})
    )
    while not (open_ := state.where("_rest > 1")).isEmpty():
        prime = F.expr("coalesce(get(filter(sequence(2L, cast(sqrt(_rest) as bigint) + 1), x -> x < _rest and _rest % x = 0), 0), _rest)")
        tried = cut(open_.withColumn("_prime", prime).withColumn("_turn", F.expr("period div _prime")))
        same = (
            placed.join(tried.select(*keys, "_turn"), keys)
            .groupBy(*keys, (F.col("_place") % F.col("_turn")).alias("_at"))
            .agg(F.min("_symbol").alias("_x"), F.max("_symbol").alias("_y"))
            .groupBy(*keys)
            .agg(F.min((F.col("_x") == F.col("_y")).cast("int")).alias("_maps"))
        )
        # Where a prime does not go, none of its powers does.
        stripped = F.expr(
            "aggregate(sequence(1, 63), _rest, (r, i) -> case when r % _prime = 0 then r div _prime else r end)"
        )
        maps = F.col("_maps") == 1
        moved = tried.join(same, keys).select(
            *keys,
            "n",
            F.when(maps, F.col("_turn")).otherwise(F.col("period")).alias("period"),
            F.when(maps, F.expr("_rest div _prime")).otherwise(stripped).alias("_rest"),
        )
        state = cut(state.where("_rest <= 1").unionByName(moved))
    return state.select(*keys, "n", F.when(F.col("period") < F.col("n"), F.col("period")).otherwise(-1).alias("period"))
