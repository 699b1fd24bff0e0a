"""Order-dependent columns over flows of any length.

A plain window over (session, pid) puts a whole flow into one task; one flow may
be a third of the data. Here a flow is cut into pieces of ``chunk`` consecutive
sequence numbers. ``seq`` is an integer, unique within the keys, so a piece
has at most ``chunk`` rows. Values are computed per piece, what one piece
hands to the next is computed from one summary row per piece, and both are
joined on (keys, piece). No task ever sees more than ``chunk`` rows of a flow.

Where numbers have wide gaps, pieces of consecutive numbers hold few rows and the
summary is as long as the flow. ``with_pieces`` cuts such flows by rows instead, and
``numbered`` gives them numbers without gaps, for steps that make their own pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sysweave.session import cut

CHUNK = 1 << 20
PIECE = "_piece"


def piece_of(seq: str, chunk: int | None = None) -> Column:
    """Number of the piece a row belongs to, by whole numbers."""
    return F.expr(f"cast(`{seq}` as bigint) div {chunk or CHUNK}")


def with_pieces(
    df: DataFrame, keys: Sequence[str], seq: str = "seq", chunk: int | None = None
) -> DataFrame:
    """Add the piece of each row, cut by rows: a piece has at most twice ``chunk`` rows,
    however the numbers are spread.

    A flow of at most twice ``chunk`` rows is one piece. A longer one is cut into as many
    equal ranges of numbers as it has chunks; a range that still holds too many rows is
    cut again between its own least and greatest number, until none is left. Evenly
    spread numbers take one round, whatever the gaps; each round adds no more pieces than
    the ranges it cuts hold chunks. The table of ranges to cut has one
    row for two chunks of rows at most. Numbers lie between -2^62 and 2^62; rows that share a
    number or have none are not parted. The input is read again in each round.
    """
    chunk = chunk or CHUNK
    on = [*keys, PIECE]
    number = F.col(seq).cast("bigint")
    placed = df.drop(PIECE).withColumn(PIECE, F.lit(0).cast("bigint"))
    inside = placed
    while True:
        ranges = inside.groupBy(*on).agg(
            F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.count(number).alias("_n")
        )
        parts = f"((_n + {chunk - 1}) div {chunk})"
        wide = cut(
            ranges.where((F.col("_n") > 2 * chunk) & (F.col("_hi") > F.col("_lo"))).select(
                *on, "_lo", F.expr(f"(_hi - _lo + {parts}) div {parts}").alias("_step")
            )
        )
        if wide.isEmpty():
            return placed
        start = F.expr(f"_lo + ((cast(`{seq}` as bigint) - _lo) div _step) * _step")
        found = placed.join(wide, on, "left").withColumn(PIECE, F.coalesce(start, F.col(PIECE)))
        inside = found.where("_lo is not null").select(*on, seq)
        placed = found.drop("_lo", "_step")


def numbered(
    df: DataFrame, keys: Sequence[str], seq: str = "seq", was: str | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """``df`` with ``seq`` counted from 0 within the keys, in its order; ``was`` names a column
    that keeps the number given before. Rows without a number are left out."""
    placed = with_pieces(df.where(F.col(seq).isNotNull()), keys, seq, chunk)
    counted = scan(placed, keys, seq, sums={"_rank": F.lit(1)}, chunk=chunk)
    rank = (F.col("_rank") - 1).alias(seq)
    columns = [rank if c == seq else F.col(f"`{c}`") for c in df.columns if c != PIECE]
    return counted.select(*columns, *([F.col(seq).alias(was)] if was else []))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    seq: str = "seq",
    *,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    depth: Mapping[str, Column] | None = None,
    chunk: int | None = None,
    keep_piece: bool = False,
) -> DataFrame:
    """Add order-dependent columns to ``df``; pieces ``with_pieces`` made are used.

    ``keep_piece`` leaves the piece number in place, so that a next scan with
    the same keys finds its rows already shuffled as it needs them.

    previous / following: value of the expression on the row before / after.
    sums: running sum, this row included.
    last / last_before: latest non-null value up to / strictly before this row.
    depth: running sum of +1/-1 steps that never goes below zero; ``name_before`` is
    its value before the row.

    The input is read twice, once for the summaries with only the columns they
    need: put steps that chain several scans on a written table.
    """
    chunk = chunk or CHUNK
    previous, following = dict(previous or {}), dict(following or {})
    sums, last = dict(sums or {}), dict(last or {})
    last_before, depth = dict(last_before or {}), dict(depth or {})
    keys = list(keys)

    cut_up = df
    if PIECE not in df.columns:
        cut_up = df.withColumn(PIECE, piece_of(seq, chunk))
    group = [*keys, PIECE]
    inside = Window.partitionBy(*group).orderBy(seq)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    by_piece = Window.partitionBy(*keys).orderBy(PIECE)

    local, summary, carried, final = [], [], [], {}
    for n, (name, expr) in enumerate(previous.items()):
        local.append(F.lag(F.struct(expr.alias("v"))).over(inside).alias(f"_lp{n}"))
        summary.append(F.max_by(F.struct(expr.alias("v")), F.col(seq)).alias(f"_sp{n}"))
        carried.append(F.lag(f"_sp{n}").over(by_piece).alias(f"_cp{n}"))
        final[name] = F.coalesce(F.col(f"_lp{n}"), F.col(f"_cp{n}"))["v"]
    for n, (name, expr) in enumerate(following.items()):
        local.append(F.lead(F.struct(expr.alias("v"))).over(inside).alias(f"_lf{n}"))
        summary.append(F.min_by(F.struct(expr.alias("v")), F.col(seq)).alias(f"_sf{n}"))
        carried.append(F.lead(f"_sf{n}").over(by_piece).alias(f"_cf{n}"))
        final[name] = F.coalesce(F.col(f"_lf{n}"), F.col(f"_cf{n}"))["v"]
    for n, (name, expr) in enumerate(sums.items()):
        local.append(F.sum(expr).over(upto).alias(f"_ls{n}"))
        summary.append(F.sum(expr).alias(f"_ss{n}"))
        carried.append(F.coalesce(F.sum(f"_ss{n}").over(earlier), F.lit(0)).alias(f"_cs{n}"))
        final[name] = F.coalesce(F.col(f"_ls{n}"), F.lit(0)) + F.col(f"_cs{n}")
    for tag, specs, frame in (("a", last, upto), ("b", last_before, before)):
        for n, (name, expr) in enumerate(specs.items()):
            local.append(F.last(expr, ignorenulls=True).over(frame).alias(f"_ll{tag}{n}"))
            summary.append(
                F.max_by(expr, F.when(expr.isNotNull(), F.col(seq))).alias(f"_sl{tag}{n}")
            )
            carried.append(
                F.last(f"_sl{tag}{n}", ignorenulls=True).over(earlier).alias(f"_cl{tag}{n}")
            )
            final[name] = F.coalesce(F.col(f"_ll{tag}{n}"), F.col(f"_cl{tag}{n}"))

    rows = cut_up.select("*", *local) if local else cut_up
    if depth:
        # The lowest point inside a piece depends on the order of its rows.
        sums_in = [F.sum(expr).over(upto).alias(f"_ld{n}") for n, expr in enumerate(depth.values())]
        rows = rows.select("*", *sums_in)
        lows = []
        for n in range(len(depth)):
            lows.append(F.min(f"_ld{n}").over(upto).alias(f"_lm{n}"))
            lows.append(F.lag(f"_ld{n}", 1, 0).over(inside).alias(f"_lq{n}"))
            lows.append(F.min(f"_ld{n}").over(before).alias(f"_lr{n}"))
        rows = rows.select("*", *lows)
        for n, (name, expr) in enumerate(depth.items()):
            summary.append(F.sum(expr).alias(f"_sd{n}"))
            summary.append(F.min(f"_ld{n}").alias(f"_sm{n}"))
            carried.append(F.coalesce(F.sum(f"_sd{n}").over(earlier), F.lit(0)).alias(f"_cd{n}"))
            base, low = F.col(f"_cd{n}"), F.coalesce(F.col(f"_cm{n}"), F.lit(0))
            final[name] = base + F.col(f"_ld{n}") - F.least(F.lit(0), low, base + F.col(f"_lm{n}"))
            # ``least`` skips nulls: the first row of a piece has nothing before it.
            final[f"{name}_before"] = (
                base + F.col(f"_lq{n}") - F.least(F.lit(0), low, base + F.col(f"_lr{n}"))
            )
    summed = (rows if depth else cut_up).groupBy(*group).agg(*summary)
    hand_over = summed.select(*group, *carried, *[f"_sm{n}" for n in range(len(depth))])
    for n in range(len(depth)):
        hand_over = hand_over.withColumn(
            f"_cm{n}", F.min(F.col(f"_cd{n}") + F.col(f"_sm{n}")).over(earlier)
        )
    joined = rows.join(hand_over, group)
    kept = [c for c in df.columns if c != PIECE] + ([PIECE] if keep_piece else [])
    return joined.select(*kept, *[expr.alias(name) for name, expr in final.items()])


def count_steps(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    probe: Mapping[str, Column],
    changed: Callable[[Column, Column], Column],
    name: str,
    first: int = 1,
    chunk: int | None = None,
) -> DataFrame:
    """Add ``name``: how many rows so far changed against the row before them.

    ``probe`` names the values compared; ``changed`` takes them, as structs, of
    the row before and of this row. ``first`` is what the first row of a flow
    counts. What a piece hands on is its first and last values and its count, so
    this takes one scan and not two. Pieces ``with_pieces`` made are used.
    """
    chunk = chunk or CHUNK
    keys = list(keys)
    group = [*keys, PIECE]
    inside = Window.partitionBy(*group).orderBy(seq)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_piece = Window.partitionBy(*keys).orderBy(PIECE)
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    now = F.struct(*[v.alias(k) for k, v in probe.items()])
    piece = F.col(PIECE) if PIECE in df.columns else piece_of(seq, chunk)

    def step(before: Column, here: Column) -> Column:
        return F.coalesce(changed(before, here), F.lit(True)).cast("int")

    def flagged(source: DataFrame) -> DataFrame:
        with_lag = source.withColumn("_was", F.lag("_now").over(inside))
        flag = F.when(F.col("_was").isNull(), 0).otherwise(step(F.col("_was"), F.col("_now")))
        return with_lag.withColumn("_flag", flag)

    rows = df.withColumns({PIECE: piece, "_now": now})
    local = flagged(rows).withColumn("_local", F.sum("_flag").over(upto))
    summed = (
        flagged(rows.select(*group, seq, "_now"))
        .groupBy(*group)
        .agg(
            F.min_by("_now", seq).alias("_head"),
            F.max_by("_now", seq).alias("_tail"),
            F.sum("_flag").alias("_n"),
        )
        .withColumn("_before", F.lag("_tail").over(by_piece))
    )
    start = F.when(F.col("_before").isNull(), first).otherwise(
        step(F.col("_before"), F.col("_head"))
    )
    carry = summed.withColumn("_start", start).select(
        *group,
        (F.coalesce(F.sum(F.col("_n") + F.col("_start")).over(earlier), F.lit(0)) + F.col("_start"))
        .alias("_base"),
    )
    return local.join(carry, group).select(
        *df.columns, (F.col("_base") + F.col("_local")).alias(name)
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    same_as_previous: Mapping[str, Column],
    seq: str = "seq",
    name: str = "island",
    chunk: int | None = None,
) -> DataFrame:
    """Number the runs of rows that continue the row before them: all expressions of
    ``same_as_previous`` have the same value, nulls included."""

    def changed(before: Column, here: Column) -> Column:
        same = F.lit(True)
        for k in same_as_previous:
            same = same & before[k].eqNullSafe(here[k])
        return ~same

    return count_steps(df, keys, seq, same_as_previous, changed, name, chunk=chunk)
