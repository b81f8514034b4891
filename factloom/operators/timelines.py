"""Dates of positions: interpolation between releases and pins, and repair of their order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import prepare


def _add(day: Column, days: Column) -> Column:
    return F.date_add(day, days.cast("int"))


def interpolate_ranges(ranges: DataFrame, lead: int = 60, cadence: int = 7) -> DataFrame:
    """Columns series, position, day and approximate of ranges (series, first, last, released, anchor).

    A range's last position lies ``lead`` days before its release, its first one ``cadence`` after the last range's
    end (at the anchor, in the first range). Those between are spread evenly, half-days rounded to even.
    """
    end = _add(F.col("released"), F.lit(-lead))
    before = F.lag("_end").over(Window.partitionBy("series").orderBy("first"))
    rows = ranges.withColumn("_end", end).withColumn("_begin", F.coalesce(_add(before, F.lit(cadence)), F.col("anchor")))
    each = rows.select("*", F.explode(F.sequence("first", "last")).alias("position"))
    steps = F.col("last") - F.col("first")
    share = F.when(steps == 0, 0.0).otherwise(F.date_diff("_end", "_begin") * (F.col("position") - F.col("first")) / F.greatest(steps, F.lit(1)))
    inside = (F.col("position") != F.col("first")) & (F.col("position") != F.col("last"))
    day = F.when(F.col("position") == F.col("last"), F.col("_end")).otherwise(_add(F.col("_begin"), F.bround(share, 0)))
    return each.select("series", "position", day.alias("day"), inside.alias("approximate"))


def interpolate_seasons(seasons: DataFrame) -> DataFrame:
    """Columns season, position, day and approximate of seasons (season, first, last, begins, ends): the first position lies at
    the beginning, the last at the end, those between are spread evenly, half-days rounded to even."""
    each = seasons.select("*", F.explode(F.sequence("first", "last")).alias("position"))
    steps, since = F.col("last") - F.col("first"), F.col("position") - F.col("first")
    inside = (since > 0) & (F.col("position") < F.col("last"))
    spread = F.bround(F.date_diff("ends", "begins") * since / F.greatest(steps, F.lit(1)), 0)
    day = F.when(since == 0, F.col("begins")).when(F.col("position") == F.col("last"), F.col("ends")).otherwise(_add(F.col("begins"), spread))
    return each.select("season", "position", day.alias("day"), inside.alias("approximate"))


def interpolate_pins(positions: DataFrame, pins: DataFrame, cadence: int = 7) -> DataFrame:
    """Columns series, position, day and approximate of positions (series, position) by pins (series, position, day).

    Pins are exact; positions between two are spread evenly, stepping back from the later by ``cadence`` if that lies
    no later than the earlier; those past the last pin step on from it, those before the first step back.
    """
    rows = positions.join(pins, ["series", "position"], "left")
    mark = F.when(F.col("day").isNotNull(), F.struct("position", "day"))
    up, down = (Window.partitionBy("series").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("position"), F.desc("position")))
    rows = rows.withColumn("_a", F.last(mark, True).over(up)).withColumn("_b", F.last(mark, True).over(down))
    span = F.date_diff("_b.day", "_a.day")
    since, until, steps = F.col("position") - F.col("_a.position"), F.col("_b.position") - F.col("position"), F.col("_b.position") - F.col("_a.position")
    between = F.when(span > 0, _add(F.col("_a.day"), F.bround(span * since / F.greatest(steps, F.lit(1)), 0))).otherwise(_add(F.col("_b.day"), -cadence * until))
    day = F.coalesce("day", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), between), _add(F.col("_a.day"), cadence * since), _add(F.col("_b.day"), -cadence * until))
    return rows.select("series", "position", day.alias("day"), F.col("day").isNull().alias("approximate"))


def _outcomes(d: np.ndarray, free: np.ndarray, step: int) -> tuple[list[float], list[float]]:
    """What a block makes of the state that comes in: (bars, ends). The state ends as that of the first bar below it plus ``step``; as
    itself, if there is none. Bars fall, and a free row is one that anything passes."""
    stack, ends = [], np.empty(len(d))  # rows that the state of an earlier one may meet: the nearest last, each with a higher bar
    for i in range(len(d) - 1, -1, -1):
        x = float(d[i])
        low, high = 0, len(stack)  # the nearest whose bar is below x + step: bars rise along the stack
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if stack[middle][0] < x + step else (low, middle)
        ends[i] = stack[low - 1][1] if low else x
        bar = float("-inf") if free[i] else x
        while stack and stack[-1][0] >= bar:
            stack.pop()
        stack.append((bar, float(ends[i])))
    bars, results, lowest = [], [], float("inf")
    for i in range(len(d)):
        bar = float("-inf") if free[i] else float(d[i])
        if bar < lowest:
            bars.append(bar), results.append(float(ends[i]))
            lowest = bar
        if free[i]:
            break
    return bars, results


def enforce_increasing(timeline: DataFrame, step: int = 7, block: int = 4096) -> DataFrame:
    """Columns series, position, day, approximate and warned of a timeline (series, position, day, approximate, hard).

    From the newest to the oldest: a day no earlier than that of the next position, as adjusted, goes ``step`` days before it
    and becomes approximate; hard anchors stay, with a warning. A position without a row or a day binds no other; its row
    stays as it is.

    This is a recurrence, whose state passes through blocks of ``block`` positions. In a series of several blocks, each first
    gives its outcome as a function of the state that comes in, by the days that would stop it; the functions are applied one
    after another, a row for each block; then every block is repaired with its own state. So a series spreads over tasks.
    Rows come to tasks in order, any number of short series to each, and are read in one pass.
    """
    prepare(timeline.sparkSession)
    rows = timeline.select("series", "position", "day", "approximate", F.coalesce("hard", F.lit(False)).alias("hard"))
    none = F.lit(None).cast("double")
    dated = rows.where("day is not null and position is not null").select("series", F.floor(F.col("position") / block).alias("_block"), F.col("position").cast("long").alias("position"), F.unix_date("day").alias("_d"), "approximate", "hard", none.alias("_state"))
    kind = timeline.schema["series"].dataType.simpleString()

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told(*groups) -> pa.RecordBatch:
            made = []
            for (series, number), group in groups:
                at, days, hard = (np.array(x) for x in zip(*group))
                free = np.concatenate([[False], at[:-1] - at[1:] != 1]) | hard.astype(bool)
                made.append((series, number, int(at[0]), int(at[-1]), *_outcomes(days - step * at, free, step)))
            columns = list(zip(*made)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (into, *[pa.int64()] * 3, *[pa.list_(pa.float64())] * 2))], ["series", "_block", "_from", "_to", "_bars", "_ends"])

        for batch in batches:
            into, ready = batch.schema.field("series").type, []
            for series, number, *row in zip(*(batch.column(c).to_pylist() for c in ("series", "_block", "position", "_d", "hard"))):
                if key != (series, number):
                    if held:
                        ready.append((key, held))
                    key, held = (series, number), []
                held.append(row)
            yield told(*ready)
        if held:
            yield told((key, held))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, to = None, float("inf"), None
        for batch in batches:
            out = []
            for series, top, low, bars, ends in zip(*(batch.column(c).to_pylist() for c in ("series", "_from", "_to", "_bars", "_ends"))):
                state = state if key == (series,) and to == top + 1 else float("inf")
                out.append(state)
                first = int((np.asarray(bars) >= state + step).sum())  # bars fall
                key, state, to = (series,), (ends[first] if first < len(bars) else state), low
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("_block"), pa.array(out, pa.float64())], ["series", "_block", "_state"])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, bound, state = None, None, float("inf"), float("inf")
        for batch in batches:
            days, moved, warned = [], [], []
            for series, number, at, day, hard, given in zip(*(batch.column(c).to_pylist() for c in ("series", "_block", "position", "_d", "hard", "_state"))):
                if key != (series, number):
                    key, last, state = (series, number), None, float("inf")
                if at is None:
                    state, late = given, False
                else:
                    bound = bound if last == at + 1 else state + step * (at + 1) if last is None else float("inf")
                    late = day >= bound
                    day = int(bound) - step if late and not hard else day
                    last, bound = at, day
                days.append(day), moved.append(late and not hard), warned.append(late and hard)
            real = pc.is_valid(batch.column("position"))
            said = pc.or_kleene(batch.column("approximate"), pa.array(moved, pa.bool_()))  # null or true is true
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("position"), pa.array(days, pa.int64()), said, pa.array(warned, pa.bool_())], ["series", "position", "_d", "approximate", "warned"]).filter(real)

    several = dated.groupBy("series").agg(F.min("_block").alias("_lo"), F.max("_block").alias("_hi")).where("_lo < _hi").select(F.col("series").alias("_s"))
    long = dated.join(several, F.col("series").eqNullSafe(F.col("_s")), "left_semi")
    known = long.repartition("series", "_block").sortWithinPartitions("series", "_block", F.desc("position")).mapInArrow(outcome, f"series {kind}, _block long, _from long, _to long, _bars array<double>, _ends array<double>")
    states = known.repartition("series").sortWithinPartitions("series", F.desc("_block")).mapInArrow(passed, f"series {kind}, _block long, _state double")
    # a block's state stands before its rows
    both = dated.unionByName(states, allowMissingColumns=True).repartition("series", "_block").sortWithinPartitions("series", "_block", F.desc_nulls_first("position"))
    fixed = both.mapInArrow(repair, f"series {kind}, position long, _d long, approximate boolean, warned boolean")
    fixed = fixed.select("series", "position", F.date_from_unix_date(F.col("_d").cast("int")).alias("day"), "approximate", "warned")
    rest = rows.where("day is null or position is null").select("series", F.col("position").cast("long").alias("position"), F.lit(None).cast("date").alias("day"), "approximate", F.lit(False).alias("warned"))
    return fixed.unionByName(rest)


def release_timeline(**sources: DataFrame) -> DataFrame:
    """Columns kind, key and day: dated tables (key, day) put together."""
    out = None
    for kind, df in sources.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), F.to_date("day").alias("day")).where("day is not null")
        out = rows if out is None else out.unionByName(rows)
    return out
