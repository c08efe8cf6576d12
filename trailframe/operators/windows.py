"""Ordered operators over one recording: dedup, distance, smoothing, islands, order tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import haversine
from ..model import Activities


def keep_last(df: DataFrame, keys, *more: str, only: Column | None = None) -> DataFrame:
    """Of rows with one time the last in list order; seq is numbered anew by time. only: a condition per recording.

    Both windows have one partitioning and one order (within a time the last row comes first), so it is one shuffle and
    one sort.
    """
    part = Window.partitionBy(*keys, *more)
    latest_first = part.orderBy("time", F.desc("seq"))
    before = df.withColumns({"_t": F.lag("time").over(latest_first), "_r": F.row_number().over(latest_first)})
    last, place = (F.col("_r") == 1) | ~F.col("_t").eqNullSafe(F.col("time")), (F.row_number().over(part.orderBy("time")) - 1).cast("long")
    once = before.where(last if only is None else last | ~only).drop("_t", "_r")
    if only is None:
        return once.withColumn("seq", place)
    return once.withColumn("_place", place).withColumn("seq", F.when(only, F.col("_place")).otherwise(F.col("seq"))).drop("_place")


def sort_and_dedup(a: Activities) -> Activities:
    """WIN-5: points and channels by time with the last of equal times; laps by start."""
    laps = None
    if a.laps is not None:
        order = Window.partitionBy(*a.keys).orderBy("start_time", "lap_no")
        laps = a.laps.withColumn("_n", F.row_number().over(order).cast("int")).withColumn("lap_no", F.col("_n")).drop("_n")
    return a.having(points=None if a.points is None else keep_last(a.points, a.keys), samples=None if a.samples is None else keep_last(a.samples, a.keys, "channel"), laps=laps)


def with_step(df: DataFrame, w, out: str = "step_m", neighbour=F.lag) -> DataFrame:
    """df with the metres from the row before (or with F.lead to the row after), null where there is none."""
    near = df.withColumns({"_lat": neighbour("latitude").over(w), "_lon": neighbour("longitude").over(w)})
    return near.withColumn(out, haversine(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))).drop("_lat", "_lon")


def cumulative_distance(a: Activities) -> DataFrame:
    """WIN-2: points with step_m and the running total distance_m, in list order."""
    w = a.by_seq()
    stepped = with_step(a.points, w).withColumn("step_m", F.coalesce("step_m", F.lit(0.0)))
    return stepped.withColumn("distance_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _with_channel(a: Activities, rows: DataFrame, *channels: str, only_for: DataFrame | None = None) -> DataFrame:
    """Samples with the channels replaced by rows, for the recordings of only_for or all that rows has."""
    have = (rows if only_for is None else only_for).select(*a.keys).distinct()
    if a.samples is None:
        return rows
    listed = a.samples.where(F.col("channel").isin(*channels)).join(have, list(a.keys), "left_anti")
    kept = a.samples.where(~F.col("channel").isin(*channels)).unionByName(listed)
    return kept.unionByName(rows, allowMissingColumns=True)


def compute_cumulative_distance(a: Activities) -> tuple[Activities, DataFrame]:
    """WIN-2, AGG-7: the distance channel from the points as they are, and the total of each recording."""
    walked = cumulative_distance(a)
    rows = walked.select(*a.keys, F.lit("distance").alias("channel"), "seq", "time", F.col("distance_m").alias("value"))
    total = walked.groupBy(*a.keys).agg(F.sum("step_m").alias("total_distance"))
    return a.having(samples=_with_channel(a, rows, "distance")), total


def recompute_distance_and_speed(a: Activities) -> Activities:
    """WIN-3: distance and speed channels from the points, sorted and deduplicated first where times do not rise.

    Whether a recording rises is a window over the same partitioning as all that follows; samples get it by a join.
    """
    part, w = Window.partitionBy(*a.keys), a.by_seq()
    p = a.points.withColumn("_late", F.coalesce(F.lag("time").over(w) >= F.col("time"), F.lit(False)))
    p = p.withColumns({"_many": F.count(F.lit(1)).over(part) > 1, "_bad": F.max("_late").over(part)})
    state = p.groupBy(*a.keys).agg(F.first("_many").alias("_many"), F.first("_bad").alias("_bad"))
    marked = keep_last(p, a.keys, only=F.col("_bad") & F.col("_many"))
    seconds = (F.col("time") - F.lag("time").over(w)) / 1e6
    walked = cumulative_distance(a.having(points=marked.where("_many"))).withColumn("_s", seconds)
    walked = walked.withColumn("speed", F.when(F.col("_s") > 0, F.col("step_m") / F.col("_s")).otherwise(0.0))
    pair = F.explode(F.create_map(F.lit("distance"), F.col("distance_m"), F.lit("speed"), F.col("speed"))).alias("channel", "value")
    samples = walked.select(*a.keys, "seq", "time", pair).select(*a.keys, "channel", "seq", "time", "value")
    if a.samples is not None:
        old = a.samples.join(state, list(a.keys), "left").withColumns({"_many": F.coalesce("_many", F.lit(False)), "_bad": F.coalesce("_bad", F.lit(False))})
        old = old.where(~(F.col("channel").isin("distance", "speed") & F.col("_many")))
        old = keep_last(old, a.keys, "channel", only=F.col("_bad") & F.col("_many")).select(a.samples.columns)
        samples = old.unionByName(samples, allowMissingColumns=True)
    return a.having(points=marked.select(a.points.columns), samples=samples)


def smooth_heart_rate(a: Activities, window: int = 5, channel: str = "heart_rate") -> Activities:
    """WIN-4: centred mean over so many samples, fewer at the ends."""
    if window <= 1:
        return a
    left = (window - 1) // 2
    frame = a.by_seq("channel").rowsBetween(-left, window - left - 1)
    mean = F.avg("value").over(frame)
    return a.having(samples=a.samples.withColumn("value", F.when(F.col("channel") == channel, mean).otherwise(F.col("value"))))


def rising(df: DataFrame, w) -> Column:
    """Whether a row's time is after that of the row before."""
    return F.coalesce(F.col("time") > F.lag("time").over(w), F.lit(True))


def strictly_ordered(a: Activities) -> DataFrame:
    """WIN-12: of each recording whether points, channels and laps all rise strictly in time."""
    tests = [a.points.select(*a.keys, rising(a.points, a.by_seq()).alias("ok"))]
    if a.samples is not None:
        tests.append(a.samples.select(*a.keys, rising(a.samples, a.by_seq("channel")).alias("ok")))
    if a.laps is not None:
        w = Window.partitionBy(*a.keys).orderBy("lap_no")
        tests.append(a.laps.select(*a.keys, F.coalesce(F.col("start_time") > F.lag("start_time").over(w), F.lit(True)).alias("ok")))
    every = tests[0]
    for t in tests[1:]:
        every = every.unionAll(t)
    return every.groupBy(*a.keys).agg(F.bool_and("ok").alias("strictly_ordered"))


def largest_contiguous(a: Activities, hours: int = 25, metres: float = 100_000.0, least: int = 10) -> Activities:
    """WIN-8: of recordings with more than `least` points the largest run without a gap of `hours` or more (of equal ones the later).

    Then a first or last point farther than `metres` from its neighbour goes, where three or more are left.
    """
    w = a.by_time()
    gap = (F.col("time") - F.lag("time").over(w)) >= hours * 3_600_000_000
    run = F.sum(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    every = Window.partitionBy(*a.keys)
    p = a.points.withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_run", F.coalesce(run, F.lit(0)))
    p = p.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*a.keys, "_run")))
    best = F.max(F.struct("_size", "_run")).over(every)["_run"]
    p = p.withColumn("_best", best).where((F.col("_n") <= least) | (F.col("_run") == F.col("_best")))
    p = p.withColumn("_left", F.count(F.lit(1)).over(every)).withColumn("_i", F.row_number().over(w))
    p = with_step(with_step(p, w, "_before"), w, "_after", F.lead)
    far = ((F.col("_i") == 1) & (F.col("_after") > metres)) | ((F.col("_i") == F.col("_left")) & (F.col("_before") > metres))
    keep = (F.col("_n") <= least) | (F.col("_left") < 3) | ~F.coalesce(far, F.lit(False))
    return a.having(points=p.where(keep).select(a.points.columns))


def islands(df: DataFrame, keys, order: str, value: Column, out: str = "island") -> DataFrame:
    """WIN-9: number the runs of equal value in order, from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce((~value.eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    marked = df.withColumn("_c", F.when(F.row_number().over(w) == 1, 0).otherwise(change))
    return marked.withColumn(out, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_c")
