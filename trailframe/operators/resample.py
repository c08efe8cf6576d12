"""Resampling, down-sampling, gap filling and laps by distance."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import haversine, lerp, span, time_factor
from ..model import Activities
from ..plans.shipping import shipped
from .aggregates import snap_tolerance
from .joins import nearest, neighbours, snapped

LAP_COLUMNS = ("lap_no", "start_time", "end_time", "distance_m", "name")


def grid(points: DataFrame, keys, step) -> DataFrame:
    """RSM-1: (keys, seq, time) from the first to the last time in steps, and the last time itself; two points at least."""
    us = span(step)
    if us <= 0:
        raise ValueError("step must be positive")
    ends = points.groupBy(*keys).agg(F.min("time").alias("_a"), F.max("time").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    n = F.floor((F.col("_b") - F.col("_a")) / us)
    count = n + F.when(F.col("_a") + n * us < F.col("_b"), 1).otherwise(0)
    rows = ends.select(*keys, "_a", "_b", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long"))).alias("seq"))
    return rows.select(*keys, "seq", F.least(F.col("_a") + F.col("seq") * us, F.col("_b")).alias("time"))


def _bracket(first: Column, fields: list[str]) -> Column:
    """Struct of a row, the row before it, the row after it and whether it is the first, over a sorted window."""
    w = first
    s = F.struct("time", *fields)
    return F.struct(s.alias("own"), F.lag(s).over(w).alias("prev"), F.lead(s).over(w).alias("next"))


def _interpolated(targets: DataFrame, rows: DataFrame, keys, fields: list[str]) -> DataFrame:
    """targets with _lo and _hi: the rows that bracket each target, as linear resampling takes them.

    Past the end both are the last row; before the first row they are the first two, so values are extrapolated.
    """
    w = Window.partitionBy(*keys).orderBy("time", "seq")
    marked = rows.select(*keys, "time", "seq", _bracket(w, fields).alias("_b"))
    found = neighbours(targets, marked, keys, F.col("_b"))
    up, down = F.col("_after"), F.col("_before")
    lone = up.isNotNull() & up["prev"].isNull() & up["next"].isNull()
    lo = F.when(up.isNull(), down["own"]).when(up["prev"].isNull(), up["own"]).otherwise(up["prev"])
    hi = F.when(up.isNull(), down["own"]).when(lone | (up["prev"].isNotNull()), up["own"]).otherwise(up["next"])
    return found.withColumns({"_lo": lo, "_hi": hi})


def _value(field: str) -> Column:
    lo, hi, t = F.col("_lo"), F.col("_hi"), F.col("time")
    mid = lerp(lo[field], hi[field], time_factor(lo["time"], hi["time"], t))
    return F.when(t == lo["time"], lo[field]).when(t == hi["time"], hi[field]).otherwise(mid)


def resample_points(a: Activities, times: DataFrame) -> DataFrame:
    """RSM-2: points at the times; elevation is taken from one side where the other has none. Exact hits keep the row."""
    rest = [c for c in a.points.columns if c not in a.keys and c not in ("time", "seq", "latitude", "longitude", "elevation")]
    got = _interpolated(times, a.points, a.keys, ["latitude", "longitude", "elevation", *rest])
    lo, hi, t = F.col("_lo"), F.col("_hi"), F.col("time")
    at_lo, at_hi = t == lo["time"], t == hi["time"]
    mid = F.coalesce(lerp(lo["elevation"], hi["elevation"], time_factor(lo["time"], hi["time"], t)), lo["elevation"], hi["elevation"])
    ele = F.when(at_lo, lo["elevation"]).when(at_hi, hi["elevation"]).otherwise(mid)
    past = lo["time"] == hi["time"]
    others = [F.when(at_lo | past, lo[c]).when(at_hi, hi[c]).otherwise(lo[c] if c in ("track_no", "segment_no") else F.lit(None)).alias(c) for c in rest]
    return got.select(*a.keys, "seq", "time", _value("latitude").alias("latitude"), _value("longitude").alias("longitude"), ele.alias("elevation"), *others).select(a.points.columns)


def resample_linear(a: Activities, times: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """RSM-3: every channel at the times, linearly; held past its end, extrapolated before its start."""
    samples = a.samples if samples is None else samples
    channels = samples.select(*a.keys, "channel").distinct()
    wanted = times.join(channels, list(a.keys))
    got = _interpolated(wanted, samples, [*a.keys, "channel"], ["value"])
    return got.select(*a.keys, "channel", "seq", "time", _value("value").alias("value"))


def resample_nearest(a: Activities, times: DataFrame, tolerance, samples: DataFrame | None = None) -> DataFrame:
    """JN-6: every channel at the times that have a sample within the tolerance, with the nearest value; ties go to the later."""
    samples = a.samples if samples is None else samples
    channels = samples.select(*a.keys, "channel").distinct()
    got = nearest(times.join(channels, list(a.keys)), samples, [*a.keys, "channel"], tolerance, "later", "inner")
    return got.select(*a.keys, "channel", "seq", "time", "value")


def resample(a: Activities, step, heart_rate: str = "heart_rate") -> Activities:
    """RSM-1 to RSM-4: points and channels on a fixed grid; heart rate by the nearest sample within half a step.

    Recordings with fewer than two points stay as they are.
    """
    times = grid(a.points, a.keys, step)
    done = times.select(*a.keys).distinct()
    stay = lambda df: df.join(done, list(a.keys), "left_anti")
    points = resample_points(a, times).unionByName(stay(a.points))
    if a.samples is None:
        return a.having(points=points)
    hr, rest = a.samples.where(F.col("channel") == heart_rate), a.samples.where(F.col("channel") != heart_rate)
    samples = resample_linear(a, times, rest).unionByName(resample_nearest(a, times, span(step) // 2, hr)).unionByName(stay(a.samples), allowMissingColumns=True)
    return a.having(points=points, samples=samples)


def _greedy(points: DataFrame, keys, keep) -> DataFrame:
    """Points of each recording that keep(columns as numpy) marks: the choice depends on the last one kept, so it is a fold.

    Recordings are dealt by their keys and sorted, then streamed through Arrow batches; only one is held at a time.
    """
    names, keys = points.columns, list(keys)
    needed = [c for c in ("time", "latitude", "longitude") if c in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            yield from table.filter(pa.array(keep({c: table.column(c).to_numpy() for c in needed}))).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            other = np.zeros(b.num_rows, bool)
            for k in keys:
                c = b.column(names.index(k))
                other[1:] |= ~np.array(pc.equal(c[1:], c[:-1]).fill_null(False))
            if held:
                last = held[-1]
                other[0] = any(last.column(names.index(k))[-1] != b.column(names.index(k))[0] for k in keys)
            starts = [0, *np.flatnonzero(other).tolist()] if not other[0] else np.flatnonzero(other).tolist()
            for i, (lo, hi) in enumerate(zip(starts, [*starts[1:], b.num_rows])):
                if held and (i or other[0]):
                    yield from finish(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from finish(held)

    return points.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(shipped(work), points.schema)


def _retained_by_time(us: int):
    def keep(columns):
        t = columns["time"]
        mark, last = np.zeros(len(t), bool), None
        if len(t) > 1 and (np.diff(t) >= 0).all():
            i = 0
            while i < len(t):
                mark[i], last = True, t[i]
                i = max(i + 1, int(np.searchsorted(t, last + us)))
        else:
            for i, v in enumerate(t):
                if last is None or v - last >= us:
                    mark[i], last = True, v
        if last != t[-1]:
            mark[-1] = True
        return mark

    return keep


def _retained_by_distance(metres: float):
    def keep(columns):
        lat, lon = np.radians(columns["latitude"]), np.radians(columns["longitude"])
        mark = np.zeros(len(lat), bool)
        mark[[0, -1]] = True
        i = 0
        while i < len(lat) - 1:
            for size in (64, len(lat)):
                a, b = lat[i + 1 : i + 1 + size], lon[i + 1 : i + 1 + size]
                h = np.sin((a - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(a) * np.sin((b - lon[i]) / 2) ** 2
                far = np.flatnonzero(2 * 6_371_000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) >= metres)
                if len(far):
                    break
            if not len(far):
                break
            i += 1 + int(far[0])
            mark[i] = True
        return mark

    return keep


def downsample_time(a: Activities, step) -> Activities:
    """RSM-5: keep a point when at least a step has passed since the last kept one, and the last; samples near a kept time stay (JN-7)."""
    us = span(step)
    if us <= 0:
        raise ValueError("step must be positive")
    points = _greedy(a.points, a.keys, _retained_by_time(us))
    if a.samples is None:
        return a.having(points=points)
    many = a.points.groupBy(*a.keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*a.keys)
    touched = a.having(samples=a.samples.join(many, list(a.keys), "left_semi"))
    samples = snapped(touched, points.join(many, list(a.keys), "left_semi"), max(1, us // 2)).unionByName(a.samples.join(many, list(a.keys), "left_anti"))
    return a.having(points=points, samples=samples)


def downsample_distance(a: Activities, metres: float) -> Activities:
    """RSM-6: keep a point at least so far from the last kept one, and the last; channels are taken at the kept times (JN-6, RSM-7)."""
    if metres <= 0:
        raise ValueError("metres must be positive")
    points = _greedy(a.points, a.keys, _retained_by_distance(metres))
    if a.samples is None:
        return a.having(points=points)
    many = a.points.groupBy(*a.keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*a.keys)
    kept = points.join(many, list(a.keys), "left_semi")
    times = kept.select(*a.keys, "seq", "time").join(snap_tolerance(kept, a.keys), list(a.keys))
    channels = a.samples.select(*a.keys, "channel").distinct()
    got = nearest(times.join(channels, list(a.keys)), a.samples, [*a.keys, "channel"], F.col("tolerance"), "later", "inner")
    samples = got.select(*a.keys, "channel", "seq", "time", "value").unionByName(a.samples.join(many, list(a.keys), "left_anti"), allowMissingColumns=True)
    return a.having(points=points, samples=samples)


def laps_by_distance(a: Activities, metres: float | Column) -> DataFrame:
    """RSM-8: (keys, lap_no, start_time, end_time, distance_m, name) at each crossed multiple of metres of the distance channel.

    The distance only grows: falls count as no progress. Laps end at sample times; what is left after the last crossing is a
    lap, and a recording without any has one lap over its points.
    """
    if not isinstance(metres, Column) and metres <= 0:
        raise ValueError("metres must be positive")
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    w = Window.partitionBy(*a.keys).orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = a.channel("distance")
    d = d.withColumn("_m", m).withColumn("_up", F.greatest(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("_gone", F.sum("_up").over(upto))
    d = d.withColumn("_k", F.floor(F.col("_gone") / F.col("_m")).cast("long"))
    d = d.withColumn("_k0", F.coalesce(F.lag("_k").over(w), F.lit(0)))
    crossed = d.where("_k > _k0").select(*a.keys, "_m", F.col("time").alias("end_time"), F.explode(F.sequence(F.col("_k0") + 1, F.col("_k"))).alias("_n"))
    ends = d.groupBy(*a.keys).agg(
        F.min_by("time", "seq").alias("_first"), F.max_by("time", "seq").alias("_last"), F.max("_gone").alias("_total"), F.max("_k").alias("_laps"),
        F.first("_m").alias("_m"), (F.max_by("value", "seq") - F.min_by("value", "seq")).alias("_net"))
    order = Window.partitionBy(*a.keys).orderBy("_n")
    whole = crossed.join(ends.select(*a.keys, "_first"), list(a.keys)).select(
        *a.keys, F.col("_n"), F.coalesce(F.lag("end_time").over(order), F.col("_first")).alias("start_time"), "end_time", F.col("_m").alias("distance_m"))
    final_end = crossed.groupBy(*a.keys).agg(F.max_by("end_time", "_n").alias("_cut"))
    rest = ends.join(final_end, list(a.keys), "left").withColumn("_rest", F.col("_total") - F.col("_laps") * F.col("_m"))
    tail = rest.where("_rest > 0").select(*a.keys, (F.col("_laps") + 1).alias("_n"), F.coalesce("_cut", "_first").alias("start_time"), F.col("_last").alias("end_time"), F.col("_rest").alias("distance_m"))
    spans = a.points.groupBy(*a.keys).agg(F.min_by("time", "seq").alias("start_time"), F.max_by("time", "seq").alias("end_time"))
    none = rest.where("_laps = 0 AND _rest <= 0").join(spans, list(a.keys)).select(*a.keys, F.lit(1).cast("long").alias("_n"), "start_time", "end_time", F.col("_net").alias("distance_m"))
    every = whole.unionByName(tail).unionByName(none)
    return every.select(*a.keys, F.col("_n").cast("int").alias("lap_no"), "start_time", "end_time", "distance_m", F.concat(F.lit("Split "), F.col("_n")).alias("name"))


def mark_laps_by_distance(a: Activities, metres: float) -> Activities:
    """RSM-8 for recordings with a distance channel; the others keep their laps."""
    new = laps_by_distance(a, metres)
    if a.laps is None:
        return a.having(laps=new)
    old = a.laps.join(a.channel("distance").select(*a.keys).distinct(), list(a.keys), "left_anti")
    return a.having(laps=old.unionByName(new, allowMissingColumns=True))


def fill_gaps(a: Activities, threshold, most: int = 250) -> Activities:
    """RSM-9: points at equal steps in gaps longer than the threshold, at most so many in a recording; samples are not filled."""
    us = span(threshold)
    if us <= 0 or most <= 0:
        return a
    w = a.by_seq()
    nxt = {c: F.lead(c).over(w) for c in ("time", "latitude", "longitude", "elevation")}
    p = a.points.withColumns({f"_{c}": v for c, v in nxt.items()}).withColumn("_gap", F.col("_time") - F.col("time"))
    steps = F.when(F.col("_gap") > us, F.floor(F.col("_gap") / us)).otherwise(F.lit(0))
    p = p.withColumn("_steps", F.coalesce(steps, F.lit(0)).cast("long"))
    p = p.withColumn("_before", F.coalesce(F.sum(F.greatest(F.col("_steps") - 1, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = F.least(F.col("_steps") - 1, F.lit(most) - F.col("_before"))
    new = p.where(room > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), room.cast("long"))).alias("_j"))
    ratio = F.col("_j") / F.col("_steps")
    made = new.withColumn("_new_time", F.col("time") + F.round(F.col("_gap") * ratio).cast("long")).withColumns({c: lerp(F.col(c), F.col(f"_{c}"), ratio) for c in ("latitude", "longitude", "elevation")})
    made = made.withColumns({"time": F.col("_new_time"), **{c: F.lit(None).cast(a.points.schema[c].dataType) for c in ("attributes", "extensions") if c in a.points.columns}})
    both = a.points.withColumn("_j", F.lit(0).cast("long")).unionByName(made.select(*a.points.columns, "_j"))
    order = Window.partitionBy(*a.keys).orderBy("seq", "_j")
    return a.having(points=both.withColumn("_n", (F.row_number().over(order) - 1).cast("long")).withColumn("seq", F.col("_n")).drop("_n", "_j"))


def pairwise_metres(a: Activities) -> DataFrame:
    """Metres between each point and the next, for checks of spacing."""
    w = a.by_seq()
    return a.points.withColumn("next_m", haversine(F.col("latitude"), F.col("longitude"), F.lead("latitude").over(w), F.lead("longitude").over(w)))


