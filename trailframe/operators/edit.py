"""Row-level edits: filters, projections and the interval rules that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import micros, span, valid_latitude, valid_longitude
from ..model import Activities


def _between(start, end) -> Column:
    return (F.col("time") >= micros(start)) & (F.col("time") <= micros(end))


def _checked(start, end, name: str) -> None:
    if not isinstance(start, Column) and not isinstance(end, Column) and end < start:
        raise ValueError(f"{name} must not be before its start")


def _bounds(df: DataFrame | None, start: Column, end: Column, keep: Column) -> DataFrame | None:
    """Intervals that keep with new bounds; both are computed from the old ones."""
    if df is None:
        return None
    return df.where(keep).withColumns({"_s": start, "_e": end}).withColumns({"start_time": F.col("_s"), "end_time": F.col("_e")}).drop("_s", "_e")




def clip_overlapping(laps: DataFrame | None, start: Column, end: Column) -> DataFrame | None:
    """IV-4: laps that overlap [start, end], clipped to it."""
    s, e = F.col("start_time"), F.col("end_time")
    return _bounds(laps, F.greatest(s, start), F.least(e, end), (e >= start) & (s <= end))


def clip_deleted(df: DataFrame | None, f: Column, t: Column) -> DataFrame | None:
    """IV-1: intervals after [f, t] was deleted; those that span it stay."""
    s, e = F.col("start_time"), F.col("end_time")
    apart, inside = (e <= f) | (s >= t), (s >= f) & (e <= t)
    return _bounds(df, F.when(~apart & (s >= f) & (e > t), t).otherwise(s), F.when(~apart & (s < f) & (e <= t), f).otherwise(e), apart | ~inside)


def shift_after(df: DataFrame | None, at: Column, by: Column) -> DataFrame | None:
    """IV-2: intervals after a pause was inserted at a time."""
    s, e = F.col("start_time"), F.col("end_time")
    return _bounds(df, F.when(s > at, s + by).otherwise(s), F.when((s > at) | (e > at), e + by).otherwise(e), F.lit(True))


def close_gap(df: DataFrame | None, f: Column, t: Column) -> DataFrame | None:
    """IV-3: intervals after the gap (f, t) was closed; those that collapse go."""
    s, e, g = F.col("start_time"), F.col("end_time"), t - f
    before, after, inside = e <= f, s >= t, (s > f) & (e < t)
    start = F.when(before, s).when(after, s - g).when((s > f) & (e >= t), f).otherwise(s)
    end = F.when(before, e).when(after, e - g).when((s <= f) & (e < t), f).otherwise(e - g)
    return _bounds(df, start, end, before | after | (~inside & (end > start)))


def crop(a: Activities, start, end) -> Activities:
    """FLT-1: points and samples in [start, end]; laps clipped; sets, events and lengths untouched."""
    _checked(start, end, "the end of crop")
    keep = _between(start, end)
    cut = lambda df: None if df is None else df.where(keep)
    return a.having(points=cut(a.points), samples=cut(a.samples), laps=clip_overlapping(a.laps, micros(start), micros(end)))


def coordinate_ok() -> Column:
    """FLT-2: finite, in range, and not the (0, 0) that devices write before they have a fix."""
    return valid_latitude(F.col("latitude")) & valid_longitude(F.col("longitude")) & ~((F.abs("latitude") < 1e-6) & (F.abs("longitude") < 1e-6))


def clear_sentinel_elevation(points: DataFrame, keep_attributes: bool = False) -> DataFrame:
    """FLT-3: elevations of -499 m and less become null, and with them the point's attributes and extensions."""
    bad = F.col("elevation") <= -499.0
    others = [] if keep_attributes else [c for c in ("attributes", "extensions") if c in points.columns]
    return points.withColumns({c: F.when(bad, F.lit(None)).otherwise(F.col(c)) for c in ["elevation", *others]})


def point_bounds(a: Activities) -> DataFrame:
    """WIN-11: times of the first and the last point in list order, of each recording that has points."""
    return a.points.groupBy(*a.keys).agg(F.min_by("time", "seq").alias("first_time"), F.max_by("time", "seq").alias("last_time"))


def trim_invalid(a: Activities, keep_attributes: bool = False) -> Activities:
    """FLT-2 to FLT-4: drop bad points, clear bad elevations, trim channels and laps to what is left.

    Recordings without a point left keep their samples and lose their laps.
    """
    points = clear_sentinel_elevation(a.points.where(coordinate_ok()), keep_attributes)
    left = point_bounds(a.having(points=points))
    samples = laps = None
    if a.samples is not None:
        held = a.samples.join(left, list(a.keys), "left")
        samples = held.where(F.col("first_time").isNull() | F.col("time").between(F.col("first_time"), F.col("last_time"))).select(a.samples.columns)
    if a.laps is not None:
        laps = clip_overlapping(a.laps.join(left, list(a.keys)), F.col("first_time"), F.col("last_time")).select(a.laps.columns)
    return a.having(points=points, samples=samples, laps=laps)


def repair_diagnostics(a: Activities) -> DataFrame:
    """FLT-5: what trim_invalid repairs, as counted warnings for each recording."""
    ok = valid_latitude(F.col("latitude")) & valid_longitude(F.col("longitude"))
    island = ok & (F.abs("latitude") < 1e-6) & (F.abs("longitude") < 1e-6)
    counts = a.points.groupBy(*a.keys).agg(
        F.count_if(island).alias("sentinel_coords_removed"), F.count_if(ok & ~island & (F.col("elevation") <= -499.0)).alias("sentinel_elevation_cleared"))
    long = counts.unpivot(list(a.keys), ["sentinel_coords_removed", "sentinel_elevation_cleared"], "kind", "n").where("n > 0")
    return long.select(*a.keys, F.lit("warning").alias("severity"), F.concat(F.lit("repaired."), "kind").alias("code"), F.when(F.col("kind") == "sentinel_coords_removed", 5).otherwise(3).alias("priority"), F.col("n"))


def delete_range(a: Activities, start, end) -> Activities:
    """FLT-6: drop points and samples in [start, end]; laps and sets follow IV-1."""
    _checked(start, end, "the end of the range")
    keep, f, t = ~_between(start, end), micros(start), micros(end)
    cut = lambda df: None if df is None else df.where(keep)
    return a.having(points=cut(a.points), samples=cut(a.samples), laps=clip_deleted(a.laps, f, t), sets=clip_deleted(a.sets, f, t))


def _renumbered(df: DataFrame, a: Activities, *order) -> DataFrame:
    """seq numbered anew from 0 in the given order."""
    w = Window.partitionBy(*a.keys).orderBy(*order)
    return df.withColumn("_seq", (F.row_number().over(w) - 1).cast("long")).withColumn("seq", F.col("_seq")).drop("_seq")


def insert_points(a: Activities, new: DataFrame) -> Activities:
    """FLT-7: put new points before the first later point of their recording; equal times go after."""
    old = a.points.withColumn("_new", F.lit(0))
    both = old.unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    # The place of a new point is the least old seq with a later time: the running maximum of times decides it.
    top = F.max("time").over(a.by_seq().rowsBetween(Window.unboundedPreceding, 0))
    reach = old.select(*a.keys, "seq", top.alias("_top"))
    spots = new.alias("n").join(reach.alias("o"), [F.col(f"n.{k}") == F.col(f"o.{k}") for k in a.keys], "left").groupBy(*[F.col(f"n.{k}") for k in a.keys], F.col("n.seq")).agg(
        F.min(F.when(F.col("o._top") > F.col("n.time"), F.col("o.seq"))).alias("_pos")).select(*a.keys, F.col("seq").alias("seq"), F.lit(1).alias("_new"), "_pos")
    placed = both.join(spots, [*a.keys, "seq", "_new"], "left").withColumn("_pos", F.when(F.col("_new") == 0, F.col("seq")).otherwise(F.coalesce("_pos", F.lit(2**62))))
    return a.having(points=_renumbered(placed, a, "_pos", F.desc("_new"), "seq").drop("_new", "_pos"))


def delete_point(a: Activities, index: int) -> Activities:
    """FLT-8: drop the point at a place of each recording; a place that no recording has is an error when nothing matches."""
    if index < 0:
        raise IndexError(index)
    numbered = a.points.withColumn("_i", F.row_number().over(a.by_seq()) - 1)
    return a.having(points=_renumbered(numbered.where(F.col("_i") != index).drop("_i"), a, "seq"))


def update_point(a: Activities, index: int, latitude=None, longitude=None, elevation=None, time=None) -> Activities:
    """FLT-9: new values at one place; null keeps the old one; a new time sorts the points again."""
    if index < 0:
        raise IndexError(index)
    here = F.col("_i") == index
    new = {"latitude": latitude, "longitude": longitude, "elevation": elevation, "time": None if time is None else micros(time)}
    points = a.points.withColumn("_i", F.row_number().over(a.by_seq()) - 1)
    points = points.withColumns({c: F.when(here, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in new.items() if v is not None}).drop("_i")
    return a.having(points=points if time is None else _renumbered(points, a, "time", "seq"))


def developer_channels(samples: DataFrame) -> DataFrame:
    """FLT-10: samples of developer fields."""
    return samples.where((F.col("channel") == "running_power") | F.col("channel").startswith("fit_dev_"))


def by_severity(diagnostics: DataFrame, severity: str | None = None) -> DataFrame:
    """FLT-11: diagnostics of one severity, or their number by severity."""
    return diagnostics.groupBy("severity").agg(F.count(F.lit(1)).alias("n")) if severity is None else diagnostics.where(F.col("severity") == severity)


def shift_time(a: Activities, delta) -> Activities:
    """PRJ-1: move everything in time, but for waypoints."""
    d = micros(delta)
    out = {}
    for t, df in a.tables().items():
        moved = [c for c in ("time", "start_time", "end_time") if c in df.columns]
        if moved and t != "waypoints":
            out[t] = df.withColumns({c: F.col(c) + d for c in moved})
    return a.having(**out)


def remap_times(a: Activities, new: Column) -> Activities:
    """PRJ-4: times of points and samples by an expression; rows where it is null go."""
    move = lambda df: None if df is None else df.withColumn("time", new).where(F.col("time").isNotNull())
    return a.having(points=move(a.points), samples=move(a.samples))


def insert_pause(a: Activities, at, duration) -> Activities:
    """PRJ-2: what lies strictly after a time moves on; laps and sets follow IV-2."""
    if not isinstance(duration, Column) and span(duration) <= 0:
        if span(duration) < 0:
            raise ValueError("a pause must not be negative")
        return a
    at, by, t = micros(at), micros(duration), F.col("time")
    return remap_times(a, F.when(t > at, t + by).otherwise(t)).having(laps=shift_after(a.laps, at, by), sets=shift_after(a.sets, at, by))


def remove_pause(a: Activities, start, end) -> Activities:
    """PRJ-3: drop what lies strictly inside and close the gap; laps and sets follow IV-3."""
    _checked(start, end, "the end of the pause")
    if not isinstance(start, Column) and not isinstance(end, Column) and start == end:
        return a
    f, to, t = micros(start), micros(end), F.col("time")
    new = F.when((t > f) & (t < to), F.lit(None)).when(t < to, t).otherwise(t - (to - f))
    return remap_times(a, new).having(laps=close_gap(a.laps, f, to), sets=close_gap(a.sets, f, to))


def sample_tuples(a: Activities) -> DataFrame:
    """PRJ-5: (timestamp in epoch milliseconds, value) of each channel."""
    return a.samples.select(*a.keys, "channel", "seq", F.floor(F.col("time") / 1000).cast("long").alias("timestamp"), "value")


def lap_view(a: Activities) -> DataFrame:
    """PRJ-6: laps with their elapsed time and sport, that of the recording where they have none."""
    sport = a.info.select(*a.keys, F.col("sport").alias("_sport"))
    return a.laps.join(sport, list(a.keys), "left").withColumn("sport", F.coalesce("sport", "_sport")).withColumn("elapsed", F.col("end_time") - F.col("start_time")).drop("_sport")


def overridden(df: DataFrame, **new) -> DataFrame:
    """PRJ-10: columns replaced where the new value is not null."""
    return df.withColumns({c: F.coalesce(v if isinstance(v, Column) else F.lit(v), F.col(c)) for c, v in new.items() if v is not None})


def to_json(a: Activities) -> DataFrame:
    """PRJ-7: (keys, json) of each recording with its points, samples and laps in order."""
    parts = []
    for t in ("points", "samples", "laps"):
        if (df := getattr(a, t)) is not None:
            order = ["lap_no"] if t == "laps" else ["channel", "seq"] if t == "samples" else ["seq"]
            rest = [c for c in df.columns if c not in a.keys and c not in order]
            parts.append(df.groupBy(*a.keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(t)))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(a.keys), "full")
    return out.select(*a.keys, F.to_json(F.struct(*[c for c in out.columns if c not in a.keys])).alias("json"))
