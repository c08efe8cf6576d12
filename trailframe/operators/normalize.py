"""Normalization and automatic repair of recordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import valid_latitude, valid_longitude
from ..model import Activities
from .aggregates import normalization_stats
from .edit import point_bounds, trim_invalid
from .resample import fill_gaps, laps_by_distance
from .windows import recompute_distance_and_speed, sort_and_dedup, strictly_ordered

GAP_US = 300_000_000


@dataclass(frozen=True)
class AutoFix:
    """RSM-11: what the automatic repair does; laps by distance only where they are missing or placeholders."""

    fix_invalid_gps: bool = True
    fix_channel_drift: bool = True
    fix_distance_drift: bool = True
    fix_timestamp_gaps: bool = True
    auto_lap_by_distance: bool = False
    auto_lap_only_when_missing: bool = True
    auto_lap_distance_m: float | None = None
    running_lap_m: float = 1000.0
    cycling_lap_m: float = 5000.0
    default_lap_m: float = 1000.0
    gap_threshold_us: int = GAP_US
    max_inserted_points: int = 250


def normalize(a: Activities, dedup: bool = True, trim: bool = True, short_circuit: bool = False) -> Activities:
    """NRM-1: sort, deduplicate and trim. short_circuit (NRM-2) leaves recordings alone that are ordered, in range and covered."""
    done = sort_and_dedup(a) if dedup else a
    done = trim_invalid(done) if trim else done
    if not short_circuit or not (dedup or trim):
        return done
    fine = already_normalized(a, dedup, trim).where("normalized").select(*a.keys)
    out = {}
    for t in ("points", "samples", "laps"):
        old, new = getattr(a, t), getattr(done, t)
        if old is not None:
            out[t] = old.join(fine, list(a.keys), "left_semi").unionByName(new.join(fine, list(a.keys), "left_anti"))
    return a.having(**out)


def already_normalized(a: Activities, dedup: bool = True, trim: bool = True) -> DataFrame:
    """NRM-2: of each recording whether the short test finds nothing to do; it does not look at sentinels or laps out of range."""
    ok = a.points.groupBy(*a.keys).agg(F.bool_and(valid_latitude(F.col("latitude")) & valid_longitude(F.col("longitude"))).alias("_coords"))
    if a.samples is not None:
        outside = a.samples.join(point_bounds(a), list(a.keys)).groupBy(*a.keys).agg(F.bool_and(F.col("time").between(F.col("first_time"), F.col("last_time"))).alias("_inside"))
        ok = ok.join(outside, list(a.keys), "left")
    else:
        ok = ok.withColumn("_inside", F.lit(True))
    ok = ok.join(strictly_ordered(a), list(a.keys), "left")
    test = F.lit(True)
    if dedup:
        test = test & F.coalesce("strictly_ordered", F.lit(True))
    if trim:
        test = test & F.col("_coords") & F.coalesce("_inside", F.lit(True))
    return ok.select(*a.keys, test.alias("normalized"))


def ordered_for_export(a: Activities) -> Activities:
    """NRM-4: sorted and deduplicated; a no-op for rows that already are."""
    return sort_and_dedup(a)


def auto_fix(a: Activities, options: AutoFix = AutoFix()) -> Activities:
    """RSM-11: sort and dedup, trim, recompute distance and speed, fill gaps, laps by distance."""
    from ..plans.checkpoints import settled

    fixed = sort_and_dedup(a)
    if options.fix_invalid_gps or options.fix_channel_drift:
        fixed = trim_invalid(fixed)
    if options.fix_distance_drift:
        fixed = settled(recompute_distance_and_speed(settled(fixed)))
    if options.fix_timestamp_gaps and options.max_inserted_points > 0:
        fixed = fill_gaps(fixed, options.gap_threshold_us, options.max_inserted_points)
    return auto_lap(settled(fixed), options) if options.auto_lap_by_distance else fixed


def auto_lap(a: Activities, options: AutoFix = AutoFix()) -> Activities:
    """RSM-10: laps by distance for recordings of two points and more whose laps are missing or only segments and splits."""
    every = a.points.groupBy(*a.keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*a.keys)
    if a.laps is not None and options.auto_lap_only_when_missing:
        placeholder = F.coalesce(F.col("name").startswith("Segment") | F.col("name").startswith("Split"), F.lit(False))
        real = a.laps.groupBy(*a.keys).agg(F.bool_and(placeholder).alias("_p")).where("NOT _p").select(*a.keys)
        every = every.join(real, list(a.keys), "left_anti")
    from ..plans.checkpoints import settled

    source = settled(recompute_distance_and_speed(a))
    if options.auto_lap_distance_m:
        metres = F.lit(float(options.auto_lap_distance_m))
        chosen = source.having(samples=source.samples.join(every, list(a.keys), "left_semi"), points=source.points.join(every, list(a.keys), "left_semi"))
    else:
        sport = F.col("_sport")
        metres = F.when(sport.isin("running", "walking", "hiking"), options.running_lap_m).when(sport == "cycling", options.cycling_lap_m).otherwise(options.default_lap_m)
        sports = a.info.select(*a.keys, F.col("sport").alias("_sport")) if a.info is not None else every.withColumn("_sport", F.lit(None).cast("string"))
        chosen = source.having(samples=source.samples.join(every, list(a.keys), "left_semi").join(sports, list(a.keys), "left"), points=source.points.join(every, list(a.keys), "left_semi"))
    new = laps_by_distance(chosen, metres)
    samples = source.samples.join(every, list(a.keys), "left_semi").unionByName(a.samples.join(every, list(a.keys), "left_anti"), allowMissingColumns=True) if a.samples is not None else source.samples
    laps = new if a.laps is None else a.laps.join(every, list(a.keys), "left_anti").unionByName(new, allowMissingColumns=True)
    return a.having(samples=samples, laps=laps)


def auto_fix_diagnostics(before: Activities, after: Activities) -> DataFrame:
    """RSM-11: the four autofix codes with their counts, of each recording."""
    keys = list(before.keys)
    counts = normalization_stats(before, after)
    for a, word in ((before, "before"), (after, "after")):
        has = a.samples.groupBy(*keys).agg(F.bool_or(F.col("channel") == "distance").alias(f"distance_{word}"))
        counts = counts.join(has, keys, "left")
        if a.laps is not None:
            counts = counts.join(a.laps.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"laps_{word}")), keys, "left")
        else:
            counts = counts.withColumn(f"laps_{word}", F.lit(0))
    n = lambda c: F.coalesce(c, F.lit(0))
    found = F.array(
        F.struct(F.lit("autofix.invalid_gps.trimmed").alias("code"), (F.col("points_before") - F.col("points_after")).cast("long").alias("n")),
        F.struct(F.lit("autofix.channel_drift.trimmed").alias("code"), (F.col("samples_before") - F.col("samples_after")).cast("long").alias("n")),
        F.struct(F.lit("autofix.distance.recomputed").alias("code"), F.when(F.coalesce("distance_after", F.lit(False)) & ~F.coalesce("distance_before", F.lit(False)), 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.lit("autofix.laps.auto_generated").alias("code"), (n(F.col("laps_after")) - n(F.col("laps_before"))).cast("long").alias("n")),
    )
    return counts.select(*keys, F.explode(found).alias("f")).where("f.n > 0").select(*keys, F.lit("info").alias("severity"), "f.code", "f.n")
