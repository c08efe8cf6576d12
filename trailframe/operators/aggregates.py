"""Aggregates over recordings, laps and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Activities
from .windows import cumulative_distance


def approximate_distance(a: Activities) -> DataFrame:
    """AGG-1: the last distance sample, else the length of the track."""
    walked = cumulative_distance(a).groupBy(*a.keys).agg(F.sum("step_m").alias("_track"))
    last = a.channel("distance").groupBy(*a.keys).agg(F.max_by("value", "seq").alias("_last"))
    return walked.join(last, list(a.keys), "full").select(*a.keys, F.coalesce("_last", "_track").alias("distance_m"))


def total_samples(a: Activities) -> DataFrame:
    """AGG-2"""
    return a.samples.groupBy(*a.keys).agg(F.count(F.lit(1)).alias("total_samples"))


def normalization_stats(before: Activities, after: Activities) -> DataFrame:
    """AGG-3: numbers of points and samples before and after."""
    out = None
    for a, word in ((before, "before"), (after, "after")):
        for t in ("points", "samples"):
            n = getattr(a, t).groupBy(*a.keys).agg(F.count(F.lit(1)).alias(f"{t}_{word}"))
            out = n if out is None else out.join(n, list(a.keys), "full")
    return out.na.fill(0)


def sport_windows(a: Activities) -> DataFrame:
    """AGG-4, AGG-11: earliest start and latest end of the laps of each sport; laps without one have the recording's."""
    from .edit import lap_view

    return lap_view(a).groupBy(*a.keys, "sport").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("n_laps"))


def point_range(a: Activities) -> DataFrame:
    """AGG-5: least and greatest time of the points."""
    return a.points.groupBy(*a.keys).agg(F.min("time").alias("points_start"), F.max("time").alias("points_end"))


def lap_heart_rate(a: Activities) -> DataFrame:
    """AGG-6: mean of the laps' mean heart rates with missing ones as 0, and the greatest maximum."""
    mean = F.sum(F.coalesce("avg_heart_rate", F.lit(0.0))) / F.count(F.lit(1))
    return a.laps.groupBy(*a.keys).agg(mean.alias("avg_heart_rate"), F.max("max_heart_rate").alias("max_heart_rate"))


def code_counts(diagnostics: DataFrame, codes: dict[str, str]) -> DataFrame:
    """AGG-8: how many diagnostics there are of each code, as named columns."""
    return diagnostics.groupBy("activity_id").agg(*[F.count_if(F.col("code") == c).alias(n) for n, c in codes.items()])


def diagnostic_summary(diagnostics: DataFrame, least: str = "info") -> DataFrame:
    """AGG-9: number and joined text of the diagnostics at or above a severity."""
    rank = {"info": 0, "warning": 1, "error": 2}
    at = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("severity")]
    return diagnostics.where(at >= rank[least]).groupBy("activity_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "severity", "code"))), "; ").alias("summary"))


def extra_channels(a: Activities, known: list[str]) -> DataFrame:
    """AGG-10: the other channels of each recording, sorted."""
    return a.samples.where(~F.col("channel").isin(known)).groupBy(*a.keys).agg(F.sort_array(F.collect_set("channel")).alias("channels"))


def snap_tolerance(points: DataFrame, keys) -> DataFrame:
    """RSM-7, AGG-12: half the mean spacing within 200 ms and 10 s; 1 s for fewer than two points, 500 ms for no span."""
    total = F.max_by("time", "seq") - F.min_by("time", "seq")
    agg = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), total.alias("_total"))
    half = F.greatest(F.lit(1), F.floor(F.floor(F.col("_total") / (F.col("_n") - 1)) / 2))
    tolerance = F.when(F.col("_n") < 2, 1_000_000).when(F.col("_total") <= 0, 500_000).otherwise(F.least(F.greatest(half, F.lit(200_000)), F.lit(10_000_000)))
    return agg.select(*keys, tolerance.cast("long").alias("tolerance"))
