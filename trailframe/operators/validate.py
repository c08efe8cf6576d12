"""Validation rules. Each rule is a DataFrame of findings; validate() is their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite, span
from ..model import Activities
from .aggregates import point_range

GAP_US = 300_000_000


def _finding(a: Activities, df: DataFrame, severity: str | Column, code: Column | str, priority: int | Column, time: str = "time", detail: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(*a.keys, lit(severity).alias("severity"), lit(code).alias("code"), lit(priority).cast("int").alias("priority"), F.col(time).alias("time"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def _series(a: Activities, df: DataFrame, w, prefix: str, gap: int, detail: Column | None) -> DataFrame:
    """VAL-1 to VAL-3: order, duplicates and gaps of consecutive rows."""
    step = F.col("time") - F.lag("time").over(w)
    kind = F.when(step < 0, "out_of_order").when(step == 0, "duplicate_timestamp").when((F.lit(gap) > 0) & (step > gap), "gap")
    found = df.withColumn("_k", kind).where(F.col("_k").isNotNull())
    late = F.col("_k") == "gap"
    return _finding(a, found, F.when(late, "warning").otherwise("error"), F.concat(F.lit(prefix + "."), F.col("_k")), F.when(late, 3).otherwise(1), detail=detail)


def point_order(a: Activities, gap=GAP_US) -> DataFrame:
    """VAL-1, VAL-2"""
    return _series(a, a.points, a.by_seq(), "validation.points", span(gap), None)


def channel_order(a: Activities, gap=GAP_US) -> DataFrame:
    """VAL-3"""
    return _series(a, a.samples, a.by_seq("channel"), "validation.channel", span(gap), F.col("channel"))


def coordinates(a: Activities) -> DataFrame:
    """VAL-4"""
    lat, lon, ele = F.col("latitude"), F.col("longitude"), F.col("elevation")
    bad = F.array_compact(F.array(
        F.when(~(finite(lat) & lat.between(-90, 90)), F.struct(F.lit("latitude").alias("what"), F.lit(0).alias("p"))),
        F.when(~(finite(lon) & lon.between(-180, 180)), F.struct(F.lit("longitude").alias("what"), F.lit(0).alias("p"))),
        F.when(ele.isNotNull() & ~finite(ele), F.struct(F.lit("elevation").alias("what"), F.lit(1).alias("p"))),
    ))
    found = a.points.select("*", F.explode(bad).alias("_b"))
    return _finding(a, found, "error", F.concat(F.lit("validation.coordinate.invalid_"), F.col("_b.what")), F.col("_b.p"))


def coverage(a: Activities) -> DataFrame:
    """VAL-5: of each channel the first sample in list order before, and the first after, the points."""
    s = a.samples.join(point_range(a), list(a.keys))
    side = F.when(F.col("time") < F.col("points_start"), "before").when(F.col("time") > F.col("points_end"), "after")
    found = s.withColumn("_side", side).where(F.col("_side").isNotNull()).groupBy(*a.keys, "channel", "_side").agg(F.min_by("time", "seq").alias("time"))
    return _finding(a, found, "warning", F.concat(F.lit("validation.channel.samples_"), F.col("_side"), F.lit("_track")), 3, detail=F.col("channel"))


def channel_values(a: Activities) -> DataFrame:
    """VAL-6 to VAL-9"""
    v, c, w = F.col("value"), F.col("channel"), a.by_seq("channel")
    ok = finite(v)
    before = F.lag(F.when(ok, v)).over(w)
    rule = lambda test, sev, code, p: F.when(test, F.struct(F.lit(sev).alias("sev"), F.lit(f"validation.channel.{code}").alias("code"), F.lit(p).alias("p")))
    s = a.samples.withColumn("_prev", before)
    bad = F.array_compact(F.array(
        rule(~ok, "error", "non_finite_value", 0),
        rule(ok & (c == "distance") & (v < 0), "error", "negative_distance", 0),
        rule(ok & (c == "distance") & (v + 1e-9 < F.col("_prev")), "warning", "distance_decrease", 2),
        rule(ok & (c == "heart_rate") & ((v < 20) | (v > 260)), "warning", "heart_rate_out_of_range", 2),
        rule(ok & (c == "power") & (v < 0), "error", "negative_power", 1),
    ))
    found = s.select("*", F.explode(bad).alias("_b"))
    return _finding(a, found, F.col("_b.sev"), F.col("_b.code"), F.col("_b.p"), detail=F.col("channel"))


def laps(a: Activities, by_position: bool = False) -> DataFrame:
    """VAL-10 to VAL-13: times, order, overlap and reach of laps. by_position takes the first and last point instead of the extremes."""
    w = Window.partitionBy(*a.keys).orderBy("lap_no")
    if by_position:
        bounds = a.points.groupBy(*a.keys).agg(F.min_by("time", "seq").alias("points_start"), F.max_by("time", "seq").alias("points_end"))
    else:
        bounds = point_range(a)
    s, e = F.col("start_time"), F.col("end_time")
    x = a.laps.withColumns({"_ps": F.lag("start_time").over(w), "_pe": F.lag("end_time").over(w)}).join(bounds, list(a.keys), "left")
    rule = lambda test, sev, code, p: F.when(test, F.struct(F.lit(sev).alias("sev"), F.lit(f"validation.laps.{code}").alias("code"), F.lit(p).alias("p")))
    bad = F.array_compact(F.array(
        rule(e <= s, "error", "inverted_times", 0),
        F.coalesce(rule(s < F.col("_ps"), "error", "out_of_order", 1), rule(s < F.col("_pe"), "error", "overlap", 1)),
        rule(s < F.col("points_start"), "warning", "extends_before_points", 3),
        rule(e > F.col("points_end"), "warning", "extends_after_points", 3),
    ))
    if by_position:
        lone = F.array(F.struct(F.lit("warning").alias("sev"), F.lit("validation.laps.no_points").alias("code"), F.lit(2).alias("p")))
        bad = F.when(F.col("points_start").isNull(), F.when(F.col("_ps").isNull(), lone).otherwise(F.slice(lone, 1, 0))).otherwise(bad)
    found = x.select("*", F.explode(bad).alias("_b"))
    return _finding(a, found, F.col("_b.sev"), F.col("_b.code"), F.col("_b.p"), "start_time", F.col("lap_no"))


def device(info: DataFrame, manufacturers: DataFrame | None = None) -> DataFrame:
    """VAL-14: blank fields, ids out of range, and names that differ from a table (fit_manufacturer_id, known_name) of manufacturers."""
    fields = [c for c in ("manufacturer", "model", "product", "serial_number", "software_version") if c in info.columns]
    x = info if manufacturers is None else info.join(F.broadcast(manufacturers), "fit_manufacturer_id", "left")
    mfg, prod = F.col("fit_manufacturer_id"), F.col("fit_product_id")
    mk = lambda test, sev, code, p, what: F.when(test, F.struct(F.lit(sev).alias("sev"), F.lit(f"validation.device.{code}").alias("code"), F.lit(p).alias("p"), F.lit(what).alias("what")))
    rules = [mk(F.col(c).isNotNull() & (F.trim(c) == ""), "warning", "blank_field", 3, c) for c in fields]
    rules.append(mk((mfg <= 0) | (mfg >= 65535), "error", "invalid_fit_manufacturer_id", 0, "fit_manufacturer_id"))
    if manufacturers is not None:
        rules.append(mk((mfg > 0) & (mfg < 65535) & (F.lower("known_name") != F.lower(F.trim("manufacturer"))), "warning", "manufacturer_name_mismatch", 2, "manufacturer"))
    rules.append(mk(prod < 0, "error", "invalid_fit_product_id", 0, "fit_product_id"))
    found = x.select("activity_id", F.explode(F.array_compact(F.array(*rules))).alias("b"))
    return found.select("activity_id", F.col("b.sev").alias("severity"), F.col("b.code").alias("code"), F.col("b.p").alias("priority"), F.lit(None).cast("long").alias("time"), F.col("b.what").alias("detail"))


def channel_sizes(a: Activities, listed: DataFrame | None = None) -> DataFrame:
    """VAL-15: channels with one sample, and those of listed (keys, channel) without any."""
    n = a.samples.groupBy(*a.keys, "channel").agg(F.count(F.lit(1)).alias("_n"), F.min("time").alias("time"))
    if listed is not None:
        n = listed.join(n, [*a.keys, "channel"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    empty = F.col("_n") == 0
    code = F.when(empty, "validation.channel.empty").otherwise("validation.channel.single_sample")
    return _finding(a, n.where("_n < 2"), "warning", code, F.when(empty, 3).otherwise(4), detail=F.col("channel"))


def validate(a: Activities, gap=GAP_US, rules=("point_order", "coordinates", "channel_order", "channel_values", "coverage", "laps")) -> DataFrame:
    """VAL-17: all structural findings, or those of some rules."""
    made = {"point_order": lambda: point_order(a, gap), "coordinates": lambda: coordinates(a)}
    if a.samples is not None:
        made |= {"channel_order": lambda: channel_order(a, gap), "channel_values": lambda: channel_values(a), "coverage": lambda: coverage(a)}
    if a.laps is not None:
        made["laps"] = lambda: laps(a)
    parts = [made[r]() for r in rules if r in made]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(findings: DataFrame, keys=("activity_id",)) -> DataFrame:
    """VAL-17: numbers of errors and warnings, and whether a recording with findings is valid (no errors)."""
    errors = F.count_if(F.col("severity") == "error")
    return findings.groupBy(*keys).agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (errors == 0).alias("is_valid"))


def flattened(findings: DataFrame) -> DataFrame:
    """VAL-16: findings under the two general codes that exports carry."""
    return findings.withColumn("code", F.concat(F.lit("validation."), "severity"))
