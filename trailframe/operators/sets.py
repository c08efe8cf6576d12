"""Union, merge and split of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import infer_sport
from ..model import Activities
from .aggregates import sport_windows
from .edit import lap_view
from .normalize import normalize as normalized


def flattened(a: Activities) -> Activities:
    """SET-2: the tracks of a recording as one, in stable order of time, without segments."""
    out = {}
    for t, more in (("points", []), ("samples", ["channel"])):
        df = getattr(a, t)
        if df is None or "track_no" not in df.columns:
            continue
        w = Window.partitionBy(*a.keys, *more).orderBy("time", "track_no", "seq")
        df = df.withColumn("_n", (F.row_number().over(w) - 1).cast("long")).withColumns({"seq": F.col("_n"), "track_no": F.lit(0)}).drop("_n")
        out[t] = df.withColumn("segment_no", F.lit(0)) if "segment_no" in df.columns else df
    return a.having(**out)


def merge(a: Activities, into: Column, order: Column, preserve_sport_per_lap: bool = False, normalize: bool = True, creator: str | None = None) -> Activities:
    """SET-1: recordings with one value of `into` become one, in the order of `order` (expressions over info).

    Points, samples, laps, sets, events and lengths are appended; sport, creator and device are the first recording's;
    summaries and waypoints are not carried over. Groups of one keep their rows as they are.
    """
    a = flattened(a)
    key = a.keys[0]
    target = a.info.select(F.col(key).alias("_old"), into.cast("string").alias("_new"), order.alias("_rank"), F.col("sport").alias("_sport"))
    target = target.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("_new")))
    out = {}
    for t in ("points", "samples", "laps", "sets", "events", "lengths"):
        df = getattr(a, t)
        if df is None:
            continue
        place = "lap_no" if t == "laps" else "seq"
        more = ["channel"] if t == "samples" else []
        moved = df.join(target, df[key] == target["_old"])
        if t == "laps" and preserve_sport_per_lap:
            moved = moved.withColumn("sport", F.when(F.col("_many") > 1, F.coalesce("sport", "_sport")).otherwise(F.col("sport")))
        w = Window.partitionBy("_new", *more).orderBy("_rank", "_old", place)
        first = 1 if t == "laps" else 0
        moved = moved.withColumn("_n", (F.row_number().over(w) - 1 + first).cast(df.schema[place].dataType)).withColumns({key: F.col("_new"), place: F.col("_n")})
        out[t] = moved.select(df.columns)
    lead = a.info.join(target, a.info[key] == target["_old"])
    w = Window.partitionBy("_new").orderBy("_rank", "_old")
    dropped = [c for c in ("summary", "metadata") if c in a.info.columns]
    info = lead.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn(key, F.col("_new"))
    info = info.withColumns({c: F.when(F.col("_many") == 1, F.col(c)) for c in dropped})
    if creator is not None:
        info = info.withColumn("creator", F.lit(creator))
    merged = a.having(info=info.select(a.info.columns), waypoints=None, diagnostics=None, **out)
    return normalized(merged) if normalize else merged


def split_by_sport(a: Activities, normalize: bool = True) -> Activities:
    """SET-3: one recording for each sport of the laps, named "id/sport", with the rows between its first and last lap.

    Windows of sports may overlap, so a row can be in several. Laps lose their sport; sets, events and lengths go.
    Recordings without laps, or whose laps have one sport, stay as they are under that sport.
    """
    key = a.keys[0]
    windows = sport_windows(a)
    many = windows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    windows = windows.join(many, key).select(key, F.col("sport").alias("_sport"), F.col("start_time").alias("_from"), F.col("end_time").alias("_to"))
    name = F.concat(F.col(key).cast("string"), F.lit("/"), F.coalesce("_sport", F.lit("unknown")))
    stay = lambda df: df.join(many, key, "left_anti").withColumn(key, F.col(key).cast("string"))
    out = {}
    for t in ("points", "samples"):
        df = getattr(a, t)
        if df is not None:
            inside = df.join(windows, key).where(F.col("time").between(F.col("_from"), F.col("_to"))).withColumn(key, name)
            out[t] = inside.select(df.columns).unionByName(stay(df))
    laps = lap_view(a).join(many, key, "left_semi").withColumn("_sport", F.col("sport")).withColumn(key, name).withColumn("sport", F.lit(None).cast("string"))
    out["laps"] = laps.select(a.laps.columns).unionByName(stay(a.laps))
    for t in ("sets", "events", "lengths"):
        if (df := getattr(a, t)) is not None:
            out[t] = stay(df)
    lone = sport_windows(a).join(many, key, "left_anti").select(key, F.col("sport").alias("_lone"))
    rest = stay(a.info.join(lone, key, "left").withColumn("sport", F.coalesce("_lone", "sport"))).select(a.info.columns)
    info = a.info.join(windows, key).withColumn("sport", F.col("_sport")).withColumn(key, name).select(a.info.columns).unionByName(rest)
    result = a.having(info=info, **out)
    return normalized(result) if normalize else result


def channel_union(*frames: DataFrame) -> DataFrame:
    """SET-4: the distinct keys of several frames, sorted where they are shown."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def namespaces(nodes: DataFrame) -> DataFrame:
    """SET-5: the first URI of each prefix of a recording, of rows (activity_id, seq, prefix, uri)."""
    return nodes.where(F.col("prefix").isNotNull() & F.col("uri").isNotNull()).groupBy("activity_id", "prefix").agg(F.min_by("uri", "seq").alias("uri"))


def with_inferred_sport(a: Activities, label: str = "name") -> Activities:
    """info with the sport that a label names, where it has none yet."""
    return a.having(info=a.info.withColumn("sport", F.coalesce("sport", infer_sport(F.col(label)))))


