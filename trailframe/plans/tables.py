"""Recordings made from the star-schema tables: every user's events are one activity.

event_type is the channel and value the sample; points get coordinates by formula, some of them invalid on purpose; laps
are the events of five-day stretches. Each builder has the same definition as SQL, for the checks in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import micros_of_ntz
from ..model import Activities

DAY_US = 86_400_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("activity_id"), F.col("event_id").alias("seq"), micros_of_ntz(F.col("ts")).alias("time"), F.col("event_type").alias("channel"), "value")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("activity_id", F.lit(0).alias("track_no"), "channel", "seq", "time", "value")


def points(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    """Valid points, or with clean=False also bad latitudes, (0, 0) points and sentinel elevations."""
    lat = F.lit(40.0) + F.col("value") / 10000.0
    lon = F.lit(-105.0) + (F.col("seq") % 1000).cast("double") / 10000.0
    ele = F.when(F.col("seq") % 11 == 0, F.lit(None)).otherwise(F.lit(100.0) + F.col("value") / 10.0)
    if not clean:
        island = F.col("seq") % 101 == 0
        lat = F.when(F.col("seq") % 97 == 0, F.lit(95.0)).when(island, F.lit(0.0)).otherwise(lat)
        lon = F.when(island, F.lit(0.0)).otherwise(lon)
        ele = F.when(F.col("seq") % 50 == 0, F.lit(-500.0)).otherwise(ele)
    return events(spark, sf_dir).select(
        "activity_id", F.lit(0).alias("track_no"), F.lit(0).alias("segment_no"), "seq", "time", lat.alias("latitude"), lon.alias("longitude"), ele.alias("elevation"))


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.floor((F.col("time") - T0) / (5 * DAY_US))
    rows = events(spark, sf_dir).groupBy("activity_id", bucket.alias("b")).agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    n = F.row_number().over(Window.partitionBy("activity_id").orderBy("b"))
    sport = F.when(F.col("b") % 3 == 0, "running").when(F.col("b") % 3 == 1, "cycling")
    return rows.select(
        "activity_id", n.alias("lap_no"), "start_time", "end_time", sport.alias("sport"), F.concat(F.lit("Lap "), n).alias("name"),
        F.when(F.col("b") % 2 == 0, F.col("mean")).alias("avg_heart_rate"), F.col("most").alias("max_heart_rate"))


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    sport = F.when(F.col("activity_id") % 3 == 0, "running").when(F.col("activity_id") % 3 == 1, "swimming").otherwise("cycling")
    return events(spark, sf_dir).select("activity_id").distinct().select("activity_id", sport.alias("sport"))


def activities(spark: SparkSession, sf_dir: str, clean: bool = True) -> Activities:
    return Activities(points=points(spark, sf_dir, clean), samples=samples(spark, sf_dir), laps=laps(spark, sf_dir), info=info(spark, sf_dir))


SQL_SAMPLES = "samples AS (SELECT user_id AS activity_id, event_type AS channel, event_id AS seq, epoch_us(ts) AS time, value FROM events)"
_LAT, _LON = "CAST(40.0 AS DOUBLE) + value / CAST(10000.0 AS DOUBLE)", "CAST(-105.0 AS DOUBLE) + CAST(event_id % 1000 AS DOUBLE) / CAST(10000.0 AS DOUBLE)"
_ELE = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(100.0 AS DOUBLE) + value / CAST(10.0 AS DOUBLE) END"
SQL_POINTS = f"points AS (SELECT user_id AS activity_id, event_id AS seq, epoch_us(ts) AS time, {_LAT} AS latitude, {_LON} AS longitude, {_ELE} AS elevation FROM events)"
SQL_DIRTY = (
    "points AS (SELECT user_id AS activity_id, event_id AS seq, epoch_us(ts) AS time, "
    f"CASE WHEN event_id % 97 = 0 THEN 95.0 WHEN event_id % 101 = 0 THEN 0.0 ELSE {_LAT} END::DOUBLE AS latitude, "
    f"CASE WHEN event_id % 101 = 0 THEN 0.0 ELSE {_LON} END::DOUBLE AS longitude, CASE WHEN event_id % 50 = 0 THEN -500.0 ELSE {_ELE} END::DOUBLE AS elevation FROM events)"
)
SQL_LAPS = f"""laps AS (
  SELECT activity_id, row_number() OVER (PARTITION BY activity_id ORDER BY b)::INT AS lap_no, start_time, end_time,
    CASE WHEN b % 3 = 0 THEN 'running' WHEN b % 3 = 1 THEN 'cycling' END AS sport,
    CASE WHEN b % 2 = 0 THEN mean END AS avg_heart_rate, most AS max_heart_rate
  FROM (SELECT user_id AS activity_id, (epoch_us(ts) - {T0}) // {5 * DAY_US} AS b, min(epoch_us(ts)) AS start_time, max(epoch_us(ts)) AS end_time, avg(value) AS mean, max(value) AS most FROM events GROUP BY 1, 2))"""
SQL_INFO = "info AS (SELECT DISTINCT user_id AS activity_id, CASE WHEN user_id % 3 = 0 THEN 'running' WHEN user_id % 3 = 1 THEN 'swimming' ELSE 'cycling' END AS sport FROM events)"
SQL_HAVERSINE = """2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h}))"""


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return SQL_HAVERSINE.format(h=h)
