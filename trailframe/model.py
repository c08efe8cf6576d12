"""The data model: recordings as normalized tables keyed by activity.

seq is a row's place in its list and carries the order; time is microseconds since 1970 UTC.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

POINTS = "activity_id string, track_no int, segment_no int, seq long, time long, latitude double, longitude double, elevation double, attributes map<string,string>, extensions string"
SAMPLES = "activity_id string, track_no int, channel string, seq long, time long, value double"
LAPS = (
    "activity_id string, track_no int, lap_no int, start_time long, end_time long, distance_m double, name string, sport string, calories double, "
    "avg_heart_rate double, max_heart_rate double, avg_speed double, max_speed double, avg_cadence double, max_cadence double, avg_power double, max_power double, "
    "total_ascent double, total_descent double, intensity string, trigger string, notes string, extra map<string,double>"
)
SETS = "activity_id string, seq long, start_time long, end_time long, is_rest boolean, category_id int, repetitions int, weight_kg double"
EVENTS = "activity_id string, seq long, time long, event int, event_type int, data long"
LENGTHS = "activity_id string, seq long, start_time long, end_time long, active boolean, strokes int, avg_speed double, stroke string"
ACTIVITIES = (
    "activity_id string, format string, sport string, creator string, name string, description string, notes string, author string, "
    "manufacturer string, model string, product string, serial_number string, software_version string, fit_manufacturer_id int, fit_product_id int, "
    "summary map<string,double>, metadata string"
)
WAYPOINTS = "activity_id string, kind string, route_no int, seq long, time long, latitude double, longitude double, elevation double, name string, attributes map<string,string>"
DIAGNOSTICS = "activity_id string, severity string, code string, message string, node string"
TABLES = {
    "info": ACTIVITIES, "points": POINTS, "samples": SAMPLES, "laps": LAPS, "sets": SETS, "events": EVENTS, "lengths": LENGTHS,
    "waypoints": WAYPOINTS, "diagnostics": DIAGNOSTICS,
}
#: Begin and end columns of the tables of intervals, and the tables of instants.
RANGES, INSTANTS = ("laps", "sets", "lengths"), ("points", "samples", "events")


@dataclass(frozen=True)
class Activities:
    """Many recordings at once; tables that are not there are None. keys name a recording."""

    points: DataFrame | None = None
    samples: DataFrame | None = None
    laps: DataFrame | None = None
    sets: DataFrame | None = None
    events: DataFrame | None = None
    lengths: DataFrame | None = None
    info: DataFrame | None = None
    waypoints: DataFrame | None = None
    diagnostics: DataFrame | None = None
    keys: tuple[str, ...] = field(default=("activity_id",))

    def having(self, **tables) -> Activities:
        """A copy with other tables."""
        return replace(self, **tables)

    def pipe(self, operator, *args, **kwargs) -> Activities:
        """operator(self, ...), for chains of edits."""
        return operator(self, *args, **kwargs)

    def tables(self) -> dict[str, DataFrame]:
        return {t: df for t in TABLES if (df := getattr(self, t)) is not None}

    def table(self, name: str, spark: SparkSession) -> DataFrame:
        """A table, empty if it is not there."""
        df = getattr(self, name)
        return spark.createDataFrame([], TABLES[name]) if df is None else df

    def by_seq(self, *more: str) -> WindowSpec:
        """Rows of a recording in list order."""
        return Window.partitionBy(*self.keys, *more).orderBy("seq")

    def by_time(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy("time", "seq")

    def channel(self, name: str) -> DataFrame:
        """Samples of one channel, none if it is not there."""
        return self.samples.where(F.col("channel") == name)


def same_keys(left: DataFrame, right: DataFrame, keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (left[k] == right[k])
    return out
