"""Recordings built row by row on the driver; for tests, notebooks and small inputs. Large inputs come as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import SparkSession

from ..model import TABLES, Activities
from ..operators.normalize import normalize as normalized
from .recording import Recording, columns


def _us(t: datetime | int) -> int:
    """Microseconds of a datetime (without a zone it is UTC) or a number of them."""
    if isinstance(t, int):
        return t
    from .recording import parse_time

    return parse_time(t.isoformat())


class ActivityBuilder:
    """SRC-29: collects the rows of one activity. Every method gives the builder back."""

    def __init__(self, activity_id: str = "activity"):
        self.id, self.rec = activity_id, Recording({"sport": "unknown"})

    def point(self, time, latitude: float, longitude: float, elevation: float | None = None, **more) -> ActivityBuilder:
        self.rec.points.append({"time": _us(time), "latitude": float(latitude), "longitude": float(longitude), "elevation": elevation} | more)
        return self

    def points(self, rows: Iterable[tuple]) -> ActivityBuilder:
        for r in rows:
            self.point(*r)
        return self

    def sample(self, channel: str, time, value: float) -> ActivityBuilder:
        self.rec.sample(channel, _us(time), value)
        return self

    def channel(self, name: str, rows: Iterable[tuple]) -> ActivityBuilder:
        """Replaces a channel by (time, value) rows."""
        self.rec.samples = [s for s in self.rec.samples if s["channel"] != name.strip().lower()]
        for t, v in rows:
            self.sample(name, t, v)
        return self

    def lap(self, start_time, end_time, **stats) -> ActivityBuilder:
        self.rec.laps.append({"start_time": _us(start_time), "end_time": _us(end_time)} | stats)
        return self

    def workout_set(self, start_time, end_time, **more) -> ActivityBuilder:
        self.rec.sets.append({"start_time": _us(start_time), "end_time": _us(end_time), "is_rest": False} | more)
        return self

    def set(self, **info) -> ActivityBuilder:
        """Fields of info: sport, creator, name, device fields and so on."""
        self.rec.info |= info
        return self

    def clear(self) -> ActivityBuilder:
        self.rec = Recording({"sport": "unknown"})
        return self

    def build(self, spark: SparkSession, normalize: bool = True) -> Activities:
        self.rec.numbered()
        out = {}
        for t, schema in TABLES.items():
            rows = [self.rec.info] if t == "info" else getattr(self.rec, t)
            out[t] = spark.createDataFrame([(self.id, *[r.get(c) for c, _ in columns(t)]) for r in rows], schema)
        a = Activities(**out)
        return normalized(a) if normalize else a
