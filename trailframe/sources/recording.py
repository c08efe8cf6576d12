"""One recording in Python, as the decoders make it and the encoders take it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa

from ..model import TABLES

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def columns(table: str) -> list[tuple[str, str]]:
    """(name, type) of a table of the model, without the activity."""
    parts = re.findall(r"(\w+) (map<\w+,\w+>|\w+)", TABLES[table])
    return parts[1:]


def arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("map<"):
        key, value = kind[4:-1].split(",")
        return pa.map_(_TYPES[key], _TYPES[value])
    return _TYPES[kind]


def row_type(table: str) -> pa.StructType:
    return pa.struct([(n, arrow_type(k)) for n, k in columns(table)])


def nested_ddl() -> str:
    """Schema of a decoded file: its name, the info struct and an array for each other table."""
    struct = lambda t: "struct<" + ",".join(f"{n}:{'bigint' if k == 'long' else k}" for n, k in columns(t)) + ">"
    return "activity_id string, info " + struct("info") + "".join(f", {t} array<{struct(t)}>" for t in TABLES if t != "info")


@dataclass
class Recording:
    """Rows are dicts; missing fields are null. seq, lap_no and track_no are filled in on the way out."""

    info: dict = field(default_factory=dict)
    points: list[dict] = field(default_factory=list)
    samples: list[dict] = field(default_factory=list)
    laps: list[dict] = field(default_factory=list)
    sets: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    lengths: list[dict] = field(default_factory=list)
    waypoints: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)

    def say(self, severity: str, code: str, message: str, node: str | None = None) -> None:
        self.diagnostics.append({"severity": severity, "code": code, "message": message, "node": node})

    def sample(self, channel: str, time: int, value: float, track: int = 0) -> None:
        self.samples.append({"channel": channel.strip().lower(), "time": time, "value": float(value), "track_no": track})

    def series(self) -> dict[str, list[dict]]:
        """Samples by channel in list order."""
        out: dict[str, list[dict]] = {}
        for s in self.samples:
            out.setdefault(s["channel"], []).append(s)
        return out

    def numbered(self) -> Recording:
        """Fills in the places of rows in their lists."""
        for rows in (self.points, self.sets, self.events, self.lengths, self.waypoints):
            for i, r in enumerate(rows):
                r.setdefault("seq", i)
        for p in self.points:
            p.setdefault("track_no", 0)
            p.setdefault("segment_no", 0)
        for rows in self.series().values():
            for i, r in enumerate(rows):
                r.setdefault("seq", i)
        for i, lap in enumerate(self.laps):
            lap.setdefault("lap_no", i + 1)
            lap.setdefault("track_no", 0)
        return self

    def nested(self) -> dict:
        """The row of a decoded file."""
        self.numbered()
        pick = lambda t, r: {n: _plain(r.get(n)) for n, _ in columns(t)}
        return {"info": pick("info", self.info)} | {t: [pick(t, r) for r in getattr(self, t)] for t in TABLES if t != "info"}


def _plain(v):
    return [*v.items()] if isinstance(v, dict) else v


def nested_arrays(recordings: list[Recording]) -> list[pa.Array]:
    """The rows of decoded files, without their names, in the order of nested_ddl(); made column by column."""
    for rec in recordings:
        rec.numbered()
    out = [pa.array([{n: _plain(rec.info.get(n)) for n, _ in columns("info")} for rec in recordings], row_type("info"))]
    for t in TABLES:
        if t == "info":
            continue
        lists = [getattr(rec, t) for rec in recordings]
        rows, kind = [*chain.from_iterable(lists)], row_type(t)
        found = set().union(*rows)
        fields = []
        for f in kind:
            if f.name not in found:
                fields.append(pa.nulls(len(rows), f.type))
                continue
            values = [r.get(f.name) for r in rows]
            fields.append(pa.array([_plain(v) for v in values] if pa.types.is_map(f.type) else values, f.type))
        ends = pa.array([*accumulate(map(len, lists), initial=0)], pa.int32())
        out.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, fields=[*kind])))
    return out


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse_time(text: str | None) -> int | None:
    """Microseconds of an ISO 8601 text; without a zone it is UTC. Null where it is none."""
    if not text:
        return None
    try:
        t = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    d = (t if t.tzinfo else t.replace(tzinfo=timezone.utc)) - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


@lru_cache(4096)
def _day(days: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(days=days)).strftime("%Y-%m-%d")


def show_time(us: int) -> str:
    """UTC text with three decimals, or six where needed."""
    s, rest = divmod(us, 1_000_000)
    days, s = divmod(s, 86_400)
    base = f"{_day(days)}T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    return f"{base}.{rest // 1000:03d}Z" if rest % 1000 == 0 else f"{base}.{rest:06d}Z"


def parse_number(text: str | None) -> float | None:
    """A finite or not finite number, or null where the text is none."""
    if text is None or "_" in text:
        return None
    try:
        return float(text)
    except ValueError:
        return None


def show_number(x: float) -> str:
    """Shortest text that reads back, with an exponent only for very large and very small numbers."""
    text = repr(float(x))
    if "e" in text and 1e-6 <= abs(x) < 1e21:
        text = format(Decimal(text), "f")
        text = text if "." in text else text + ".0"
    return text


def whole(x: float) -> int:
    """Rounded half away from zero."""
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def fixed(x: float, digits: int) -> str:
    return f"{x:.{digits}f}"
