"""CSV recordings: one row a point, channels in columns."""

from __future__ import annotations

import csv
import io

from ..functions.columns import SPORTS
from .recording import Recording, parse_number, parse_time, show_number, show_time

CHANNELS = ("heart_rate", "cadence", "power", "temperature", "distance", "speed")
KNOWN = ("timestamp", "latitude", "longitude", "elevation", *CHANNELS, "sport")
NEEDED = ("timestamp", "latitude", "longitude")


def decode(text: str) -> Recording:
    """Rows with a bad time or place are skipped with a warning that names the row; other numeric columns are channels."""
    rec = Recording({"format": "csv", "sport": "unknown"})
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        rec.say("error", "csv.empty", "No rows")
        return rec
    place = {h.strip().lower(): i for i, h in enumerate(rows[0])}
    if missing := [c for c in NEEDED if c not in place]:
        rec.say("error", "csv.missing_columns", "Missing columns: " + ", ".join(missing))
        return rec
    others = {h: i for h, i in place.items() if h not in KNOWN}
    listed = [c for c in CHANNELS if c in place]
    for number, row in enumerate(rows[1:], 2):
        cell = lambda name, r=row: (r[place[name]].strip() or None) if name in place and place[name] < len(r) else None
        time = parse_time(cell("timestamp"))
        if time is None:
            rec.say("warning", "csv.row.invalid_timestamp", f"Row {number} has a bad timestamp", f"csv.row[{number}]")
            continue
        lat, lon = parse_number(cell("latitude")), parse_number(cell("longitude"))
        if lat is None or lon is None:
            rec.say("warning", "csv.row.invalid_coordinates", f"Row {number} has bad coordinates", f"csv.row[{number}]")
            continue
        rec.points.append({"time": time, "latitude": lat, "longitude": lon, "elevation": parse_number(cell("elevation"))})
        sport = (cell("sport") or "").lower()
        if rec.info["sport"] == "unknown" and sport in SPORTS:
            rec.info["sport"] = sport
        for channel in listed:
            if (v := parse_number(cell(channel))) is not None:
                rec.sample(channel, time, v)
        for channel, i in others.items():
            if i < len(row) and (v := parse_number(row[i].strip() or None)) is not None:
                rec.sample(channel, time, v)
    if not rec.points:
        rec.say("error", "csv.no_points", "No valid points")
    return rec


def _values_by_time(rec: Recording) -> dict[int, dict[str, float]]:
    out: dict[int, dict[str, float]] = {}
    for s in rec.samples:
        out.setdefault(s["time"], {})[s["channel"]] = s["value"]
    return out


def encode(*recordings: Recording) -> str:
    """Fixed columns, then the other channels by name; values of exactly the point's time, the last of equal times."""
    extras = sorted({s["channel"] for r in recordings for s in r.samples} - set(CHANNELS))
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow([*KNOWN, *extras])
    show = lambda v: "" if v is None else show_number(v)
    for rec in recordings:
        values, sport = _values_by_time(rec), rec.info.get("sport") or "unknown"
        for p in rec.points:
            v = values.get(p["time"], {})
            writer.writerow([
                show_time(p["time"]), show(p["latitude"]), show(p["longitude"]), show(p.get("elevation")), *[show(v[c]) if c in v else "" for c in CHANNELS],
                sport, *[show(v[c]) if c in v else "" for c in extras]])
    return out.getvalue()
