"""GPX 1.0 and 1.1 recordings."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET

from . import xml_tools as x
from .recording import Recording, fixed, parse_number, parse_time, show_time, whole

#: Sensor tags of trackpoint extensions and their channels, standard point tags in schema order, sport labels (fixed values).
TAGS = {"hr": "heart_rate", "cad": "cadence", "cadence": "cadence", "power": "power", "atemp": "temperature", "temp": "temperature", "wtemp": "water_temperature", "depth": "depth", "speed": "speed", "course": "course", "bearing": "bearing"}
ATTRIBUTES = ("magvar", "geoidheight", "name", "cmt", "desc", "src", "sym", "type", "fix", "sat", "hdop", "vdop", "pdop", "ageofdgpsdata", "dgpsid")
_ATTRIBUTES = frozenset(ATTRIBUTES)
SPORT_LABELS = {"running": "running", "cycling": "cycling", "biking": "cycling", "bike": "cycling", "swimming": "swimming", "hiking": "hiking", "walking": "walking", "other": "other"}
#: Written tags: (channel, tag, decimals; None for whole numbers, "ele" for the elevation's).
WRITTEN = (("heart_rate", "hr", None), ("cadence", "cad", None), ("power", "power", None), ("temperature", "atemp", 1), ("water_temperature", "wtemp", 1), ("depth", "depth", "ele"), ("speed", "speed", 2), ("course", "course", 1), ("bearing", "bearing", 1))
TPX = "http://www.garmin.com/xmlschemas/TrackPointExtension/v2"
ROUTE_TAGS = ("cmt", "desc", "src", "number", "type")


def metres(a: dict, b: dict) -> float:
    """Great-circle distance of two points."""
    la, lb = math.radians(a["latitude"]), math.radians(b["latitude"])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b["longitude"] - a["longitude"]) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _attributes(e: ET.Element) -> dict[str, str] | None:
    found = {x.name(c): t for c in e if x.name(c) in ATTRIBUTES and (t := x.text(c))}
    return found or None


def _standalone(rec: Recording, e: ET.Element, kind: str, route: int | None, label: str | None) -> None:
    lat, lon = parse_number(e.get("lat")), parse_number(e.get("lon"))
    if lat is None or lon is None:
        return
    raw = x.text(e, "time")
    time = parse_time(raw)
    if raw and time is None:
        rec.say("warning", f"gpx.{x.name(e)}.invalid_timestamp", f"Bad time {raw}; epoch is used", f"gpx.{x.name(e)}")
    rec.waypoints.append({"kind": kind, "route_no": route, "time": time or 0, "latitude": lat, "longitude": lon, "elevation": parse_number(x.text(e, "ele")), "name": label, "attributes": _attributes(e)})


def _track(rec: Recording, trk: ET.Element, no: int) -> None:
    segment, laps = -1, 0
    for seg in x.children(trk, "trkseg"):
        found: list[dict] = []
        for i, pt in enumerate(x.children(seg, "trkpt")):
            node = f"gpx.trk.trkseg.trkpt[{i}]"
            kids = x.firsts(pt)
            lat, lon = parse_number(pt.get("lat")), parse_number(pt.get("lon"))
            if lat is None or lon is None:
                rec.say("warning", "gpx.trackpoint.missing_coordinates", "Point without coordinates skipped", node)
                continue
            raw = x.leaf(kids.get("time"))
            if raw is None:
                rec.say("warning", "gpx.trackpoint.missing_timestamp", "Point without time skipped", node)
                continue
            if (time := parse_time(raw)) is None:
                rec.say("warning", "gpx.trackpoint.invalid_timestamp", f"Bad time {raw}; point skipped", node)
                continue
            ele = x.leaf(kids.get("ele"))
            if ele is not None and parse_number(ele) is None:
                rec.say("warning", "gpx.trackpoint.invalid_elevation", f"Bad elevation {ele}", node)
            other = []
            for ext in (c for e in x.children(pt, "extensions") for c in e) if "extensions" in kids else ():
                if x.name(ext) != "TrackPointExtension":
                    other.append(ext)
                    continue
                for c in ext:
                    if (value := x.leaf(c)) is None:
                        continue
                    if (number := parse_number(value)) is None:
                        rec.say("warning", "gpx.extension.invalid_number", f"Bad value {value}", f"{node}.extensions.{x.name(c)}")
                    else:
                        rec.sample(TAGS.get(x.name(c), x.name(c)), time, number, no)
            found.append({"time": time, "latitude": lat, "longitude": lon, "elevation": parse_number(ele), "attributes": None if _ATTRIBUTES.isdisjoint(kids) else _attributes(pt), "extensions": x.keep(other), "track_no": no})
        if found:
            segment, laps = segment + 1, laps + 1
            for p in found:
                p["segment_no"] = segment
            rec.points += found
            length = sum(metres(a, b) for a, b in zip(found, found[1:]))
            rec.laps.append({"track_no": no, "lap_no": laps, "start_time": found[0]["time"], "end_time": found[-1]["time"], "distance_m": length or None, "name": f"Segment {laps}"})


def decode(text: str) -> Recording:
    """Tracks, segments (each also a lap), sensors, waypoints and routes."""
    rec = Recording({"format": "gpx", "sport": "unknown"})
    try:
        root = x.parse(text)
    except ET.ParseError as e:
        rec.say("error", "gpx.parse.xml_error", f"Malformed GPX: {e}", "gpx.document")
        return rec
    meta = x.first(root, "metadata")
    rec.info |= {"creator": root.get("creator"), "name": x.text(meta, "name") or x.text(root, "name"), "description": x.text(meta, "desc") or x.text(root, "desc")}
    kept = [c for e in (meta, root) if e is not None for ext in x.children(e, "extensions") for c in ext]
    tracks = [*x.children(root, "trk")]
    for no, trk in enumerate(tracks):
        sport = SPORT_LABELS.get((x.text(trk, "type") or "").lower(), "unknown")
        if rec.info["sport"] == "unknown":
            rec.info["sport"] = sport
        _track(rec, trk, no)
    if len(tracks) > 1:
        rec.say("info", "gpx.multi_track", f"{len(tracks)} tracks", "gpx.trk")
    import json

    names = {"track_name": x.text(tracks[0], "name"), "track_description": x.text(tracks[0], "desc"), "track_type": x.text(tracks[0], "type")} if tracks else {}
    extra = {k: v for k, v in names.items() if v} | ({"extensions": json.loads(x.keep(kept))} if kept else {})
    rec.info["metadata"] = json.dumps(extra, ensure_ascii=False) if extra else None
    for w in x.children(root, "wpt"):
        _standalone(rec, w, "waypoint", None, x.text(w, "name"))
    for r, route in enumerate(x.children(root, "rte")):
        for p in x.children(route, "rtept"):
            _standalone(rec, p, "route", r, x.text(route, "name"))
    return rec


def _place(parent: ET.Element, tag: str, p: dict, options) -> ET.Element:
    e = x.put(parent, tag, lat=fixed(p["latitude"], options.precision_lat_lon), lon=fixed(p["longitude"], options.precision_lat_lon))
    if p.get("elevation") is not None:
        x.put(e, "ele", fixed(p["elevation"], options.precision_elevation))
    if tag == "trkpt" or p["time"]:
        x.put(e, "time", show_time(p["time"]))
    for a in ATTRIBUTES:
        if value := (p.get("attributes") or {}).get(a):
            x.put(e, a, value)
    return e


def _lines(points: list[dict], options, written: list[tuple]) -> list[str]:
    """The lines of track points without kept extensions; written is (tag, decimals, time -> value)."""
    out, place, height = [], f".{options.precision_lat_lon}f", f".{options.precision_elevation}f"
    for p in points:
        out.append(f'      <trkpt lat="{p["latitude"]:{place}}" lon="{p["longitude"]:{place}}">')
        if (ele := p.get("elevation")) is not None:
            out.append(f"        <ele>{ele:{height}}</ele>")
        out.append(f"        <time>{show_time(p['time'])}</time>")
        if kept := p.get("attributes"):
            out += [f"        <{a}>{x.escaped(kept[a])}</{a}>" for a in ATTRIBUTES if kept.get(a)]
        values = [f"            <gpxtpx:{tag}>{whole(v) if digits is None else fixed(v, digits)}</gpxtpx:{tag}>" for tag, digits, find in written if (v := find(p["time"])) is not None]
        if values:
            out += ["        <extensions>", "          <gpxtpx:TrackPointExtension>", *values, "          </gpxtpx:TrackPointExtension>", "        </extensions>"]
        out.append("      </trkpt>")
    return out


def encode(rec: Recording, options, near=None) -> str:
    """GPX text; near[(track_no, channel)](time) gives the nearest value within the channel's tolerance."""
    return _encode(rec, options, near, None if any(p.get("extensions") for p in rec.points) else x.Bodies())


def _encode(rec: Recording, options, near, bodies: x.Bodies | None) -> str:
    """The points as lines in bodies, or as elements without them, for extensions with namespaces of their own."""
    import json

    v10, info = options.gpx_version == "1.0", rec.info
    space = f"http://www.topografix.com/GPX/1/{0 if v10 else 1}"
    root = ET.Element("gpx", {"creator": info.get("creator") or "trailframe", "version": "1.0" if v10 else "1.1", "xmlns": space, "xmlns:gpxtpx": TPX})
    extra = json.loads(info.get("metadata") or "{}") if info.get("format") == "gpx" else {}
    points = sorted(rec.points, key=lambda p: (p.get("track_no", 0), p["time"]))
    if points or info.get("creator") or info.get("name") or info.get("description"):
        meta = root if v10 else x.put(root, "metadata")
        named = [(k, v) for k, v in (("name", info.get("name")), ("desc", info.get("description"))) if (v or "").strip()]
        stamp = [("time", show_time(points[0]["time"]))] if points else []
        for tag, value in named + stamp if v10 else stamp + named:
            x.put(meta, tag, value)
        device = {k: info.get(k) for k in ("manufacturer", "model", "product", "serial_number", "software_version") if info.get(k)}
        if device or extra.get("extensions"):
            ext = x.put(meta, "extensions")
            if device:
                d = x.put(ext, "device")
                for k, v in device.items():
                    x.put(d, k, v)
            x.restore(ext, json.dumps(extra.get("extensions", [])))
    for w in (w for w in rec.waypoints if w["kind"] == "waypoint"):
        _place(root, "wpt", w, options)
    for r in sorted({w["route_no"] for w in rec.waypoints if w["kind"] == "route"}):
        own = [w for w in rec.waypoints if w["kind"] == "route" and w["route_no"] == r]
        rte = x.put(root, "rte")
        if own[0].get("name"):
            x.put(rte, "name", own[0]["name"])
        for p in own:
            _place(rte, "rtept", p, options)
    tracks: dict[int, dict[int, list[dict]]] = {}
    for p in points:
        tracks.setdefault(p.get("track_no", 0), {}).setdefault(p.get("segment_no", 0), []).append(p)
    for no in sorted(tracks or {0: {}}):
        trk = x.put(root, "trk")
        x.put(trk, "name", extra.get("track_name") or info.get("name") or info.get("creator") or ("Workout" if no == 0 else "Track"))
        if extra.get("track_description"):
            x.put(trk, "desc", extra["track_description"])
        x.put(trk, "type", extra.get("track_type") or (info.get("sport") or "unknown").capitalize())
        written = [(tag, options.precision_elevation if digits == "ele" else digits, near[no, channel]) for channel, tag, digits in WRITTEN if near and (no, channel) in near]
        for _, own in sorted(tracks.get(no, {}).items()):
            part = x.put(trk, "trkseg")
            if bodies is not None:
                bodies.put(part, _lines(own, options, written), 2)
                continue
            for p in own:
                e = _place(part, "trkpt", p, options)
                values = [(tag, digits, v) for tag, digits, find in written if (v := find(p["time"])) is not None]
                if values or p.get("extensions"):
                    ext = x.put(e, "extensions")
                    if values:
                        tpx = x.put(ext, "gpxtpx:TrackPointExtension")
                        for tag, digits, v in values:
                            x.put(tpx, f"gpxtpx:{tag}", whole(v) if digits is None else fixed(v, digits))
                    x.restore(ext, p.get("extensions"))
    return x.show(root, bodies)
