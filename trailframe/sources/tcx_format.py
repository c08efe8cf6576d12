"""TCX v1 and v2 recordings."""

from __future__ import annotations

import bisect
import xml.etree.ElementTree as ET

from . import xml_tools as x
from .gpx_format import metres
from .recording import Recording, fixed, parse_number, parse_time, show_time, whole

#: Sport labels read and written (fixed values); what is not written by name is "Other".
SPORT_LABELS = {"running": "running", "biking": "cycling", "cycling": "cycling", "bike": "cycling", "swimming": "swimming", "swim": "swimming", "walking": "walking", "other": "other"}
WRITTEN_SPORTS = {"running": "Running", "cycling": "Biking", "walking": "Walking"}
_NODE = "tcx.activities.activity.lap"


def _creator(e: ET.Element) -> dict:
    c = x.first(e, "Creator")
    if c is None:
        return {}
    label = x.text(c, "Name") or (c.text or "").strip() or None
    core = [p for p in (x.text(c, "Version", "VersionMajor"), x.text(c, "Version", "VersionMinor")) if p]
    build = [p for p in (x.text(c, "Version", "BuildMajor"), x.text(c, "Version", "BuildMinor")) if p]
    version = "+".join(p for p in (".".join(core), ".".join(build)) if p)
    device = {
        "manufacturer": x.text(c, "Manufacturer"), "model": x.text(c, "Name"), "product": x.text(c, "ProductID") or x.text(c, "Product"),
        "serial_number": x.text(c, "UnitId") or x.text(c, "SerialNumber"), "software_version": version or None}
    return {"creator": label} | {k: v for k, v in device.items() if v}


def _point(rec: Recording, tp: ET.Element) -> int | None:
    kids = x.firsts(tp)
    raw = x.leaf(kids.get("Time"))
    if raw is None:
        rec.say("warning", "tcx.trackpoint.missing_time", "Trackpoint without time skipped", f"{_NODE}.track.trackpoint")
        return None
    if (time := parse_time(raw)) is None:
        rec.say("warning", "tcx.trackpoint.invalid_time", f"Bad time {raw}; trackpoint skipped", f"{_NODE}.track.trackpoint")
        return None
    place = x.firsts(kids["Position"]) if "Position" in kids else {}
    lat, lon = parse_number(x.leaf(place.get("LatitudeDegrees"))), parse_number(x.leaf(place.get("LongitudeDegrees")))
    alt = x.leaf(kids.get("AltitudeMeters"))
    if alt is not None and parse_number(alt) is None:
        rec.say("warning", "tcx.trackpoint.invalid_altitude", f"Bad altitude {alt}", f"{_NODE}.track.trackpoint")
    if lat is None or lon is None:
        rec.say("warning", "tcx.trackpoint.missing_coordinates", "Trackpoint without coordinates; only its sensors are read", f"{_NODE}.track.trackpoint")
    else:
        rec.points.append({"time": time, "latitude": lat, "longitude": lon, "elevation": parse_number(alt)})
    plain = None
    for channel, code, path in (("heart_rate", "heartrate", ("HeartRateBpm", "Value")), ("cadence", "cadence", ("Cadence",)), ("distance", "distance", ("DistanceMeters",))):
        if path[0] not in kids:
            continue
        value = x.text(kids[path[0]], *path[1:])
        number = parse_number(value)
        if number is not None:
            rec.sample(channel, time, number)
            plain = number if channel == "cadence" else plain
        elif value is not None:
            rec.say("warning", f"tcx.trackpoint.invalid_{code}", f"Bad value {value}", f"{_NODE}.track.trackpoint.{path[0]}")
    for c in (c for e in x.children(tp, "Extensions") for t in x.children(e, "TPX") for c in t) if "Extensions" in kids else ():
        number = parse_number(x.leaf(c))
        channel = {"Speed": "speed", "Watts": "power", "RunCadence": "cadence" if plain is None else None}.get(x.name(c))
        if number is not None and channel:
            rec.sample(channel, time, number)
    return time


def decode(text: str) -> Recording:
    """All activities of a file as one; laps carry the sport of theirs. Of each lap the first track is read."""
    rec = Recording({"format": "tcx", "sport": "unknown"})
    try:
        root = x.parse(text)
    except ET.ParseError as e:
        rec.say("error", "tcx.parse.xml_error", f"Malformed TCX: {e}", "tcx.document")
        return rec
    found = [e for e in root.iter() if x.name(e) == "Activity"]
    rec.info["author"] = x.text(next((e for e in root.iter() if x.name(e) == "Author"), None), "Name")
    if len(found) > 1:
        rec.say("info", "tcx.multi_activity", f"{len(found)} activities are read as one", "tcx.activities")
    for i, act in enumerate(found):
        sport = SPORT_LABELS.get((act.get("Sport") or "").strip().lower(), "unknown")
        if i == 0:
            rec.info["sport"] = sport
        rec.info["notes"] = rec.info.get("notes") or x.text(act, "Notes")
        for k, v in _creator(act).items():
            if not rec.info.get(k):
                rec.info[k] = v
        for lap in x.children(act, "Lap"):
            raw = lap.get("StartTime")
            start = parse_time(raw)
            if raw is not None and start is None:
                rec.say("warning", "tcx.lap.invalid_start_time", f"Bad start time {raw}; lap ignored", _NODE)
                continue
            if (track := x.first(lap, "Track")) is None:
                rec.say("warning", "tcx.lap.missing_track", "Lap without a track skipped", _NODE)
                continue
            times = [t for tp in x.children(track, "Trackpoint") if (t := _point(rec, tp)) is not None]
            if not times:
                continue
            number = lambda *path, lap=lap: parse_number(x.text(lap, *path))
            lx = lambda tag, lap=lap: next((v for e in x.children(lap, "Extensions") for c in x.children(e, "LX") if (v := parse_number(x.text(c, tag))) is not None), None)
            rec.laps.append({
                "start_time": times[0] if start is None else start, "end_time": times[-1], "distance_m": number("DistanceMeters"), "name": f"Lap {len(rec.laps) + 1}", "sport": sport,
                "calories": number("Calories"), "max_speed": number("MaximumSpeed"), "avg_heart_rate": number("AverageHeartRateBpm", "Value"), "max_heart_rate": number("MaximumHeartRateBpm", "Value"),
                "avg_cadence": number("Cadence"), "max_cadence": lx("MaxBikeCadence"), "avg_speed": lx("AvgSpeed"), "avg_power": lx("AvgWatts"), "max_power": lx("MaxWatts"),
                "intensity": x.text(lap, "Intensity"), "trigger": x.text(lap, "TriggerMethod")})
    return rec


def _bpm(parent: ET.Element, tag: str, value: float | None) -> None:
    if value is not None:
        x.put(x.put(parent, tag), "Value", whole(value))


def _lines(points: list[dict], near, options) -> list[str]:
    """The lines of the trackpoints of a lap."""
    out, gone, before, place = [], 0.0, None, f".{options.precision_lat_lon}f"
    find = {c: near[0, c] for c in ("distance", "heart_rate", "cadence", "speed", "power") if near and (0, c) in near}
    for p in points:
        t = p["time"]
        v = {c: f(t) for c, f in find.items()}
        known = v.get("distance")
        gone = known if known is not None else gone + (metres(before, p) if before else 0.0)
        before = p
        out += [
            "          <Trackpoint>", f"            <Time>{show_time(t)}</Time>", "            <Position>", f"              <LatitudeDegrees>{p['latitude']:{place}}</LatitudeDegrees>",
            f"              <LongitudeDegrees>{p['longitude']:{place}}</LongitudeDegrees>", "            </Position>"]
        if p.get("elevation") is not None:
            out.append(f"            <AltitudeMeters>{fixed(p['elevation'], options.precision_elevation)}</AltitudeMeters>")
        out.append(f"            <DistanceMeters>{gone:.1f}</DistanceMeters>")
        if v.get("heart_rate") is not None:
            out += ["            <HeartRateBpm>", f"              <Value>{whole(v['heart_rate'])}</Value>", "            </HeartRateBpm>"]
        if v.get("cadence") is not None:
            out.append(f"            <Cadence>{whole(v['cadence'])}</Cadence>")
        speed, watts = v.get("speed"), v.get("power")
        if speed is not None or watts is not None:
            out += ["            <Extensions>", "              <ns3:TPX>"]
            if speed is not None:
                out.append(f"                <ns3:Speed>{speed:.3f}</ns3:Speed>")
            if watts is not None:
                out.append(f"                <ns3:Watts>{whole(watts)}</ns3:Watts>")
            out += ["              </ns3:TPX>", "            </Extensions>"]
        out.append("          </Trackpoint>")
    return out


def _lap(parent: ET.Element, lap: dict, points: list[dict], near, options, total: float, bodies: x.Bodies, times: list[int]) -> None:
    e = x.put(parent, "Lap", StartTime=show_time(lap["start_time"]))
    x.put(e, "TotalTimeSeconds", fixed((lap["end_time"] - lap["start_time"]) / 1e6, 3))
    x.put(e, "DistanceMeters", fixed(total if lap.get("distance_m") is None else lap["distance_m"], 1))
    if lap.get("max_speed") is not None:
        x.put(e, "MaximumSpeed", fixed(lap["max_speed"], 3))
    if lap.get("calories") is not None:
        x.put(e, "Calories", whole(lap["calories"]))
    _bpm(e, "AverageHeartRateBpm", lap.get("avg_heart_rate"))
    _bpm(e, "MaximumHeartRateBpm", lap.get("max_heart_rate"))
    for tag, value in (("Intensity", lap.get("intensity")), ("Cadence", None if lap.get("avg_cadence") is None else whole(lap["avg_cadence"])), ("TriggerMethod", lap.get("trigger"))):
        if value is not None:
            x.put(e, tag, value)
    first, last = bisect.bisect_left(times, lap["start_time"]), bisect.bisect_right(times, lap["end_time"])
    bodies.put(x.put(e, "Track"), _lines(points[first:last], near, options), 4)
    extra = [(t, v) for t, v in (("AvgSpeed", lap.get("avg_speed")), ("MaxBikeCadence", lap.get("max_cadence")), ("AvgWatts", lap.get("avg_power")), ("MaxWatts", lap.get("max_power"))) if v is not None]
    if extra:
        lx = x.put(x.put(e, "Extensions"), "ns3:LX")
        for tag, v in extra:
            x.put(lx, f"ns3:{tag}", fixed(v, 3) if tag == "AvgSpeed" else whole(v))


def encode(rec: Recording, options, near=None) -> str:
    """TCX text; points on a border of laps are in both, points outside all laps are left out."""
    v, info = options.tcx_version, rec.info
    space = f"http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v{v}"
    root = ET.Element("TrainingCenterDatabase", {"xmlns": space, "xmlns:ns3": "http://www.garmin.com/xmlschemas/ActivityExtension/v2", "xmlns:xsi": "http://www.w3.org/2001/XMLSchema-instance"})
    bodies = x.Bodies()
    activities, points = x.put(root, "Activities"), sorted(rec.points, key=lambda p: p["time"])
    if not points:
        return x.show(root)
    last = [s["value"] for s in rec.samples if s["channel"] == "distance"]
    total = last[-1] if last else sum(metres(a, b) for a, b in zip(points, points[1:]))
    laps = rec.laps or [{"start_time": points[0]["time"], "end_time": points[-1]["time"], "distance_m": total, "name": "Lap 1"}]
    act, sport, times = None, None, [p["time"] for p in points]
    for i, lap in enumerate(laps):
        own = lap.get("sport") or info.get("sport") or "unknown"
        if act is None or own != sport:
            if act is not None:
                _tail(act, info, first=i > 0 and len(activities) == 1)
            act, sport = x.put(activities, "Activity", Sport=WRITTEN_SPORTS.get(own, "Other")), own
            x.put(act, "Id", show_time(lap["start_time"]))
        _lap(act, lap, points, near, options, total, bodies, times)
    _tail(act, info, first=len(activities) == 1)
    if (info.get("author") or "").strip():
        x.put(x.put(root, "Author", **{"xsi:type": "Application_t"}), "Name", info["author"].strip())
    return x.show(root, bodies)


def _tail(act: ET.Element, info: dict, first: bool) -> None:
    """Notes (of the first activity) and creator."""
    if first and (info.get("notes") or "").strip():
        x.put(act, "Notes", info["notes"].strip())
    if any(info.get(k) for k in ("manufacturer", "model", "product", "serial_number", "software_version")):
        c = x.put(act, "Creator", **{"xsi:type": "Device_t"})
        for tag, value in (("Name", info.get("model") or info.get("creator")), ("Manufacturer", info.get("manufacturer")), ("ProductID", info.get("product")), ("UnitId", info.get("serial_number"))):
            if value:
                x.put(c, tag, value)
        if info.get("software_version"):
            core, _, build = info["software_version"].partition("+")
            version = x.put(c, "Version")
            for tag, value in zip(("VersionMajor", "VersionMinor", "BuildMajor", "BuildMinor"), [*(core.split(".") + [""])[:2], *(build.split(".") + [""])[:2]]):
                if value:
                    x.put(version, tag, value)
    elif info.get("creator"):
        x.put(act, "Creator", info["creator"])
