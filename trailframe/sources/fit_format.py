"""FIT recordings: a table-driven decoder and encoder of the binary format."""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass
from functools import cache

from ..functions.columns import EXERCISES
from ..functions.manufacturers import MANUFACTURERS
from .gpx_format import metres
from .recording import Recording, whole

EPOCH_S, LATEST = 631_065_600, 1_924_992_000
#: Base types: code -> (struct letter, size, invalid value); sports and strokes by number (fixed values).
TYPES = {
    0x00: ("B", 1, 0xFF), 0x01: ("b", 1, 0x7F), 0x02: ("B", 1, 0xFF), 0x83: ("h", 2, 0x7FFF), 0x84: ("H", 2, 0xFFFF), 0x85: ("i", 4, 0x7FFFFFFF), 0x86: ("I", 4, 0xFFFFFFFF),
    0x88: ("f", 4, None), 0x89: ("d", 8, None), 0x0A: ("B", 1, 0), 0x8B: ("H", 2, 0), 0x8C: ("I", 4, 0), 0x0D: ("B", 1, 0xFF),
    0x8E: ("q", 8, 2**63 - 1), 0x8F: ("Q", 8, 2**64 - 1), 0x90: ("Q", 8, 0),
}
BY_NUMBER = {code & 0x1F: t for code, t in TYPES.items()}
SPORT_IDS = {0: "unknown", 1: "running", 2: "cycling", 5: "swimming", 11: "walking", 17: "hiking"}
STROKES = ("freestyle", "backstroke", "breaststroke", "butterfly", "drill", "mixed", "im")
#: Field of a message -> (column, scale). Session, lap and record as the public profile numbers them.
SESSION = {
    7: ("elapsed_s", 1000), 8: ("timer_s", 1000), 9: ("distance_m", 100), 10: ("total_cycles", 1), 11: ("calories", 1), 14: ("avg_speed", 1000), 15: ("max_speed", 1000),
    16: ("avg_heart_rate", 1), 17: ("max_heart_rate", 1), 18: ("avg_cadence", 1), 19: ("max_cadence", 1), 20: ("avg_power", 1), 21: ("max_power", 1),
    6: ("sub_sport", 1), 41: ("avg_stroke_count", 10), 43: ("swim_stroke", 1), 44: ("pool_length_m", 100), 47: ("num_active_lengths", 1),
}
LAP = {
    9: ("distance_m", 100), 11: ("calories", 1), 13: ("avg_speed", 1000), 14: ("max_speed", 1000), 15: ("avg_heart_rate", 1), 16: ("max_heart_rate", 1),
    17: ("avg_cadence", 1), 18: ("max_cadence", 1), 19: ("avg_power", 1), 20: ("max_power", 1),
}
LAP_EXTRA = {0: "event", 1: "event_type", 38: "swim_stroke", 40: "num_active_lengths"}
RECORD = {3: ("heart_rate", 1), 4: ("cadence", 1), 5: ("distance", 100), 6: ("speed", 1000), 7: ("power", 1), 13: ("temperature", 1), 78: ("grade", 100), 120: ("left_right_balance", 1)}
HANDLED = {0, 18, 19, 20, 21, 23, 34, 49, 101, 206, 225}
INTEGRITY = re.compile(r"^fit\.(header|trailer)")


class FitError(ValueError):
    """A file whose header is not FIT, or that fails its checks in strict mode."""


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xA001 if b & 1 else 0)
        out.append(b)
    return out


_CRC = _crc_table()


@cache
def _crc_pairs() -> list[int]:
    """The checksum after two bytes, by the checksum before with both mixed in."""
    once = [c >> 8 ^ _CRC[c & 0xFF] for c in range(65536)]
    return [c >> 8 ^ _CRC[c & 0xFF] for c in once]


def crc16(data: bytes) -> int:
    crc, pairs = 0, _crc_pairs()
    for w in struct.unpack_from(f"<{len(data) // 2}H", data):
        crc = pairs[crc ^ w]
    return crc >> 8 ^ _CRC[(crc ^ data[-1]) & 0xFF] if len(data) % 2 else crc


@dataclass
class Layout:
    """A definition message: fields (number, size, type) and developer fields (number, size, index)."""

    message: int
    order: str
    fields: list[tuple[int, int, int]]
    developer: list[tuple[int, int, int]]

    def __post_init__(self):
        self.size, self.plan = sum(f[1] for f in self.fields + self.developer), None

    def like_record(self) -> bool:
        return self.message not in HANDLED and {253, 0, 1} <= {f[0] for f in self.fields}


def _layout(data: bytes, at: int, developer: bool) -> tuple[Layout, int] | None:
    if at + 5 > len(data):
        return None
    order = ">" if data[at + 1] == 1 else "<"
    message, count = struct.unpack_from(order + "H", data, at + 2)[0], data[at + 4]
    at += 5
    if at + 3 * count > len(data):
        return None
    fields = [tuple(data[i : i + 3]) for i in range(at, at + 3 * count, 3)]
    at += 3 * count
    extra = []
    if developer:
        if at >= len(data) or at + 1 + 3 * data[at] > len(data):
            return None
        n = data[at]
        extra = [tuple(data[i : i + 3]) for i in range(at + 1, at + 1 + 3 * n, 3)]
        at += 1 + 3 * n
    return Layout(message, order, fields, extra), at


def _value(raw: bytes, kind: int, order: str):
    """A number, a text, or a list for arrays; null for the invalid value."""
    if kind & 0x1F == 7:
        return raw.split(b"\0")[0].decode("utf-8", "replace") or None
    letter, size, invalid = BY_NUMBER.get(kind & 0x1F, ("B", 1, 0xFF))
    if kind & 0x1F == 13 and len(raw) > 1:
        return [*raw]
    if size == 1 and letter != "d" and len(raw) > 1 and kind & 0x1F not in (13,):
        raw = raw[:1]
    n = len(raw) // size
    if n == 0:
        return None
    got = [None if v == invalid or (isinstance(v, float) and math.isnan(v)) else v for v in struct.unpack_from(f"{order}{n}{letter}", raw)]
    if n == 1:
        return got[0]
    got = [v for v in got if v is not None]
    return got or None


def number(v) -> float | int | None:
    """A number, unless it is one of the four values that stand for "none" in any width."""
    if isinstance(v, bool) or not isinstance(v, (int, float)) or (isinstance(v, float) and not math.isfinite(v)):
        return None
    return None if int(v) in (0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF) else v


def scaled(v, scale: float) -> float | None:
    return None if (n := number(v)) is None else n / scale


def unknown_fields(v: dict, known: set) -> dict[str, float]:
    """Numbers as field_n and arrays as field_n[i] of the fields that are not known."""
    out: dict[str, float] = {}
    for k, raw in v.items():
        if isinstance(k, tuple) or k in known:
            continue
        if isinstance(raw, list):
            out |= {f"field_{k}[{i}]": float(x) for i, x in enumerate(raw)}
        elif (x := number(raw)) is not None:
            out[f"field_{k}"] = float(x)
    return out


def timestamp(v) -> int | None:
    """Microseconds of FIT seconds within the plausible range."""
    return (int(v) + EPOCH_S) * 1_000_000 if isinstance(v, (int, float)) and 1 <= int(v) <= LATEST else None


def degrees(v) -> float | None:
    if not isinstance(v, int) or v in (0x7FFFFFFF, 0x80000000):
        return None
    d = v * 180.0 / 2**31
    return d if -180 <= d <= 180 else None


def channel_name(text: str) -> str | None:
    clean = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", text.strip().lower()))
    return clean if clean and not clean[0].isdigit() else None


def version_text(raw) -> str | None:
    v = scaled(raw, 100)
    if v is None or v <= 0:
        return None
    text = f"{v:.2f}"
    return text[:-3] if text.endswith("00") else text[:-1] if text.endswith("0") else text


class Decoder:
    """Walks the messages of one file; one method for each kind."""

    def __init__(self, data: bytes):
        self.data, self.rec = data, Recording({"format": "fit", "sport": "unknown"})
        self.layouts: dict[int, Layout] = {}
        self.seen: dict[int, int] = {}
        self.latest: int | None = None
        self.developer: dict[tuple[int, int], dict] = {}
        self.described = 0  # descriptions of developer fields so far, for which plans of layouts hold
        self.sessions, self.packed, self.unknown, self.recovered, self.any_data = [], None, 0, 0, False

    def run(self) -> Recording:
        data, rec = self.data, self.rec
        if len(data) < 12 or data[0] < 12:
            raise FitError("no FIT header")
        size, length = data[0], struct.unpack_from("<I", data, 4)[0]
        if size > len(data):
            raise FitError("the header is cut short")
        if size >= 14:
            stored = struct.unpack_from("<H", data, size - 2)[0]
            if stored and stored != crc16(data[: size - 2]):
                rec.say("error", "fit.header.crc_mismatch", "The header checksum fails", "fit.header")
        if data[8:12] != b".FIT":
            raise FitError("the file is no FIT file")
        end = size + length
        if end > len(data):
            rec.say("error", "fit.header.size_mismatch", "The header promises more data than there is", "fit.header")
        if len(data) < end + 2:
            rec.say("error", "fit.trailer.truncated", "The trailer is missing", "fit.trailer")
        elif struct.unpack_from("<H", data, end)[0] != crc16(data[:end]):
            rec.say("error", "fit.trailer.crc_mismatch", "The trailer checksum fails", "fit.trailer")
        self.walk(size, min(end, len(data)))
        return self.finish()

    def walk(self, at: int, end: int) -> None:
        data = self.data
        while at < end:
            head = data[at]
            at += 1
            packed = head & 0x80
            local = head >> 5 & 3 if packed else head & 15
            stamp = None
            if packed:
                offset, before = head & 31, self.seen.get(local)
                stamp = offset
                if before is None:
                    self.seen[local] = offset
                else:
                    value = before & ~31 | offset
                    stamp = (value + 32 if value <= before else value) & 0xFFFFFFFF
            elif head & 0x40:
                if (found := _layout(data, at, bool(head & 0x20))) is None:
                    return
                self.layouts[local], at = found
                continue
            self.any_data = True
            layout = self.layouts.get(local)
            if layout is None:
                at = self.resync(at, end, local)
                continue
            if at + layout.size > len(data):
                self.rec.say("warning", "fit.data.read_failed", f"Message {layout.message} is cut short", "fit.message")
                return
            values = self.values(layout, at)
            at += layout.size
            if stamp is not None:
                values[253] = stamp
            if isinstance(values.get(253), (int, float)):
                self.seen[local] = self.latest = int(values[253])
            self.message(layout, local, values)

    def plan(self, layout: Layout) -> tuple | None:
        """(struct, keys, invalid values) of a layout of single numbers with different keys, which are read at once; null for others."""
        kinds = [(n, size, kind) for n, size, kind in layout.fields]
        for n, size, index in layout.developer:
            kind = self.developer.get((index, n), {}).get("type")
            kinds.append(((index, n), size, {1: 0x02, 2: 0x84, 4: 0x86, 8: 0x8F}.get(size, 0x0D) if kind is None else kind))
        types = [BY_NUMBER.get(kind & 0x1F, ("B", 1, 0xFF)) for _, _, kind in kinds]
        keys = [k for k, _, _ in kinds]
        if len({*keys}) < len(keys) or any(kind & 0x1F == 7 or size != t[1] for (_, size, kind), t in zip(kinds, types)):
            return None
        return struct.Struct(layout.order + "".join(t[0] for t in types)), keys, [t[2] for t in types]

    def values(self, layout: Layout, at: int) -> dict:
        if layout.plan is None or layout.plan[0] != self.described:
            layout.plan = self.described, self.plan(layout)
        if plan := layout.plan[1]:
            return {k: v for k, v, none in zip(plan[1], plan[0].unpack_from(self.data, at), plan[2]) if v != none and v == v}
        out: dict = {}
        for n, size, kind in layout.fields:
            out[n] = _value(self.data[at : at + size], kind, layout.order)
            at += size
        for n, size, index in layout.developer:
            kind = self.developer.get((index, n), {}).get("type")
            if kind is None:
                kind = {1: 0x02, 2: 0x84, 4: 0x86, 8: 0x8F}.get(size, 0x0D)
            out[index, n] = _value(self.data[at : at + size], kind, layout.order)
            at += size
        return {k: v for k, v in out.items() if v is not None}

    def resync(self, at: int, end: int, local: int) -> int:
        """Where a plausible definition begins within 2048 bytes, else one byte further."""
        self.unknown += 1
        if self.unknown <= 5:
            self.rec.say("warning", "fit.data.unknown_definition", f"Data without a definition ({local})", "fit.message")
        for p in range(at, min(end, at + 2048) - 6):
            head = self.data[p]
            if head & 0xC0 == 0x40 and (found := _layout(self.data, p + 1, bool(head & 0x20))) and found[0].fields and found[1] <= end:
                self.layouts[head & 15] = found[0]
                return found[1]
        if self.unknown <= 5:
            self.rec.say("warning", "fit.data.resync_failed", "No definition found; one byte is skipped", "fit.message")
        return at + 1

    def message(self, layout: Layout, local: int, v: dict) -> None:
        if layout.message == 20 or layout.like_record():
            self.record(local, v, layout.message != 20)
        elif method := getattr(self, f"message_{layout.message}", None):
            method(v)

    def record(self, local: int, v: dict, vendor: bool) -> None:
        rec, time = self.rec, timestamp(v.get(253))
        if time is None:
            known = self.seen.get(local, self.latest)
            if known is None:
                rec.say("warning", "fit.record.missing_timestamp", "Record without time skipped", "fit.record")
                return
            time, self.recovered = (known + EPOCH_S) * 1_000_000, self.recovered + 1
            if self.recovered <= 5:
                rec.say("warning", "fit.record.recovered_timestamp", "Record without time placed at the last one", "fit.record")
        lat, lon = degrees(v.get(0)), degrees(v.get(1))
        if vendor and (lat is None or lon is None):
            return
        if lat is not None and lon is not None:
            alt = v.get(2)
            rec.points.append({"time": time, "latitude": lat, "longitude": lon, "elevation": None if not isinstance(alt, (int, float)) or int(alt) == 0xFFFF else int(alt) / 5.0 - 500.0})
        for n, (channel, scale) in RECORD.items():
            if n in v and (x := scaled(v[n], scale)) is not None:
                rec.sample(channel, time, x)
        self.packed_speed(v, time)
        for k, raw in v.items():
            if (x := number(raw)) is None:
                continue
            if isinstance(k, tuple):
                d = self.developer.get(k, {})
                name = d.get("name") or ("running_power" if k == (0, 0) else f"fit_dev_{k[0]}_{k[1]}")
                rec.sample(name, time, x / d.get("scale", 1) - d.get("offset", 0))
            elif k not in RECORD and k not in (253, 0, 1, 2, 8):
                rec.sample(f"fit_field_{k}", time, x)

    def packed_speed(self, v: dict, time: int) -> None:
        """12 bits of speed and 12 bits of a distance counter that wraps; fields of their own win."""
        raw = v.get(8)
        if not isinstance(raw, list) or len(raw) < 3 or raw[:3] == [255] * 3:
            return
        bits = raw[0] | raw[1] << 8 | raw[2] << 16
        speed, count = bits & 0xFFF, bits >> 12
        gone = 0 if self.packed is None else self.packed[0] + (count - self.packed[1] & 0xFFF)
        self.packed = gone, count
        if number(v.get(6)) is None and speed != 0xFFF:
            self.rec.sample("speed", time, speed / 100.0)
        if number(v.get(5)) is None:
            self.rec.sample("distance", time, gone / 16.0)

    def message_0(self, v: dict) -> None:
        ids = {k: int(n) if (n := v.get(i)) is not None and isinstance(n, (int, float)) else None for k, i in (("m", 1), ("p", 2), ("s", 3))}
        maker = None if ids["m"] is None else MANUFACTURERS.get(ids["m"], f"manufacturer_{ids['m']}")
        model = v.get(8) if isinstance(v.get(8), str) and v[8].strip() else None
        self.rec.info |= {
            "manufacturer": maker, "model": model and model.strip(), "product": None if ids["p"] is None else str(ids["p"]), "serial_number": None if ids["s"] is None else str(ids["s"]),
            "fit_manufacturer_id": ids["m"], "fit_product_id": ids["p"]}
        parts = [maker, None if ids["p"] is None else f"p{ids['p']}", None if ids["s"] is None else f"s{ids['s']}"]
        self.rec.info["creator"] = " ".join(["FIT Device", *[p for p in parts if p]])

    def message_23(self, v: dict) -> None:
        if number(v.get(0)):
            return
        maker, serial, product = (None if (n := number(v.get(i))) is None else int(n) for i in (2, 3, 4))
        found = {
            "manufacturer": None if maker is None else MANUFACTURERS.get(maker, f"manufacturer_{maker}"), "model": (v[27].strip() or None) if isinstance(v.get(27), str) else None,
            "product": None if product is None else str(product), "serial_number": None if serial is None else str(serial), "software_version": version_text(v.get(5)),
            "fit_manufacturer_id": maker, "fit_product_id": product}
        self.rec.info |= {k: x for k, x in found.items() if x is not None}

    def message_49(self, v: dict) -> None:
        version, hardware = version_text(v.get(0)), number(v.get(1))
        if version:
            self.rec.info["software_version"] = version
        if not (self.rec.info.get("creator") or "").strip():
            self.rec.info["creator"] = " ".join(["FIT FileCreator", *([f"sw{version}"] if version else []), *([f"hw{int(hardware)}"] if hardware is not None else [])])

    def message_18(self, v: dict) -> None:
        summary = {name: x for n, (name, scale) in SESSION.items() if (x := scaled(v.get(n), scale)) is not None and not (name == "sub_sport" and x == 0)}
        known = {5, 253, 254, *SESSION}
        summary |= unknown_fields(v, known)
        if isinstance(v.get(5), int):
            summary["sport_id"] = float(v[5])
        self.sessions.append(summary)
        if len(self.sessions) == 1 and isinstance(v.get(5), int):
            self.rec.info["sport"] = SPORT_IDS.get(v[5], "other")

    def message_34(self, v: dict) -> None:
        if (t := scaled(v.get(0), 1000)) is not None:
            self.timer = t

    def message_19(self, v: dict) -> None:
        start, elapsed = timestamp(v.get(2)), number(v.get(7))
        if start is None or elapsed is None:
            return
        extra = {name: float(x) for n, name in LAP_EXTRA.items() if (x := number(v.get(n))) is not None}
        known = {2, 7, 253, 254, *LAP, *LAP_EXTRA}
        extra |= unknown_fields(v, known)
        row = {name: scaled(v.get(n), scale) for n, (name, scale) in LAP.items()}
        self.rec.laps.append({"start_time": start, "end_time": start + whole(elapsed) * 1000, "name": f"Lap {len(self.rec.laps) + 1}", "extra": extra or None} | row)

    def message_21(self, v: dict) -> None:
        time, event, kind, data = timestamp(v.get(253)), number(v.get(0)), number(v.get(1)), number(v.get(3))
        if None not in (time, event, kind):
            self.rec.events.append({"time": time, "event": int(event), "event_type": int(kind), "data": None if data is None else int(data)})

    def message_101(self, v: dict) -> None:
        start, end, elapsed = timestamp(v.get(2)), timestamp(v.get(253)), number(v.get(3))
        if end is None and start is not None and elapsed is not None:
            end = start + whole(elapsed) * 1000
        if start is not None and end is not None:
            strokes, stroke = number(v.get(5)), number(v.get(7))
            self.rec.lengths.append({
                "start_time": start, "end_time": end, "active": number(v.get(12)) != 0, "strokes": None if strokes is None else int(strokes), "avg_speed": scaled(v.get(6), 1000),
                "stroke": STROKES[int(stroke)] if stroke is not None and 0 <= stroke < len(STROKES) else None})

    def message_225(self, v: dict) -> None:
        end, start, took = timestamp(v.get(254)), timestamp(v.get(6)), number(v.get(0))
        if end is None:
            return
        category, reps = number(v[7][0] if isinstance(v.get(7), list) else v.get(7)), number(v.get(3))
        self.rec.sets.append({
            "start_time": start if start is not None else end - (whole(took) * 1000 if took is not None else 0), "end_time": end, "is_rest": v.get(5) == 0,
            "category_id": None if category is None else int(category), "repetitions": None if reps is None else int(reps), "weight_kg": scaled(v.get(4), 16)})

    def message_206(self, v: dict) -> None:
        self.described += 1
        index, field = number(v.get(0)), number(v.get(1))
        if index is None or field is None:
            return
        d = self.developer.setdefault((int(index), int(field)), {})
        if (kind := number(v.get(2))) is not None:
            d["type"] = int(kind)
        if isinstance(v.get(3), str) and (name := channel_name(v[3])):
            d["name"] = name
        if (scale := number(v.get(6))) and scale > 0:
            d["scale"] = float(scale)
        if offset := number(v.get(7)):
            d["offset"] = float(offset)

    def finish(self) -> Recording:
        rec = self.rec
        if self.sessions:
            rec.info["summary"] = dict(self.sessions[0])
            for i, s in enumerate(self.sessions[1:], 2):
                rec.info["summary"] |= {f"session{i}.{k}": x for k, x in s.items()}
        if (timer := getattr(self, "timer", None)) is not None:
            rec.info["summary"] = {"timer_s": timer} | (rec.info.get("summary") or {})
        before = len(rec.points)
        rec.points = contiguous(rec.points)
        if len(rec.points) < before:
            rec.say("warning", "fit.points.filtered_outliers", f"{before - len(rec.points)} outlying points removed", "fit.points")
        if not (rec.points or rec.samples or rec.laps) and self.any_data:
            rec.say("error", "fit.no_usable_data", "No usable data", "fit.file")
        if self.unknown > 5:
            rec.say("warning", "fit.data.unknown_definition.summary", f"{self.unknown} messages without a definition", "fit.message")
        if len(self.sessions) > 1:
            rec.say("info", "fit.multi_session", f"{len(self.sessions)} sessions", "fit.session")
        return rec


def contiguous(points: list[dict]) -> list[dict]:
    """Of more than ten points the largest run without a gap of 25 hours (of equal ones the later), without far ends."""
    if len(points) <= 10:
        return points
    points = sorted(points, key=lambda p: p["time"])
    runs = [[points[0]]]
    for a, b in zip(points, points[1:]):
        if b["time"] - a["time"] >= 25 * 3_600_000_000:
            runs.append([])
        runs[-1].append(b)
    best = max(reversed(runs), key=len)
    if len(best) >= 3:
        cut_first, cut_last = metres(best[0], best[1]) > 100_000, metres(best[-1], best[-2]) > 100_000
        best = best[cut_first : len(best) - cut_last]
    return best


def decode(data: bytes, integrity: str = "report") -> Recording:
    """integrity: report keeps the findings of checksums and sizes, strict raises on them, silent drops them."""
    rec = Decoder(data).run()
    bad = [d for d in rec.diagnostics if INTEGRITY.match(d["code"])]
    if bad and integrity == "strict":
        raise FitError("; ".join(d["code"] for d in bad))
    if integrity == "silent":
        rec.diagnostics = [d for d in rec.diagnostics if not INTEGRITY.match(d["code"])]
    return rec


class Encoder:
    """Messages of one file; a field is (number, type, value), null values are written as the type's invalid one."""

    def __init__(self):
        self.out = bytearray()

    def define(self, local: int, message: int, fields: list[tuple[int, int, int]], developer: list[tuple[int, int, int]] = ()) -> None:
        self.out += bytes([0x40 | (0x20 if developer else 0) | local, 0, 0]) + struct.pack("<HB", message, len(fields)) + b"".join(bytes(f) for f in fields)
        if developer:
            self.out += bytes([len(developer)]) + b"".join(bytes(f) for f in developer)

    def write(self, local: int, message: int, rows: list[list[tuple]]) -> None:
        """A definition from the first row, which all rows share, and the rows."""
        if not rows:
            return
        self.define(local, message, [(n, len(packed(kind, v)), kind) for n, kind, v in rows[0]])
        for row in rows:
            self.out.append(local)
            for _, kind, v in row:
                self.out += packed(kind, v)

    def file(self) -> bytes:
        head = struct.pack("<BBHI4s", 14, 0x10, 2140, len(self.out), b".FIT")
        data = head + struct.pack("<H", crc16(head)) + bytes(self.out)
        return data + struct.pack("<H", crc16(data))


def packed(kind: int, v) -> bytes:
    if kind == 0x07:
        return v + b"\0"
    if isinstance(v, list):
        return b"".join(packed(kind, x) for x in v)
    letter, _, _ = TYPES[kind]
    if letter in "fd":
        return struct.pack("<" + letter, float("nan") if v is None else v)
    return struct.pack("<" + letter, _filler(kind)(v))


@cache
def _filler(kind: int):
    """Number or null -> the whole number that a type holds for it."""
    letter, size, invalid = TYPES[kind]
    low, high = (0, 2 ** (8 * size) - 1) if letter.isupper() else (-(2 ** (8 * size - 1)), 2 ** (8 * size - 1) - 1)
    return lambda v: min(max(whole(invalid if v is None or not math.isfinite(v) else v), low), high)


def cut_utf8(text: str | None, most: int = 63) -> bytes | None:
    """At most so many bytes of UTF-8, cut between characters; null for nothing."""
    raw = (text or "").encode()[:most]
    return raw.decode("utf-8", "ignore").encode() or None


def _uint(text: str | None) -> int | None:
    return int(text) if (text or "").isdigit() else None


def _stamp(us: int | None) -> int | None:
    return None if us is None else us // 1_000_000 - EPOCH_S


def _times(v: float | None, scale: float) -> float | None:
    return None if v is None else v * scale


def _extras(rows: list[dict]) -> list[tuple[int, int, int]]:
    """(number, type, length) of the fields kept as field_n or field_n[i] in any row: the type holds them all, the longest array counts."""
    found: dict[int, int] = {}
    for key in {k for r in rows for k in r}:
        if (m := re.fullmatch(r"field_(\d+)(?:\[(\d+)\])?", key)) and int(m[1]) < 253:
            found[int(m[1])] = max(found.get(int(m[1]), 0), int(m[2]) + 1 if m[2] else 0)
    low = {int(re.match(r"field_(\d+)", k)[1]) for r in rows for k, v in r.items() if k.startswith("field_") and v < 0}
    return [(n, 0x85 if n in low else 0x86, size) for n, size in sorted(found.items())]


def _extra_values(row: dict, extra: list[tuple[int, int, int]]) -> list[tuple]:
    return [(n, kind, [row.get(f"field_{n}[{i}]", row.get(f"field_{n}") if i == 0 else None) for i in range(size)] if size else row.get(f"field_{n}")) for n, kind, size in extra]


def encode(rec: Recording, options, near=None) -> bytes:
    """FIT bytes; raises without points and samples. Channels without a field of their own become developer fields."""
    points = rec.points or [{"time": t} for t in sorted({s["time"] for s in rec.samples})]
    if not points:
        raise FitError("a FIT file needs a point or a sample")
    info, e = rec.info, Encoder()
    by_name = {n.lower(): i for i, n in MANUFACTURERS.items()}
    maker = info.get("fit_manufacturer_id") or by_name.get((info.get("manufacturer") or "").strip().lower())
    product = info.get("fit_product_id") if info.get("fit_product_id") is not None else _uint(info.get("product"))
    serial = _uint(info.get("serial_number"))
    e.write(0, 0, [[(0, 0x00, 4), (1, 0x84, maker or 1), (2, 0x84, 1 if product is None else product), (3, 0x8C, serial or 0)]])
    if any(info.get(k) for k in ("manufacturer", "model", "product", "serial_number", "software_version", "fit_manufacturer_id")):
        try:
            version = whole(float(info.get("software_version")) * 100)
        except (TypeError, ValueError):
            version = None
        model = cut_utf8(info.get("model"))
        e.write(9, 23, [[(2, 0x84, maker), (3, 0x8C, serial), (4, 0x84, product), (5, 0x84, version), *([(27, 0x07, model)] if model else [])]])
        if version is not None:
            e.write(10, 49, [[(0, 0x84, version)]])
    sport_ids = {s: i for i, s in SPORT_IDS.items()}
    summary = info.get("summary") or {}
    numbers = sorted({int(m[1]) for k in summary if (m := re.match(r"session(\d+)\.", k))})
    sessions = [{k: v for k, v in summary.items() if not k.startswith("session")}, *[{k.partition(".")[2]: v for k, v in summary.items() if k.startswith(f"session{n}.")} for n in numbers]]
    kinds = {7: 0x86, 8: 0x86, 9: 0x86, 10: 0x86, 11: 0x84, 14: 0x84, 15: 0x84, 16: 0x02, 17: 0x02, 18: 0x02, 19: 0x02, 20: 0x84, 21: 0x84, 6: 0x00, 41: 0x84, 43: 0x00, 44: 0x84, 47: 0x84}
    extra = _extras(sessions)
    e.write(1, 18, [[
        (253, 0x86, _stamp(points[0]["time"])), (5, 0x00, s.get("sport_id") if i else sport_ids.get(info.get("sport"), 0)),
        *[(n, kinds[n], _times(s.get(name), scale)) for n, (name, scale) in SESSION.items()], *_extra_values(s, extra),
    ] for i, s in enumerate(sessions)])
    lap_kinds = {9: 0x86, 11: 0x84, 13: 0x84, 14: 0x84, 15: 0x02, 16: 0x02, 17: 0x02, 18: 0x02, 19: 0x84, 20: 0x84}
    extras = [lap.get("extra") or {} for lap in rec.laps]
    extra = _extras(extras)
    e.write(2, 19, [[
        (253, 0x86, _stamp(lap["end_time"])), (2, 0x86, _stamp(lap["start_time"])), (7, 0x86, (lap["end_time"] - lap["start_time"]) / 1000),
        *[(n, lap_kinds[n], _times(lap.get(name), scale)) for n, (name, scale) in LAP.items()], *[(n, 0x84 if n == 40 else 0x00, x.get(name)) for n, name in LAP_EXTRA.items()],
        *_extra_values(x, extra),
    ] for lap, x in zip(rec.laps, extras, strict=True)])
    e.write(5, 21, [[(253, 0x86, _stamp(v["time"])), (0, 0x00, v["event"]), (1, 0x00, v["event_type"]), (3, 0x86, v.get("data"))] for v in rec.events])
    stroke = {s: i for i, s in enumerate(STROKES)}
    e.write(6, 101, [[
        (253, 0x86, _stamp(v["end_time"])), (2, 0x86, _stamp(v["start_time"])), (3, 0x86, (v["end_time"] - v["start_time"]) / 1000), (5, 0x84, v.get("strokes")),
        (6, 0x84, _times(v.get("avg_speed"), 1000)), (7, 0x00, stroke.get(v.get("stroke"))), (12, 0x00, int(bool(v.get("active")))),
    ] for v in rec.lengths])
    e.write(4, 225, [[
        (254, 0x86, _stamp(v["end_time"])), (6, 0x86, _stamp(v["start_time"])), (0, 0x86, (v["end_time"] - v["start_time"]) / 1000), (5, 0x02, 0 if v.get("is_rest") else 1),
        (3, 0x84, v.get("repetitions")), (4, 0x84, _times(v.get("weight_kg"), 16)), (7, 0x84, v.get("category_id")),
    ] for v in rec.sets])
    _records(e, rec, points, near or {})
    return e.file()


def _records(e: Encoder, rec: Recording, points: list[dict], near: dict) -> None:
    channels = {s["channel"] for s in rec.samples}
    kinds = {3: 0x02, 4: 0x02, 5: 0x86, 6: 0x84, 7: 0x84, 13: 0x01, 78: 0x83, 120: 0x02}
    fields = [(n, kinds[n], c, scale) for n, (c, scale) in RECORD.items() if c in channels]
    raw = sorted(c for c in channels if re.fullmatch(r"fit_field_\d{1,3}", c) and int(c[10:]) < 253)
    negative = {s["channel"] for s in rec.samples if s["value"] < 0}
    fields += [(int(c[10:]), 0x85 if c in negative else 0x86, c, 1) for c in raw]
    others = sorted(channels - {f[2] for f in fields})[:255]
    if others:
        e.write(7, 207, [[(3, 0x02, 0)]])
        for i, c in enumerate(others):
            e.write(8, 206, [[(0, 0x02, 0), (1, 0x02, i), (2, 0x02, 0x89), (3, 0x07, cut_utf8(c))]])
    e.define(3, 20, [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84), *[(n, TYPES[k][1], k) for n, k, _, _ in fields]], [(i, 8, 0) for i in range(len(others))])
    find = lambda c: near.get((0, c), lambda t: None)
    known, more = [(find(c), scale, _filler(kind)) for _, kind, c, scale in fields], [find(c) for c in others]
    row = struct.Struct("<BIiiH" + "".join(TYPES[k][0] for _, k, _, _ in fields) + "d" * len(others))
    stamp, place, height, none = _filler(0x86), _filler(0x85), _filler(0x84), float("nan")
    for p in points:
        t, ele = p["time"], p.get("elevation")
        lat, lon = p.get("latitude"), p.get("longitude")
        alt = None if ele is None or math.isnan(ele) else min(max((ele + 500.0) * 5.0, 0), 0xFFFF)
        e.out += row.pack(
            3, stamp(_stamp(t)), place(_times(lat, 2**31 / 180)), place(_times(lon, 2**31 / 180)), height(alt),
            *[fill(_times(at(t), scale)) for at, scale, fill in known], *[none if (v := at(t)) is None else v for at in more])
