"""FIT messages built by hand."""

import struct

from trailframe.sources import fit_format as ff

T0 = 1_000_000_000
US = (T0 + ff.EPOCH_S) * 1_000_000


def test_developer_fields_use_declared_type_name_scale_and_offset():
    e = ff.Encoder()
    e.write(1, 206, [[(0, 0x02, 0), (1, 0x02, 3), (2, 0x02, 0x88), (3, 0x07, b"Leg Spring!"), (6, 0x02, 2), (7, 0x02, 1)]])
    e.define(2, 20, [(253, 4, 0x86)], [(3, 4, 0), (9, 2, 1)])
    e.out += bytes([2]) + ff.packed(0x86, T0) + struct.pack("<f", 10.5) + struct.pack("<H", 0x3412)
    rec = ff.decode(e.file())
    assert {c: s[0]["value"] for c, s in rec.series().items()} == {"leg_spring": 4.25, "fit_dev_1_9": 0x3412}


def test_first_developer_field_is_running_power_by_convention():
    e = ff.Encoder()
    e.define(2, 20, [(253, 4, 0x86)], [(0, 2, 0)])
    e.out += bytes([2]) + ff.packed(0x86, T0) + struct.pack("<H", 250)
    assert ff.decode(e.file()).series()["running_power"][0]["value"] == 250


def test_headers_of_12_bytes_and_without_checksum():
    e = ff.Encoder()
    e.write(0, 20, [[(253, 0x86, T0), (3, 0x02, 99)]])
    for head in (struct.pack("<BBHI4s", 12, 16, 0, len(e.out), b".FIT"), struct.pack("<BBHI4sH", 14, 16, 0, len(e.out), b".FIT", 0)):
        data = head + bytes(e.out)
        rec = ff.decode(data + struct.pack("<H", ff.crc16(data)))
        assert not rec.diagnostics and rec.samples[0]["value"] == 99
    broken = struct.pack("<BBHI4sH", 14, 16, 0, len(e.out), b".FIT", 1) + bytes(e.out)
    assert {d["code"] for d in ff.decode(broken).diagnostics} == {"fit.header.crc_mismatch", "fit.trailer.truncated"}


def test_sessions_laps_lengths_sets():
    e = ff.Encoder()
    rows = [[(253, 0x86, T0), (5, 0x00, sport), (6, 0x00, sub), (7, 0x86, 60_000), (10, 0x86, cycles), (41, 0x84, 123), (43, 0x00, 3), (44, 0x84, 2500), (47, 0x84, 40)] for sport, sub, cycles in ((5, 0, None), (2, 7, 88))]
    e.write(1, 18, rows)
    e.write(2, 19, [[(2, 0x86, T0), (7, 0x86, 30_000), (9, 0x86, 10_000), (13, 0x84, 3250), (38, 0x00, 7), (40, 0x84, 4)]])
    e.write(3, 225, [[(254, 0x86, T0 + 30), (0, 0x86, 10_000), (5, 0x02, 0), (3, 0x84, None), (4, 0x84, None), (7, 0x84, 8)]])
    e.write(4, 101, [[(253, 0x86, None), (2, 0x86, T0), (3, 0x86, 5000), (5, 0x84, 11), (7, 0x00, 9), (12, 0x00, 0)]])
    rec = ff.decode(e.file())
    s = rec.info["summary"]
    assert rec.info["sport"] == "swimming" and s["elapsed_s"] == 60 and s["pool_length_m"] == 25 and s["avg_stroke_count"] == 12.3 and s["swim_stroke"] == 3 and "sub_sport" not in s and "total_cycles" not in s
    assert s["session2.sub_sport"] == 7 and s["session2.total_cycles"] == 88 and [d["code"] for d in rec.diagnostics] == ["fit.multi_session"]
    lap = rec.laps[0]
    assert (lap["start_time"], lap["end_time"], lap["distance_m"], lap["avg_speed"]) == (US, US + 30_000_000, 100.0, 3.25)
    assert rec.sets[0] == {"start_time": US + 20_000_000, "end_time": US + 30_000_000, "is_rest": True, "category_id": 8, "repetitions": None, "weight_kg": None}
    assert rec.lengths[0]["end_time"] == US + 5_000_000 and rec.lengths[0]["stroke"] is None and not rec.lengths[0]["active"]


def test_device_messages():
    e = ff.Encoder()
    e.write(0, 0, [[(0, 0x00, 4), (1, 0x84, 1), (2, 0x84, 3121), (3, 0x8C, 77)]])
    e.write(1, 23, [[(0, 0x02, 0), (2, 0x84, 1), (3, 0x8C, 78), (4, 0x84, 3122), (5, 0x84, 1250), (27, 0x07, b"Edge")]])
    e.write(2, 23, [[(0, 0x02, 5), (2, 0x84, 32), (5, 0x84, 100)]])
    e.write(3, 34, [[(0, 0x86, 61_500)]])
    info = ff.decode(e.file()).info
    assert info["manufacturer"] == "Garmin" and info["model"] == "Edge" and info["software_version"] == "12.5" and info["serial_number"] == "78" and info["summary"]["timer_s"] == 61.5
    assert info["creator"] == "FIT Device Garmin p3121 s77"
    assert [ff.version_text(v) for v in (100, 120, 123, 0, None)] == ["1", "1.2", "1.23", None, None]


def test_none_values_arrays_and_vendor_records():
    e = ff.Encoder()
    e.define(1, 20, [(253, 4, 0x86), (7, 2, 0x84), (90, 4, 0x84), (3, 1, 0x02)])
    e.out += bytes([1]) + ff.packed(0x86, T0) + struct.pack("<HHHB", 255, 1, 2, 70)
    e.define(2, 9999, [(253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85)])
    e.out += bytes([2]) + ff.packed(0x86, T0 + 1) + ff.packed(0x85, 2**30) + ff.packed(0x85, -(2**30))
    rec = ff.decode(e.file())
    assert {c: s[0]["value"] for c, s in rec.series().items()} == {"heart_rate": 70}
    assert [(p["latitude"], p["longitude"]) for p in rec.points] == [(90.0, -90.0)]


def test_big_endian_and_text():
    e = ff.Encoder()
    e.out += bytes([0x40, 0, 1]) + struct.pack(">HB", 20, 2) + bytes([253, 4, 0x86, 5, 4, 0x86]) + bytes([0]) + struct.pack(">II", T0, 12345)
    assert ff.decode(e.file()).series()["distance"][0]["value"] == 123.45
    assert ff.cut_utf8("é" * 40) == ("é" * 31).encode() and ff.cut_utf8("") is None and ff.crc16(b"123456789") == 0xBB3D


def test_outlying_points():
    points = [{"time": i * 1_000_000, "latitude": 40.0, "longitude": 10.0} for i in range(12)]
    far = [{"time": 10**15, "latitude": 1.0, "longitude": 1.0}]
    assert len(ff.contiguous(points + far)) == 12
    ends = [{"time": -1, "latitude": 80.0, "longitude": 10.0}, *points]
    assert len(ff.contiguous(ends)) == 12 and ff.contiguous(far * 3) == far * 3
