"""Readers, writers, detection, engine, command line and streams."""

import base64

import pytest
from pyspark.sql import functions as F

from trailframe import cli
from trailframe.plans.engine import Engine
from trailframe.sources import files, fit_format
from trailframe.sources.detect import decode_text, detect
from trailframe.sources.recording import Recording, parse_time, show_number, show_time

T = parse_time("2024-04-01T06:00:00Z")
CSV = "Timestamp,Latitude,longitude,elevation,heart_rate,sport,vo2\n2024-04-01T06:00:00Z,40,-105,1600,140,Cycling,3.5\nbad,1,2,,,,\n2024-04-01T06:00:05Z,x,2,,,,\n2024-04-01T06:00:10,40.1,-105.1,,142,,\n"


def sample() -> Recording:
    rec = Recording({"format": "gpx", "sport": "cycling", "creator": "unit", "manufacturer": "Garmin", "fit_manufacturer_id": 1, "summary": {"calories": 120.0, "field_99": 5.0}})
    for i in range(3):
        t = T + i * 5_000_000
        rec.points.append({"time": t, "latitude": 40 + i * 0.0005, "longitude": -105 - i * 0.0005, "elevation": 1600.0 + i})
        for c, v in (("heart_rate", 140 + i), ("power", 200 + i), ("temperature", 21), ("distance", 10.5 * i), ("speed", 3.25), ("my_chan", 1.5 * i)):
            rec.sample(c, t, v)
    rec.laps.append({"start_time": T, "end_time": T + 10_000_000, "distance_m": 150.0, "name": "Lap 1", "avg_heart_rate": 141.0, "sport": "cycling"})
    rec.sets.append({"start_time": T, "end_time": T + 3_000_000, "is_rest": False, "category_id": 28, "repetitions": 8, "weight_kg": 60.5})
    rec.events.append({"time": T, "event": 0, "event_type": 4, "data": None})
    rec.lengths.append({"start_time": T, "end_time": T + 5_000_000, "active": True, "strokes": 10, "avg_speed": 1.1, "stroke": "butterfly"})
    return rec.numbered()


@pytest.mark.parametrize("fmt,lost", [("gpx", {"distance", "my_chan"}), ("tcx", {"temperature", "my_chan"}), ("csv", set()), ("geojson-points", set()), ("fit", set())])
def test_round_trip(fmt, lost):
    rec = sample()
    back = files.decode_file(files.encode_file(rec, fmt))
    assert [p["time"] for p in back.points] == [p["time"] for p in rec.points]
    assert all(abs(a["latitude"] - b["latitude"]) < 1e-6 and a["elevation"] == b["elevation"] for a, b in zip(back.points, rec.points))
    want = {k: [s["value"] for s in v] for k, v in rec.series().items() if k not in lost}
    assert {k: [s["value"] for s in v] for k, v in back.series().items()} == want
    assert not back.diagnostics


def test_fit_keeps_sets_events_lengths_and_unknown_fields():
    back = files.decode_file(files.encode_file(sample(), "fit"))
    assert back.sets[0]["weight_kg"] == 60.5 and back.events[0]["event_type"] == 4 and back.lengths[0]["stroke"] == "butterfly"
    assert back.info["summary"]["field_99"] == 5.0 and back.info["manufacturer"] == "Garmin" and back.laps[0]["avg_heart_rate"] == 141.0


def test_fit_extra_fields_and_arrays():
    rec = sample()
    rec.laps[0]["extra"] = {"event": 9.0, "field_90": -3.0, "field_91[0]": 5.0, "field_91[1]": 7.0}
    rec.laps.append(rec.laps[0] | {"extra": {"field_90": 4.0}})
    back = fit_format.decode(files.encode_file(rec, "fit"))
    assert back.laps[0]["extra"] == rec.laps[0]["extra"] and back.laps[1]["extra"] == {"field_90": 4.0}


def test_fit_integrity():
    data = bytearray(files.encode_file(sample(), "fit"))
    data[-1] ^= 1
    assert [d["code"] for d in fit_format.decode(bytes(data)).diagnostics] == ["fit.trailer.crc_mismatch"]
    assert not fit_format.decode(bytes(data), "silent").diagnostics
    with pytest.raises(fit_format.FitError):
        fit_format.decode(bytes(data), "strict")
    assert {d["code"] for d in fit_format.decode(bytes(data[:-2])).diagnostics} == {"fit.trailer.truncated"}
    assert files.decode_file(b"no fit at all", fmt="fit").diagnostics[0]["severity"] == "error"


def test_fit_compressed_time_packed_speed_and_resync():
    e = fit_format.Encoder()
    e.out.append(5)  # data without a definition
    e.define(0, 20, [(253, 4, 0x86), (3, 1, 0x02), (8, 3, 0x0D)])
    e.out += bytes([0]) + fit_format.packed(0x86, 1_000_000_030) + bytes([120]) + bytes([0x2C, 0x01, 0x10])
    e.out += bytes([0x80 | (1_000_000_030 + 3) & 31]) + fit_format.packed(0x86, None) + bytes([121]) + bytes([0x2C, 0x01, 0x20])
    rec = fit_format.decode(e.file())
    hr = rec.series()["heart_rate"]
    assert [s["value"] for s in hr] == [120, 121] and hr[1]["time"] - hr[0]["time"] == 3_000_000
    assert [s["value"] for s in rec.series()["speed"]] == [3.0, 3.0] and [s["value"] for s in rec.series()["distance"]] == [0.0, 16.0]
    assert rec.diagnostics[0]["code"] == "fit.data.unknown_definition"


def test_csv_reader():
    rec = files.decode_file(CSV.encode(), "x.csv")
    assert [p["latitude"] for p in rec.points] == [40.0, 40.1] and rec.info["sport"] == "cycling"
    assert [d["code"] for d in rec.diagnostics] == ["csv.row.invalid_timestamp", "csv.row.invalid_coordinates"]
    assert {k: len(v) for k, v in rec.series().items()} == {"heart_rate": 2, "vo2": 1}


def test_gpx_segments_waypoints_and_bad_points():
    text = """<gpx creator="c" xmlns="http://www.topografix.com/GPX/1/1" xmlns:x="urn:x"><wpt lat="1" lon="2"><name>W</name></wpt><rte><name>R</name><rtept lat="3" lon="4"/></rte>
    <trk><name>n</name><type>Biking</type><trkseg><trkpt lat="40" lon="-105"><ele>x</ele><time>2024-01-01T00:00:00Z</time><fix>3d</fix><extensions><x:TrackPointExtension><x:hr>90</x:hr><x:foo>1.5</x:foo></x:TrackPointExtension></extensions></trkpt>
    <trkpt lat="40.001" lon="-105"><time>2024-01-01T00:00:10Z</time></trkpt><trkpt lat="40"><time>2024-01-01T00:00:20Z</time></trkpt><trkpt lat="40" lon="1"><time>nope</time></trkpt></trkseg>
    <trkseg><trkpt lat="40.002" lon="-105"><time>2024-01-01T00:01:00Z</time></trkpt></trkseg></trk></gpx>"""
    rec = files.decode_file(text.encode())
    assert [p["segment_no"] for p in rec.points] == [0, 0, 1] and rec.info["sport"] == "cycling"
    assert [lap["name"] for lap in rec.laps] == ["Segment 1", "Segment 2"] and rec.laps[1]["distance_m"] is None and abs(rec.laps[0]["distance_m"] - 111.19) < 0.1
    assert rec.points[0]["attributes"] == {"fix": "3d"} and set(rec.series()) == {"heart_rate", "foo"}
    assert [d["code"].split(".")[-1] for d in rec.diagnostics] == ["invalid_elevation", "missing_coordinates", "invalid_timestamp"]
    assert [(w["kind"], w["name"], w["time"]) for w in rec.waypoints] == [("waypoint", "W", 0), ("route", "R", 0)]
    back = files.decode_file(files.encode_file(rec.numbered(), "gpx"))
    assert [p["segment_no"] for p in back.points] == [0, 0, 1] and len(back.waypoints) == 2


def test_geojson_kinds():
    line = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[1,2,3],[4,"5"]],[]]},"properties":{"activity_type":"Running","w":7,"coordinateProperties":{"times":["2024-01-01T00:00:00Z",null]}}}'
    rec = files.decode_file(line.encode())
    assert [(p["latitude"], p["time"] == 0) for p in rec.points] == [(2.0, False), (5.0, True)] and [s["value"] for s in rec.series()["w"]] == [7, 7]
    assert [d["code"] for d in rec.diagnostics] == ["geojson.polygon_holes_dropped"]
    assert files.decode_file(b'{"type":"FeatureCollection","features":[]}', fmt="geojson").diagnostics[0]["code"] == "geojson.empty_collection"


def test_tcx_border_point_is_in_both_laps():
    rec = sample()
    rec.laps = [{"start_time": T, "end_time": T + 5_000_000, "sport": "running"}, {"start_time": T + 5_000_000, "end_time": T + 10_000_000, "sport": "cycling"}]
    text = files.encode_file(rec, "tcx").decode()
    assert text.count("<Trackpoint>") == 4 and text.count("<Activity ") == 2
    back = files.decode_file(text.encode())
    assert [lap["sport"] for lap in back.laps] == ["running", "cycling"] and back.diagnostics[0]["code"] == "tcx.multi_activity"


def test_detection():
    fit = files.encode_file(sample(), "fit")
    assert detect(fit) == "fit" and detect(base64.b64encode(fit)) == "fit" and detect(b"x", "a/b.TCX?q=1") == "tcx"
    assert detect(CSV.encode()) == "csv" and detect("<gpx>".encode("utf-16")) == "gpx" and detect(b"hello") is None
    assert decode_text("é<gpx".encode("utf-16")) == "é<gpx"
    assert files.decode_file(b"x" * 100, fmt="csv", limit=10).diagnostics[0]["code"] == "parser.payload_too_large"


def test_numbers_and_times():
    assert show_number(0.00001) == "0.00001" and show_number(40.0) == "40.0" and show_time(T + 1500) == "2024-04-01T06:00:00.001500Z"
    assert parse_time("2024-04-01 08:00:00+02:00") == T and parse_time("x") is None


def test_engine(spark, tmp_path):
    for fmt in ("gpx", "tcx", "csv", "fit"):
        (tmp_path / f"a.{fmt}").write_bytes(files.encode_file(sample(), fmt))
    (tmp_path / "broken.gpx").write_text("<gpx")
    engine = Engine(spark)
    a = engine.load(str(tmp_path))
    assert a.points.groupBy("activity_id").count().count() == 4
    assert [r.code for r in a.diagnostics.collect()] == ["gpx.parse.xml_error"]
    out = engine.export(a, "csv")
    assert out.encoded.count() == 5 and out.diagnostics.where("code = 'lossy.laps_dropped'").count() == 3
    again = engine.convert(str(tmp_path / "a.fit"), "gpx", auto_fix=None)
    text = again.texts().first().text
    assert len(files.decode_file(text.encode()).points) == 3
    assert {r.code for r in again.diagnostics.collect()} >= {"lossy.sets_dropped", "lossy.events_dropped", "lossy.lengths_dropped", "lossy.laps_dropped", "lossy.summary_dropped"}
    engine.save(a, str(tmp_path / "tables"))
    assert engine.open(str(tmp_path / "tables")).points.count() == 12
    seen = []
    batch = engine.load_batch([str(tmp_path / f"a.{f}") for f in ("gpx", "tcx", "csv")], lambda *n: seen.append(n), files_per_job=2)
    assert seen == [(2, 3), (3, 3)] and batch.points.count() == 9
    large = files.load(spark, str(tmp_path), limit=700, glob="*.gpx")
    assert large.diagnostics.where("code = 'parser.payload_too_large'").count() == 1


def test_tuples(spark):
    loc = spark.createDataFrame([("a", 2000, 1.0, 2.0, None), ("a", 1000, 1.0, 2.0, None)], "activity_id string, timestamp long, latitude double, longitude double, elevation double")
    ch = spark.createDataFrame([("a", " HR ", 1000, 5.0)], "activity_id string, channel string, timestamp long, value double")
    a = files.from_tuples(loc, ch)
    assert [r.time for r in a.points.orderBy("seq").collect()] == [1_000_000, 2_000_000] and a.samples.first().channel == "hr"
    assert files.combined_csv(a).count() == 2


def test_registered_format(spark, tmp_path):
    files.READERS["dot"] = lambda data: Recording({"format": "dot"}, [{"time": 0, "latitude": 1.0, "longitude": float(len(data))}])
    try:
        assert files.decode_file(b"abc", fmt="dot").points[0]["longitude"] == 3.0
    finally:
        files.READERS.clear()


def test_command_line(tmp_path, capsys):
    source, out = tmp_path / "a.csv", tmp_path / "a.gpx"
    source.write_text(CSV)
    assert cli.main(["convert", "--from", "csv", "--to", "gpx", "-i", str(source), "-o", str(out)]) == 0 and out.read_text().count("<trkpt") == 2
    assert cli.main(["convert", "--from", "csv"]) == 64 and cli.main(["convert", "--from", "csv", "--to", "gpx", "-i", "none", "-o", "x"]) == 66
    source.write_text("nothing")
    assert cli.main(["convert", "--from", "csv", "--to", "gpx", "-i", str(source), "-o", str(out)]) == 65
    assert cli.main(["validate"]) == 64


def test_streams(spark, tmp_path):
    from trailframe.streaming import operators as stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fit").write_bytes(files.encode_file(sample(), "fit"))
    q = stream.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out/points")).count() == 3
    rows = spark.range(6).select(F.lit(1).cast("long").alias("activity_id"), F.col("id").alias("seq"), (F.col("id") * 3).alias("time"))
    rows.coalesce(1).write.parquet(str(tmp_path / "points"))
    q = stream.start_memory(stream.downsample(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "points")), 6), "kept", "append")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.time for r in spark.table("kept").collect()) == [0, 6, 12]


def test_gpx_nodes(spark):
    from trailframe.sources import gpx_nodes as nodes

    info = spark.createDataFrame([("a", "gpx", "running", "Garmin", None, 7, None), ("b", "gpx", "running", None, " ", None, '{"track_name":"n","extensions":[{"tag":"{urn:x}old","text":"kept"}]}')],
                                 "activity_id string, format string, sport string, manufacturer string, model string, fit_product_id int, metadata string")
    for c in ("product", "serial_number", "software_version", "fit_manufacturer_id", "creator", "name", "description", "notes", "author"):
        info = info.withColumn(c, F.lit(None).cast("string"))
    out = nodes.with_nodes(info, nodes.label_node(F.lit("Race")), nodes.device_node(extras={"battery": F.lit(90)}))
    points = spark.createDataFrame([("a", 0, 0, 0, T, 1.0, 2.0), ("b", 0, 0, 0, T, 1.0, 2.0)], "activity_id string, track_no int, segment_no int, seq long, time long, latitude double, longitude double")
    from trailframe.model import Activities

    texts = {r.activity_id: bytes(r.content).decode() for r in files.encoded(Activities(points=points, info=out), "gpx").collect()}
    assert "Race" in texts["a"] and "fitProductId" in texts["a"] and ">90<" in texts["a"] and "<name>n</name>" in texts["b"] and "Race" in texts["b"] and "kept" in texts["b"]


def test_native_detection_equals_the_python_one(spark):
    from trailframe.functions.sniff import detect_format

    fit = files.encode_file(sample(), "fit")
    payloads = [fit, base64.b64encode(fit), CSV.encode(), b"\xef\xbb\xbf" + CSV.encode(), "<gpx>".encode("utf-16"), b"<?xml?><gpx/>", b"<TrainingCenterDatabase/>", b'{"type": "Feature"}', b"hello", b"a\0b", b"\x01\x02\x03\x04\x05", b"", b"YWJjZGVmZ2hpamtsbW5v"]
    rows = [(None, bytearray(p)) for p in payloads] + [("x/y.JSON#a", bytearray(b"z")), ("q.txt", bytearray(b"z"))]
    df = spark.createDataFrame(rows, "name string, content binary")
    got = [r.f for r in df.select(detect_format(F.col("name"), F.col("content")).alias("f")).collect()]
    assert got == [detect(bytes(p), n) for n, p in rows]


def test_builder(spark):
    from datetime import datetime

    from trailframe.sources.builder import ActivityBuilder

    b = ActivityBuilder("x").set(sport="running").points([(T + 5_000_000, 1, 2, 3.0), (T, 1, 2)]).channel("HR", [(T, 1)]).channel("hr", [(T, 5), (datetime(2024, 4, 1, 6, 0, 5), 6)])
    a = b.lap(T, T + 5_000_000, name="l").workout_set(T, T + 1, repetitions=3).build(spark)
    assert [r.time for r in a.points.orderBy("seq").collect()] == [T, T + 5_000_000] and [r.value for r in a.samples.orderBy("seq").collect()] == [5, 6]
    assert a.info.first().sport == "running" and a.sets.first().repetitions == 3 and b.clear().build(spark, False).points.count() == 0


def test_round_trips_keep_recordings_that_cannot_be_written(spark, sf_dir, monkeypatch):
    from trailframe.plans.queries import QUERIES

    real = files.encoded

    def failing(a, fmt):
        bad = F.col("activity_id") == "3"
        return real(a, fmt).withColumns({"content": F.when(~bad, F.col("content")), "error": F.when(bad, F.lit('no "way"'))})

    for name in ("snk7_fit_files", "snk11_csv_texts"):
        every = {r.activity_id: r for r in QUERIES[name](spark, sf_dir).collect()}
        with monkeypatch.context() as m:
            m.setattr(files, "encoded", failing)
            got = {r.activity_id: r for r in QUERIES[name](spark, sf_dir).collect()}
        assert set(got) == set(every) and "3" in got and got["3"].points is None and got["3"].samples is None
        assert all(got[k] == every[k] for k in got if k != "3")
        if name == "snk7_fit_files":
            assert got["3"].error == 'no "way"' and all(r.error is None for r in every.values())
