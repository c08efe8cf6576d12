"""Operators on tiny recordings with known results."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailframe.functions import columns as fn
from trailframe.functions import mappers
from trailframe.model import Activities
from trailframe.operators import aggregates, edit, joins, normalize, resample, sets, validate, windows

S = 1_000_000
POINTS = "activity_id string, track_no int, segment_no int, seq long, time long, latitude double, longitude double, elevation double"
SAMPLES = "activity_id string, track_no int, channel string, seq long, time long, value double"
LAPS = "activity_id string, lap_no int, start_time long, end_time long, distance_m double, name string, sport string, avg_heart_rate double, max_heart_rate double"


def make(spark, points=(), samples=(), laps=(), sport="cycling"):
    """points (t, lat, lon, ele), samples {channel: [(t, v)]}, laps (start, end, name, sport), all times in seconds."""
    p = [("a", 0, 0, i, int(t * S), float(lat), float(lon), ele) for i, (t, lat, lon, ele) in enumerate(points)]
    s = [("a", 0, c, i, int(t * S), float(v)) for c, rows in dict(samples).items() for i, (t, v) in enumerate(rows)]
    laps = [("a", i + 1, int(b * S), int(e * S), None, n, sp, None, None) for i, (b, e, n, sp) in enumerate(laps)]
    return Activities(points=spark.createDataFrame(p, POINTS), samples=spark.createDataFrame(s, SAMPLES), laps=spark.createDataFrame(laps, LAPS), info=spark.createDataFrame([("a", sport)], "activity_id string, sport string"))


def seconds(df, *more):
    order = [c for c in ("channel", "seq", "lap_no") if c in df.columns]
    return [tuple(r) for r in df.orderBy(*order).select((F.col("time") / S).alias("t"), *more).collect()]


def spans(df):
    return [(r.start_time / S, r.end_time / S) for r in df.orderBy("lap_no").collect()]


TRACK = [(i * 10, 40 + i * 0.001, -105.0, None) for i in range(6)]
HR = {"heart_rate": [(i * 10, 140 + i) for i in range(6)]}


def test_crop_is_inclusive_and_clips_laps(spark):
    a = make(spark, TRACK, HR, [(0, 25, "x", None), (45, 50, "y", None)]).pipe(edit.crop, 10 * S, 40 * S)
    assert [t for t, in seconds(a.points)] == [10, 20, 30, 40]
    assert spans(a.laps) == [(10, 25)]
    with pytest.raises(ValueError):
        edit.crop(a, 2, 1)


def test_keep_last_of_equal_times(spark):
    a = make(spark, TRACK, {"heart_rate": [(0, 150), (0, 155), (5, 1)]}).pipe(windows.sort_and_dedup)
    assert seconds(a.samples, "value") == [(0, 155), (5, 1)]


def test_nearest_sample_and_ties(spark):
    a = make(spark, [(12, 0, 0, None), (2, 0, 0, None), (15, 0, 0, None), (99, 0, 0, None)], {"heart_rate": [(0, 130), (10, 140), (20, 150)]})
    later = joins.nearest(a.points, a.samples, ["activity_id"]).orderBy("seq").collect()
    assert [(r.value, r.delta) for r in later] == [(140, 2 * S), (130, 2 * S), (150, 5 * S), (None, None)]
    earlier = joins.nearest(a.points, a.samples, ["activity_id"], tie="earlier").orderBy("seq").collect()
    assert earlier[2].value == 140


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.lists(st.integers(0, 60), min_size=1, max_size=8), st.sampled_from(["later", "earlier"]))
def test_nearest_equals_brute_force(spark, targets, times, tie):
    times.sort()
    a = make(spark, [(t, 0.0, 0.0, None) for t in targets], {"x": [(t, i) for i, t in enumerate(times)]})
    got = [r.value for r in joins.nearest(a.points, a.samples, ["activity_id"], 10 * S, tie).orderBy("seq").collect()]

    def brute(t):
        after = [(u - t, i) for i, u in enumerate(times) if u >= t][:1]
        before = [(t - u, i) for i, u in enumerate(times) if u < t][-1:]
        order = after + before if tie == "later" else before + after
        best = min(order, key=lambda x: x[0])
        return float(best[1]) if best[0] <= 10 else None

    assert got == [brute(t) for t in targets]


def test_interval_rules(spark):
    laps = [(0, 10, "before", None), (5, 15, "over start", None), (12, 18, "inside", None), (15, 25, "over end", None), (5, 25, "spans", None), (20, 30, "after", None)]
    a = make(spark, TRACK, HR, laps)
    assert spans(edit.delete_range(a, 10 * S, 20 * S).laps) == [(0, 10), (5, 10), (20, 25), (5, 25), (20, 30)]
    assert spans(edit.insert_pause(a, 10 * S, 5 * S).laps) == [(0, 10), (5, 20), (17, 23), (20, 30), (5, 30), (25, 35)]
    assert spans(edit.remove_pause(a, 10 * S, 20 * S).laps) == [(0, 10), (5, 10), (10, 15), (5, 15), (10, 20)]
    back = edit.remove_pause(edit.insert_pause(a, 30 * S, 7 * S), 30 * S, 37 * S)
    assert seconds(back.points) == seconds(a.points)


def test_insert_update_delete_points(spark):
    a = make(spark, TRACK)
    new = spark.createDataFrame([("a", 0, 0, 0, 10 * S, 1.0, 1.0, None), ("a", 0, 0, 1, 99 * S, 2.0, 2.0, None)], POINTS)
    got = edit.insert_points(a, new).points.orderBy("seq").collect()
    assert [(r.time // S, r.latitude) for r in got][1:3] == [(10, 40.001), (10, 1.0)] and got[-1].latitude == 2.0
    assert edit.delete_point(a, 0).points.count() == 5
    moved = edit.update_point(a, 0, time=55 * S).points.orderBy("seq").collect()
    assert [r.time // S for r in moved] == [10, 20, 30, 40, 50, 55]


def test_trim_invalid(spark):
    points = [(0, 91.0, 0.0, None), (1, 0.0, 0.0, None), (2, float("nan"), 0.0, None), (3, 10.0, 10.0, -500.0), (4, 10.0, 10.0, 5.0)]
    a = make(spark, points, {"hr": [(1, 1), (3, 2), (9, 3)]}, [(0, 2, "x", None), (2, 9, "y", None)]).pipe(edit.trim_invalid)
    assert seconds(a.points, "elevation") == [(3, None), (4, 5.0)]
    assert seconds(a.samples) == [(3,)] and spans(a.laps) == [(3, 4)]
    gone = make(spark, points[:2], {"hr": [(1, 1)]}, [(0, 2, "x", None)]).pipe(edit.trim_invalid)
    assert gone.samples.count() == 1 and gone.laps.count() == 0


def test_downsample(spark):
    a = make(spark, [(0, 40.0, -105.0, None), (3, 40.001, -105.0, None), (5, 40.002, -105.0, None)], {"heart_rate": [(0, 140), (3, 142), (5, 145)]})
    got = resample.downsample_time(a, 4 * S)
    assert seconds(got.points) == [(0,), (5,)] and (5, 145.0) in seconds(got.samples, "value")
    far = resample.downsample_distance(a, 150.0)
    assert seconds(far.points) == [(0,), (5,)]


def test_resample_interpolates_and_extrapolates(spark):
    a = make(spark, [(0, 40.0, -105.0, 10.0), (10, 40.2, -105.0, None)], {"power": [(4, 100), (6, 120)], "heart_rate": [(0, 130), (10, 150)]})
    got = resample.resample(a, 5 * S)
    assert seconds(got.points, "elevation") == [(0, 10.0), (5, 10.0), (10, None)]
    power = seconds(got.samples.where("channel = 'power'"), "value")
    assert power == [(0, 60.0), (5, 110.0), (10, 120.0)]
    assert seconds(got.samples.where("channel = 'heart_rate'"), "value") == [(0, 130.0), (10, 150.0)]


def test_laps_by_distance(spark):
    d = lambda *v: {"distance": [(i * 300, x) for i, x in enumerate(v)]}
    got = resample.laps_by_distance(make(spark, TRACK, d(0, 800, 1800, 2300)), 1000.0).orderBy("lap_no").collect()
    assert [r.distance_m for r in got] == [1000, 1000, 300]
    reset = resample.laps_by_distance(make(spark, TRACK, d(0, 1100, 1500, 200, 800, 1400)), 1000.0).orderBy("lap_no").collect()
    assert [r.distance_m for r in reset] == [1000, 1000, 700]


def test_fill_gaps(spark):
    a = make(spark, [(0, 40.0, -105.0, 0.0), (1200, 40.4, -105.0, 40.0)])
    got = seconds(resample.fill_gaps(a, 300 * S).points, "elevation")
    assert got == [(0, 0.0), (300, 10.0), (600, 20.0), (900, 30.0), (1200, 40.0)]
    assert resample.fill_gaps(a, 300 * S, most=1).points.count() == 3


def test_distance_speed_and_smoothing(spark):
    a = make(spark, TRACK, HR)
    out = windows.recompute_distance_and_speed(a)
    speed = seconds(out.channel("speed"), "value")
    assert speed[0][1] == 0 and abs(speed[1][1] - 11.1195) < 1e-3
    smooth = seconds(windows.smooth_heart_rate(a, 3).samples, "value")
    assert [v for _, v in smooth] == [140.5, 141, 142, 143, 144, 144.5]
    total = aggregates.approximate_distance(a).first().distance_m
    assert abs(total - 5 * 111.19493) < 1e-2


def test_contiguous(spark):
    day = 86_400
    times = [*range(6), *(3 * day + i for i in range(6))]
    a = make(spark, [(t, 40.0 + t * 1e-9, -105.0, None) for t in times])
    assert [t for t, in seconds(windows.largest_contiguous(a).points)] == [3 * day + i for i in range(6)]


def test_merge_and_split(spark):
    laps = [(0, 10, "swim", "swimming"), (20, 30, "bike", "cycling"), (40, 50, "run", None)]
    a = make(spark, TRACK, HR, laps, sport="running")
    got = sets.split_by_sport(a)
    assert {r.activity_id: r.n for r in got.points.groupBy("activity_id").agg(F.count("*").alias("n")).collect()} == {"a/swimming": 2, "a/cycling": 2, "a/running": 2}
    assert got.laps.where("sport IS NOT NULL").count() == 0
    whole = sets.merge(got, F.lit("m"), F.col("activity_id"), preserve_sport_per_lap=True)
    assert whole.points.count() == 6 and sorted(r.sport for r in whole.laps.collect()) == ["cycling", "running", "swimming"]


def test_channel_sizes_of_the_whole_table(spark, sf_dir, tmp_path):
    """Late single samples and channels without any are found, a channel with one early and one late sample is not."""
    import duckdb

    from tests.conftest import rows_of
    from trailframe.plans.queries import ORACLES, QUERIES
    from trailframe.plans.tables import DAY_US, T0

    name = "val15_channel_sizes_whole"
    rows = [(1, 1, "view", 9), (2, 1, "click", 0), (3, 1, "click", 8), (4, 2, "click", 1), (5, 2, "click", 7)]
    given = spark.createDataFrame([(i, u, c, T0 + day * DAY_US) for i, u, c, day in rows], "event_id long, user_id long, event_type string, us long")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    made = {"ts": F.timestamp_micros("us"), "value": F.lit(1.0), "props": F.lit("{}")}
    given.select(*[made.get(f.name, F.col(f.name) if f.name in given.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, got[["activity_id", "code", "detail"]].values)) == [(1, "validation.channel.single_sample", "view"), (2, "validation.channel.empty", "view")]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_snapped_to_downsampled_points(spark, sf_dir):
    """Brute force over the points that a step of a day keeps, on the smallest tables."""
    from trailframe.plans.queries import QUERIES, TOL, a_
    from trailframe.plans.tables import DAY_US

    a, tracks = a_(spark, sf_dir), {}
    for r in a.points.orderBy("activity_id", "seq").collect():
        tracks.setdefault(r.activity_id, []).append(r.time)
    kept = {}
    for key, times in tracks.items():
        out = [times[0]]
        for t in times[1:]:
            if t - out[-1] >= DAY_US:
                out.append(t)
        kept[key] = {*out, times[-1]}
    want = {(r.activity_id, r.channel, r.seq, r.time) for r in a.samples.collect() if any(abs(t - r.time) <= TOL for t in kept[r.activity_id])}
    got = [tuple(r) for r in QUERIES["jn7_snapped_downsampled"](spark, sf_dir).select("activity_id", "channel", "seq", "time").collect()]
    assert len(got) == len(want) > 0 and set(got) == want


def test_csv_field_keeps_unquoted_and_null(spark, tmp_path):
    from trailframe.plans.queries import QUERIES

    rows = [(1, "1-URGENT"), (2, "PLAIN"), (3, None), (4, "4-NOT SPECIFIED"), (5, "NOT SPECIFIED")]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.field for r in QUERIES["fn10_csv_field"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == '"1""URGENT"' and got[2] == "PLAIN" and not got[3] and got[4] == '"4""NOT,SPECIFIED"' and got[5] == '"NOT,SPECIFIED"'


def test_validation_codes(spark):
    points = [(0, 95.0, 0.0, None), (0, 40.0, 190.0, float("nan")), (-5, 40.0, 0.0, None), (900, 40.0, 0.0, None)]
    samples = {"heart_rate": [(-9, 300), (950, 60)], "distance": [(0, 5), (1, 4), (2, -1)], "power": [(0, -1), (1, float("nan"))]}
    a = make(spark, points, samples, [(5, 5, "x", None), (2, 950, "y", None), (3, 4, "z", None)])
    codes = {r.code.removeprefix("validation.") for r in validate.validate(a).collect()}
    assert {"points.out_of_order", "points.duplicate_timestamp", "points.gap", "coordinate.invalid_latitude", "coordinate.invalid_longitude", "coordinate.invalid_elevation",
            "channel.heart_rate_out_of_range", "channel.negative_distance", "channel.distance_decrease", "channel.negative_power", "channel.non_finite_value",
            "channel.samples_before_track", "channel.samples_after_track", "laps.inverted_times", "laps.out_of_order", "laps.overlap", "laps.extends_after_points"} <= codes
    assert not validate.verdicts(validate.validate(a)).first().is_valid
    none = make(spark, [], {}, [(0, 1, "x", None), (2, 3, "y", None)])
    assert [r.code for r in validate.laps(none, by_position=True).collect()] == ["validation.laps.no_points"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.floats(-100, 100)), min_size=1, max_size=8))
def test_normalizing_twice_changes_nothing(spark, rows):
    a = make(spark, [(t, lat, 10.0, None) for t, lat in rows], {"x": [(t, 1) for t, _ in rows]}, [(0, 20, "l", None)])
    once = normalize.normalize(a)
    twice = normalize.normalize(once)
    for t in ("points", "samples", "laps"):
        order = "lap_no" if t == "laps" else "seq"  # only its order counts
        one, two = (getattr(x, t).orderBy(order).drop(order).collect() for x in (once, twice))
        assert one == two


def test_auto_fix(spark):
    a = make(spark, [(i * 60, 40 + i * 0.005, -105.0, None) for i in range(6)], HR)
    fixed = normalize.auto_fix(a, normalize.AutoFix(auto_lap_by_distance=True, auto_lap_distance_m=1000.0))
    assert fixed.laps.count() == 3
    codes = {r.code for r in normalize.auto_fix_diagnostics(a, fixed).collect()}
    assert {"autofix.distance.recomputed", "autofix.laps.auto_generated"} <= codes


def test_empty_tables(spark):
    a = make(spark)
    assert normalize.normalize(a).points.count() == 0
    assert resample.resample(a, S).points.count() == 0
    assert validate.validate(a).count() == 0
    assert joins.snapshots(a, a.points).count() == 0
    assert sets.split_by_sport(a).points.count() == 0


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(fn.infer_sport(F.lit("Evening-JOG with bike"))) == "running"
    assert one(fn.developer_channel(F.lit(" Form Power! "))) == "form_power" and one(fn.developer_channel(F.lit("9x"))) is None
    assert one(fn.version_text(F.lit(1), F.lit(2), F.lit(3), F.lit(4))) == "1.2+b3.4"
    assert one(fn.csv_field(F.lit('a"b,c'))) == '"a""b,c"'
    assert one(fn.exercise_label(F.lit(28))) == "Squat" and one(fn.exercise_label(F.lit(99))) is None
    assert one(fn.fixed_text(F.lit(1.23456), 2)) == "1.23"
    assert one(fn.node_path(F.lit("a.b"), F.lit(3), F.lit("d"))) == "a.b[3] (d)"


def test_sport_mappers(spark):
    try:
        mappers.register(lambda v: "hiking" if v == "alp" else None)
        df = spark.createDataFrame([("alp",), ("run",), ("?",)], "label string")
        assert [r[0] for r in df.select(mappers.sport_column(F.col("label"))).collect()] == ["hiking", "running", None]
        assert mappers.infer({"a": [None, 2]}) == "cycling"
    finally:
        mappers.clear()
