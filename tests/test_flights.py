"""Flight building on literal reports and on the synthetic tables."""

import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from skein.operators import flights as fl
from skein.operators import simplify
from skein.plans import daily

SCHEMA = "icao24 string, icao_type string, t double, lat double, lon double, alt_baro double, track double, gs double, vr double, ias double, squawk string, callsign string, emitter_category string, new_leg boolean, seq int, batch_date date"


def report(t, lon=-0.1, alt=10000.0, lat=51.5, new_leg=False, squawk=None, callsign=None, icao="aabbcc", track=None, gs=None):
    return (icao, None, float(t), lat, lon, alt, track, gs, None, None, squawk, callsign, "A3", new_leg, 0, None)


def frame(spark, rows):
    return spark.createDataFrame([(*r[:14], k, r[15]) for k, r in enumerate(rows)], SCHEMA)


def leg_ids(spark, rows, **more):
    return [r.leg for r in fl.legs(frame(spark, rows), **more).orderBy("t").collect()]


def test_pair_rules(spark):
    assert leg_ids(spark, [report(1000), report(1060), report(4700, 0.5, 35000.0), report(4760, 0.5, 35000.0)]) == [1, 1, 1, 1]
    assert leg_ids(spark, [report(1000), report(1060), report(10588), report(10648)]) == [1, 1, 2, 2]
    assert leg_ids(spark, [report(1000), report(1061, lon=-74.0, lat=40.7)]) == [1, 1 + 1]
    assert leg_ids(spark, [report(0, alt=None), report(601, alt=None)]) == [1, 2] and leg_ids(spark, [report(0, alt=None), report(600, alt=None)]) == [1, 1]
    assert leg_ids(spark, [report(0), report(30, new_leg=True)]) == [1, 2] and leg_ids(spark, [report(0), report(90, lon=0.0, new_leg=True)]) == [1, 1]
    assert leg_ids(spark, [report(0), report(30, alt=None), report(60, alt=None, new_leg=True)]) == [1, 1, 2]


def test_stretches_do_not_matter(spark):
    rng = random.Random(4)
    rows = [report(t := rng.uniform(0, 40_000), lon=rng.uniform(-0.1, 0.1), alt=rng.choice([None, 3000.0]), new_leg=rng.random() < 0.1, icao=rng.choice(["a", "b"])) for _ in range(300)]
    df = frame(spark, rows)
    by = lambda s: {(r.seq, r.leg) for r in fl.legs(df, bucket_s=s).collect()}
    assert by(1e9) == by(500.0) == by(3_000.0)


def test_legs_of_first_reports_read_the_reports_once(spark, tmp_path):
    rng = random.Random(5)
    rows = [report(rng.choice(range(0, 200_000, 500)), lon=rng.uniform(-0.1, 0.1), alt=rng.choice([None, 3000.0]), new_leg=rng.random() < 0.1, icao=rng.choice(["a", "b"])) for _ in range(600)]
    df = frame(spark, rows)
    by = lambda legs: {(r.seq, r.leg) for r in legs.collect()}
    want = by(fl.legs(fl.deduplicated(df)))
    assert by(fl.legs(df, first_only=True)) == by(fl.legs(df, bucket_s=700.0, first_only=True)) == want and len(want) < 600
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    fl.capped(fl.legs(df.mapInArrow(counted, df.schema), first_only=True)).count()
    assert read.value == 600


def test_duration_cap(spark):
    rows = [report(k * 3600.0, lon=-0.1 + 1.0 * k) for k in range(60)]
    parts = [r.part for r in fl.capped(fl.legs(frame(spark, rows))).orderBy("t").collect()]
    assert parts == [0] * 25 + [1] * 25 + [2] * 10
    assert {r.part for r in fl.capped(fl.legs(frame(spark, rows[:25]))).collect()} == {0}


def test_merge_prefers_staged_and_new_type(spark):
    old = frame(spark, [report(1, squawk="1111"), report(2)]).withColumn("icao_type", F.lit("OLD"))
    new = frame(spark, [report(1, squawk="2222"), report(3)]).withColumn("icao_type", F.lit("NEW"))
    rows = fl.merge_reports(old, new).orderBy("t").collect()
    assert [(r.t, r.squawk, r.icao_type) for r in rows] == [(1, "1111", "NEW"), (2, None, "NEW"), (3, None, "NEW")]
    alone = fl.merge_reports(old, new.limit(0)).collect()
    assert {r.icao_type for r in alone} == {"OLD"} and len(alone) == 2


def test_open_legs(spark):
    end = daily.cutoff(date(1970, 1, 2))
    for back, alt, kept in ((3600, 5000.0, True), (3601, 5000.0, False), (600, None, True), (601, None, False)):
        rows = [report(end - back - 30, alt=alt), report(end - back, alt=alt)]
        assert (fl.open_legs(fl.legs(frame(spark, rows)), end).count() == 2) is kept
    assert fl.open_legs(fl.legs(frame(spark, [report(end - 5)])), end).count() == 0  # one report is no leg


def test_outliers_are_judged_against_the_last_kept():
    t, lat = np.arange(6.0) * 10, np.array([0, 0, 9, 9, 0, 0.0])
    assert simplify.plausible(t, lat, np.zeros(6), np.zeros(6)).tolist() == [True, True, False, False, True, True]
    assert simplify.plausible(np.array([0, 0.0]), np.array([0, 50.0]), np.zeros(2), np.zeros(2)).all()
    assert simplify.plausible(np.array([0, 10.0, 20]), np.zeros(3), np.zeros(3), np.array([0, 3001.0, 0])).tolist() == [True, False, True]


def by_hand(t, lat, lon, alt):
    """The sequential rule, one report after the other."""
    keep, last = [True], 0
    for k in range(1, len(t)):
        gap = t[k] - t[last]
        far = float(simplify.distances(lat[last], lon[last], lat[k], lon[k]))
        ok = gap <= 0 or (far / gap <= 500 and abs(alt[k] - alt[last]) / gap <= 300)
        keep.append(ok)
        last = k if ok else last
    return keep


def test_outliers_against_the_sequential_rule():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 60
        t = np.cumsum(rng.choice([0, 1, 5, 20], n)).astype(float)
        lat, lon, alt = rng.normal(0, 0.02, n).cumsum() / 10, rng.normal(0, 0.05, n), rng.normal(3000, 500, n)
        assert simplify.plausible(t, lat, lon, alt).tolist() == by_hand(t, lat, lon, alt)


def one_by_one(kept, a, b, tolerance, off):
    """The rule segment by segment: keep the first point that is furthest off, while it is too far off."""
    if b - a > 1:
        far = off(np.full(b - a - 1, a), np.full(b - a - 1, b), np.arange(a + 1, b))
        k = int(np.argmax(far))
        if far[k] > tolerance:
            kept.add(a + 1 + k)
            one_by_one(kept, a, a + 1 + k, tolerance, off)
            one_by_one(kept, a + 1 + k, b, tolerance, off)


def test_time_ratio_keeps_every_report_within_the_tolerance():
    rng = np.random.default_rng(1)
    for _ in range(20):
        first = np.array([0, 30, 31, 33])  # ranges of 30, 1, 2 and 80 points
        n = 113
        t = np.cumsum(rng.uniform(1, 10, n))
        lat, lon, alt = np.cumsum(rng.normal(0.001, 0.0005, n)), np.cumsum(rng.normal(0.001, 0.0005, n)), np.round(np.cumsum(rng.normal(0, 60, n)), -2) + 5000
        alt[rng.random(n) < 0.1] = np.nan
        ranges = list(zip(first, np.append(first[1:], n) - 1, strict=True))
        for tolerance, deviation in ((50, simplify.path_deviation(t, lat, lon)), (100, simplify.value_deviation(t, alt)), (5, simplify.value_deviation(t, alt % 360, True))):
            kept = simplify._ends(first, n)
            simplify.time_ratio(kept, first, tolerance, deviation)
            want = {int(p) for r in ranges for p in r}
            for a, b in ranges:
                one_by_one(want, a, b, tolerance, deviation)
            assert set(np.flatnonzero(kept).tolist()) == want and len(want) < n
            for a, b in ranges:
                ends = [p for p in sorted(want) if a <= p <= b]
                for x, y in zip(ends, ends[1:], strict=False):
                    k = np.arange(x + 1, y)
                    assert y - x < 2 or deviation(np.full(len(k), x), np.full(len(k), y), k).max() <= tolerance
        code = np.repeat([1, 2], [40, n - 40])
        both = np.flatnonzero(simplify.kept_vertices(t, lat, lon, alt, code, first))
        assert {0, 29, 30, 31, 32, 33, 40, n - 1} <= set(both.tolist())


def leg(t, squawk=None, track=None, gs=None, alt=None):
    return [{"t": float(x), "lat": 0.001 * k * k, "lon": 0.0, "alt_baro": 1000.0 if alt is None else alt[k], "track": None if track is None else track[k], "gs": None if gs is None else gs[k], "vr": None, "ias": None, "squawk": None if squawk is None else squawk[k]} for k, x in enumerate(t)]


def test_series_and_runs():
    t = np.arange(5.0) * 10
    built = simplify.build(leg(t, ["1", "1", "2", "2", "2"], [350.0, 355, 0, 5, 10], [None, 1, 2, 3, None]), simplify=False)
    assert built["path_tracks"] == [[{"t": 0.0, "v": 350}, {"t": 40.0, "v": 10}]] and built["path_gs"] == [[]]
    assert built["squawk_seq"] == [[{"t": 0.0, "v": "1"}, {"t": 20.0, "v": "2"}, {"t": 40.0, "v": "2"}]]
    assert simplify.build(leg(t, [None, "1", None, "2", "1"]), simplify=False)["squawk_seq"] == [[{"t": 10.0, "v": "1"}, {"t": 30.0, "v": "2"}, {"t": 40.0, "v": "1"}]]
    assert simplify.build(leg(t), simplify=False)["squawk_seq"] == [[]]
    assert simplify.interpolated(t, np.array([350.0, np.nan, np.nan, np.nan, 30]), circular=True).tolist() == [350, 0, 10, 20, 30]
    assert np.isnan(simplify.interpolated(t, np.array([np.nan, 1, np.nan, 3, np.nan]))).tolist() == [True, False, False, False, True]
    two = np.array([0, 3])
    assert np.isnan(simplify.interpolated(t, np.array([1.0, np.nan, np.nan, np.nan, 2]), two)).tolist() == [False, True, True, True, False]


def test_many_legs_like_each_alone():
    rng = np.random.default_rng(8)
    legs = []
    for n in (0, 1, 2, 3, 40, 200, 7, 0, 90):
        t = np.cumsum(rng.choice([1.0, 5.0, 10.0, 70.0], n, p=[0.4, 0.3, 0.2, 0.1]))
        maybe = lambda v: [None if rng.random() < 0.3 else x for x in v]  # noqa: B023, E731
        points = leg(t, maybe(rng.choice(["1", "2"], n)), maybe(rng.uniform(0, 360, n)), maybe(rng.uniform(100, 200, n)), rng.normal(5000, 300, n).tolist())
        for k, p in enumerate(points):
            p["lat"] = 0.002 * k + (5.0 if rng.random() < 0.05 else 0.0)
        legs.append(points)
    import pyarrow as pa

    rows = pa.array([*legs, None], pa.list_(simplify.POINT))
    for clean in (True, False):
        for simple in (True, False):
            whole = simplify.build_all(rows.slice(2), clean, simple)
            for k, points in enumerate(legs[2:]):
                assert {c: v[k].as_py() for c, v in whole.items()} == simplify.build(points, clean, simple)
            assert whole["path"][len(legs) - 2].as_py() == [] and whole["dropped"][len(legs) - 2].as_py() == 0
    assert simplify.build_all(rows.slice(0, 0))["path"].to_pylist() == []
    batch = pa.RecordBatch.from_arrays([rows], names=["points"])
    assert [b.num_rows for b in simplify.shares(batch, "points", 50)] == [5, 1, 2, 1, 1]


def test_thinned_series():
    import pyarrow as pa

    flat = [{"t": float(k), "v": float(v)} for k, v in enumerate([0, 10, 20, 500, 40, 50])]
    series = pa.array([[flat, [], flat[:1]], None, [], [[]]], pa.list_(pa.list_(pa.struct([("t", pa.float64()), ("v", pa.float64())]))))
    out = simplify.thinned(series, lambda v: np.full(len(v), 100.0)).to_pylist()
    assert [[[x["t"] for x in p] for p in r] if r is not None else None for r in out] == [[[0, 2, 3, 4, 5], [0]], None, [], []]


def test_long_legs_are_cut_by_links(spark):
    """Against the greedy rule, for legs of ties, gaps and single reports; results do not depend on the order of rows."""
    rng = random.Random(5)
    rows, want = [], {}
    for icao in ("a", "b", "c", "d"):
        t, times = 0.0, []
        for _ in range({"a": 300, "b": 300, "c": 2, "d": 40}[icao]):
            t += rng.choice([0.0, 1.0, 50.0, 100.0] if icao != "d" else [40.0, 900.0])
            times.append(t)
        start, part = times[0], 0
        for x in times:
            if x - start > 1000.0:
                start, part = x, part + 1
            want[icao, x] = part
        rows += [(icao, k, x) for k, x in enumerate(times)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, 1, x, k) for i, k, x in rows], "icao24 string, leg long, t double, seq int").repartition(5)
    out = fl.capped(df, 1000.0).collect()
    assert len(out) == len(rows) and {(r.icao24, r.t): r.part for r in out} == want and max(want.values()) > 8
    assert out[0].__fields__ == ["icao24", "leg", "t", "seq", "part"]


def test_flight_row(spark):
    rows = [report(0, 0.0, callsign="BAW1", squawk="1000"), report(30, 0.01, callsign="BAW2", squawk="1000"), report(60, 0.02, callsign="BAW2", squawk="2000"), report(90, 0.03), report(100, 0.03, alt=None), report(400, 0.1), report(430, 0.11), report(800, 0.2)]
    (row,) = fl.build_flights(fl.capped(fl.legs(frame(spark, rows)))).collect()
    assert row.callsign == "BAW2" and row.raw_point_count == 8 and len(row.path) == 2  # a lone report after a gap is no stretch
    assert (row.start_t, row.end_t) == (0, 430) and row.squawk_codes == ["1000", "2000"] and row.emitter_category == "A3"
    assert [x.v for x in row.squawk_seq[0]] == ["1000", "2000", "2000"] and row.dropped == 0
    assert str(row.start_week) == "1969-12-29" and row.min_alt == row.max_alt == 10000.0


def test_native_paths_equal_the_function_without_cleaning(spark):
    from skein.plans import catalog

    rows = catalog.legs(spark, "/root/testdata/sf0.001")
    a = fl.build_flights(rows, clean=False, simplified=False)
    grouped = fl._simplified
    native = {(r.icao24, r.start_t): (len(r.path), sum(map(len, r.path)), r.squawk_codes) for r in a.collect()}
    original, fl.native_paths = fl.native_paths, lambda named: grouped(named, False, False)
    try:
        b = fl.build_flights(rows, clean=False, simplified=False)
        python = {(r.icao24, r.start_t): (len(r.path), sum(map(len, r.path)), r.squawk_codes) for r in b.collect()}
    finally:
        fl.native_paths = original
    assert native == python and native


def test_too_few_airborne_reports_make_no_flight(spark):
    assert fl.build_flights(fl.legs(frame(spark, [report(0), report(10, alt=None)]))).count() == 0
    assert fl.build_flights(fl.legs(frame(spark, []))).count() == 0


def test_a_leg_is_named_and_filtered_without_making_its_points_again(spark):
    rows = [report(0, callsign="B"), report(10, callsign="A"), report(20, callsign="A"), report(30, callsign="B"), report(40, alt=None)]
    built = fl.build_flights(fl.legs(frame(spark, rows)), clean=False, simplified=False)
    assert [(r.callsign, r.raw_point_count) for r in built.collect()] == [("B", 5)]
    said = built._jdf.queryExecution().optimizedPlan().toString()
    assert said.count(".callsign") == said.count(".emitter_category") == 1 and "Filter (size(transform(" not in said
