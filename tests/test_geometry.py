"""Geometry and path functions against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import geo, text
from skein.functions import series as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def path(*parts):
    """A path column; made when a session is there."""
    vertex = lambda v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("lon", "lat", "alt", "t"), strict=True)])
    return F.array(*[F.array(*map(vertex, p)) for p in parts])


# Two stretches along 20 degrees south, where a degree of longitude is 104.647 km: 0.2 degrees in 400 s at 4,000 ft, and after
# 0.8 degrees unseen in 2000 s, in which it climbs 8,000 ft, 0.4 degrees in 600 s at 12,000 ft.
T0 = 1_700_000_000.0
DEGREE = 104_647


@pytest.fixture(scope="module")
def gap(spark):
    return path([(30.0, -20, 4_000, T0), (30.2, -20, 4_000, T0 + 400)], [(31.0, -20, 12_000, T0 + 2_400), (31.4, -20, 12_000, T0 + 3_000)])


#: Half of the first stretch and half of the gap.
MIDDLE = geo.Polygon.of_box(30.1, -20.3, 30.6, -19.7)


def test_distances(spark):
    assert value(spark, geo.haversine(51.5072, -0.1275, 48.8566, 2.3522)) == pytest.approx(343_530, rel=0.002)
    # one degree of longitude on the equator, and a quarter of a meridian, on the ellipsoid
    assert value(spark, geo.geodesic(0, 0, 0, 1)) == pytest.approx(111_319.49, abs=0.5)
    assert value(spark, geo.geodesic(0, 0, 45, 0)) == pytest.approx(4_984_944.4, abs=120)
    assert value(spark, geo.geodesic(10, 10, 10, 10)) == 0


def test_gap_flight_measures(spark, gap):
    took = lambda **more: value(spark, S.duration_s(S.clip(gap, **more)))
    far = lambda **more: value(spark, S.length_m(S.clip(gap, **more)))
    assert took() == 3_000 and took(stitched=False) == 1_000
    assert far() == pytest.approx(1.4 * DEGREE, rel=1e-3) and value(spark, S.path_length_m(gap)) == pytest.approx(far())
    assert took(shape=MIDDLE) == pytest.approx(1_200, abs=0.1) and took(shape=MIDDLE, stitched=False) == pytest.approx(200, abs=0.1)
    assert took(low=8_000.0) == pytest.approx(1_600) and took(high=8_000.0, stitched=False) == pytest.approx(400)
    assert far(t_from=T0 + 1_400) == pytest.approx(0.8 * DEGREE, rel=1e-3)


def test_circle_and_polygon_clip_agree(spark, gap):
    circle = geo.Circle(30.7, -20.0, 55_000.0)
    east, north = S._metres_per_degree(-20.0)
    ring = tuple((30.7 + 55_000 / east * math.cos(a), -20 + 55_000 / north * math.sin(a)) for a in [2 * math.pi * k / 360 for k in range(361)])
    a, b = (value(spark, S.duration_s(S.clip(gap, s))) for s in (circle, geo.Polygon((ring,))))
    assert a == pytest.approx(b, rel=1e-3) and a > 0


def test_polygon_with_hole_and_vertex_hits(spark):
    shape = geo.Polygon((((0, 0), (10, 0), (10, 10), (0, 10)), ((4, 4), (6, 4), (6, 6), (4, 6))))
    line = path([(-5, 5, 0, 0), (15, 5, 0, 20)])
    assert value(spark, S.duration_s(S.clip(line, shape))) == pytest.approx(8)
    diagonal = path([(-5, -5, 0, 0), (15, 15, 0, 20)])
    assert value(spark, S.duration_s(S.clip(diagonal, shape))) == pytest.approx(8)
    assert value(spark, shape.contains(5, 5)) is False and value(spark, shape.contains(2, 5)) is True


def test_meets_and_stays(spark, gap):
    assert value(spark, S.meets(gap, MIDDLE)) and not value(spark, S.meets(gap, geo.Polygon.of_box(30.4, -20.3, 30.8, -19.7)))  # in the gap
    assert value(spark, S.stays_within(gap, geo.Polygon.of_box(29, -21, 32, -19))) and not value(spark, S.stays_within(gap, MIDDLE))
    assert value(spark, S.meets(gap, geo.from_geojson({"type": "LineString", "coordinates": [[31.1, -21], [31.1, -19]]})))
    assert not value(spark, S.meets(gap, geo.from_geojson({"type": "Point", "coordinates": [31.1, -20.5]})))
    u = geo.Polygon((((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)),))
    across = path([(1, 5, 0, 0), (9, 5, 0, 10)])
    assert not value(spark, S.stays_within(across, u)) and value(spark, S.meets(across, u))


def test_series(spark):
    series = F.array(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(v)).alias("v")) for t, v in ((10, 1), (20, 2), (30, 4))]))
    assert [value(spark, S.step_at(series, t)) for t in (5, 10, 25, 99)] == [None, 1, 2, 4]
    assert value(spark, S.step_at(series, 5, before_first=True)) == 1
    assert [value(spark, S.linear_at(series, t)) for t in (5, 15, 25, 99)] == [None, 1.5, 3, 4]
    assert [(r.a, r.b) for r in value(spark, S.linear_spans(series, 1.5, 3.0))] == [(15, 20), (20, 25)]
    assert [(r.a, r.b) for r in value(spark, S.spans(series, lambda v: v >= 2, F.lit(40.0)))] == [(20, 30), (30, 40)]
    thin = value(spark, S.thin(F.array(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(v)).alias("v")) for t, v in ((0, 0), (1, 10), (2, 29), (3, 31), (4, 60), (5, 61))])), 30.0))
    assert [x.t for x in thin[0]] == [0, 3, 5]
    assert value(spark, S.min_value(series)) == 1 and value(spark, S.max_value(series)) == 4


def test_cells_cover_every_cell_that_a_path_crosses(spark):
    cells = set(value(spark, S.cells_of(path([(0.1, 50.1, 0, 0), (3.9, 51.9, 0, 1)]), 0.5)))
    walk = {int((50.1 + 1.8 * k / 5000 + 90) // 0.5) * 100_000 + int((0.1 + 3.8 * k / 5000 + 180) // 0.5) for k in range(5001)}
    assert len(walk - cells) <= 2  # corners cut by less than the sampling step
    for shape in (geo.Circle(2.0, 51.0, 60_000), geo.Polygon.of_box(1, 50.5, 3, 51.5)):
        got = geo.cover(shape, 0.5)
        assert len(got) == len(set(got)) and value(spark, geo.cell(2.0, 51.0, 0.5)) in got


def test_areas_and_codes(spark):
    box = geo.Polygon.of_box(0, 0, 1, 1)
    assert box.area_km2() == pytest.approx(12_391, rel=0.01)
    assert value(spark, geo.edges_area_km2(box.column())) == pytest.approx(box.area_km2()) and value(spark, geo.flat_area_km2(box.column())) == pytest.approx(box.area_km2(), rel=0.01)
    centre = value(spark, geo.edges_centroid(box.column()))
    assert (centre.lon, centre.lat) == pytest.approx((0.5, 0.5))
    assert value(spark, geo.edge_distance(box.column(), 2.0, 0.5)) == pytest.approx(111_320 * math.cos(math.radians(0.5)), rel=1e-6)
    assert value(spark, geo.within_metres(box.column(), 1.05, 0.5, 6_000)) and not value(spark, geo.within_metres(box.column(), 1.05, 0.5, 5_000))
    assert [value(spark, geo.compass(h)) for h in (0, 22.5, 359, 180, 101.25)] == ["N", "NNE", "N", "S", "ESE"]
    assert [value(spark, text.limit_unit(F.lit(k))) for k in (0, 1, 6, 9)] == ["m", "ft", "fl", None]
    assert [value(spark, text.limit_reference(F.lit(k))) for k in (0, 2, 9)] == ["gnd", "std", "msl"]
    assert value(spark, text.tile_name(F.lit(-0.5), F.lit(-120.2))) == "S01W121" and value(spark, text.tile_name(F.lit(51.5), F.lit(0.2))) == "N51E000"
    assert str(value(spark, text.release_date(F.lit("v2025.04.01-planes-readsb-prod-0")))) == "2025-04-01"
    assert text.is_split_part("x.tar.aa") and not text.is_split_part("x.tar.gz")


def test_identifiers(spark):
    assert value(spark, text.norm(F.lit("g-abcd"))) == "GABCD" and text.norm_value(" g-ab ") == "GAB"
    icao, start = text.parse_flight_id("AABBCC:2025-04-01T10:00:00Z")
    assert icao == "aabbcc" and start.isoformat() == "2025-04-01T10:00:00+00:00"
    with pytest.raises(ValueError):
        text.parse_flight_id("nope")
    words = text.tokens(F.lit("London Heathrow"), F.lit("EGLL"))
    assert value(spark, text.matches_prefixes(words, "heath eg")) and not value(spark, text.matches_prefixes(words, "thames")) and not value(spark, text.matches_prefixes(words, "--"))


def test_points_on_a_border_are_not_contained(spark):
    """Whichever edge they lie on, and for slanting edges and holes too."""
    box = geo.Polygon.of_box(1.0, 50.0, 3.0, 52.0)
    points = [(1.0, 51.0), (3.0, 51.0), (2.0, 50.0), (2.0, 52.0), (1.0, 50.0), (3.0, 52.0)]
    assert [value(spark, box.contains(*p)) for p in points] == [False] * 6 and value(spark, box.contains(1.0000001, 50.0000001))
    slanting = geo.Polygon((((0.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)), ((0.5, 1.0), (0.75, 1.0), (0.75, 1.5), (0.5, 1.5), (0.5, 1.0))))
    assert [value(spark, slanting.contains(*p)) for p in ((1.0, 1.0), (0.5, 1.25), (0.75, 1.25), (0.25, 1.0))] == [False, False, False, True]


def test_reports_on_a_border_are_in_no_airspace(spark):
    from skein.operators import lookups

    areas = spark.createDataFrame([("a", 1.0, 50.0, 3.0, 52.0)], "id string, min_lon double, min_lat double, max_lon double, max_lat double")
    reports = spark.createDataFrame([(1, 1.0, 51.0), (2, 2.0, 50.0), (3, 3.0, 51.0), (4, 2.0, 52.0), (5, 2.0, 51.0)], "event_id long, lon double, lat double")
    assert [r.event_id for r in lookups.containing(reports, areas).collect()] == [5]


def test_a_code_does_not_last_across_a_gap_unless_stitched(spark):
    series = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(v).alias("v")) for t, v in part]) for part in ([(0, "7700"), (10, "7700")], [(100, "1200"), (110, "1200")])])
    code = lambda v: v == "7700"
    assert [(r.a, r.b) for r in value(spark, S.spans(series, code, stitched=False))] == [(0, 10)]
    assert [(r.a, r.b) for r in value(spark, S.spans(series, code))] == [(0, 10), (10, 100)]


def test_geodesic_computed_once_inside_functions(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(51.5, -0.1, 40.7, -74.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 180.0), (-33.9, 151.2, 51.5, 0.0), (90.0, 0.0, -90.0, 0.0)], "a double, b double, c double, d double")
    args = [F.col(c) for c in "abcd"]
    plain, once = geo.geodesic(*args), geo.geodesic(*args, geo.once)
    assert rows.where(~plain.eqNullSafe(once)).count() == 0
    # the expression names its arguments a few times, not hundreds of times
    said = rows.select(once.alias("m"))._jdf.queryExecution().analyzed().toString()
    assert said.count("atan") <= 2


def test_arrays_are_computed_once_not_for_each_span(spark):
    draw = F.array(F.struct(F.lit(0.0).alias("a"), F.rand(1).alias("b")))  # other values each time that it is computed
    spans = F.array(*[F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))] * 5)
    shared = spark.range(1).select(S.overlap(spans, draw).alias("x")).first().x
    assert len(shared) == 5 and len({s.b for s in shared}) == 1
    piece = F.struct(*[F.lit(float(k)).alias(f"{c}{k}") for k in (0, 1) for c in ("t", "lon", "lat", "z")])
    cut = spark.range(1).select(S.clip_to_spans(F.array(*[piece] * 5), draw).alias("x")).first().x
    assert len(cut) == 5 and len({p.t1 for p in cut}) == 1
    pairs = spark.range(1).select(S._pairs(F.array(F.rand(1), F.rand(2), F.rand(3)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("x")).first().x
    assert pairs[0].y == pairs[1].x
