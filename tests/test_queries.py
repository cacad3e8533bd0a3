"""Predicates and pages on literal flights; every registered query against its SQL on the smallest tables."""

import os
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from skein.functions import geo
from skein.operators import flights as fl
from skein.operators import lookups, profiles, rollups
from skein.plans import catalog, predicates as P
from skein.plans.engine import Engine, Request, read_token, token

SF = "/root/testdata/sf0.001"
T = 1_750_000_000.0  # 2025-06-15 15:06:40 UTC, a Sunday
STRIP = geo.Polygon.of_box(10.0, -1.0, 12.0, 1.0)  # two degrees along the equator


def seq(*points, kind=float):
    return [[(float(t), kind(v)) for t, v in points]]


#: east: along the equator from 9 to 13 degrees, one degree in 1000 s (111,319 m), so inside STRIP from T + 1000 to T + 3000;
#:   climbs from 20,000 to 24,000 ft; code 4321 until T + 2000, then 0707.
#: north: up the meridian of 11 from the equator to 4 degrees in 2000 s, level at 9,000 ft; leaves STRIP at T + 500.
#: far: on the other side of the world. broken: two stretches of 200 s with an hour between, 0.1 degrees each (11,132 m).
FLIGHTS = [
    ("e00001", "EASTER1", "A20N", "A3", [[(9.0, 0.0, 20_000, T), (13.0, 0.0, 24_000, T + 4000)]], seq((T, "4321"), (T + 2000, "0707"), (T + 4000, "0707"), kind=str), seq((T, 20_000), (T + 4000, 24_000))),
    ("e00002", "NORTH22", "AT76", "A2", [[(11.0, 0.0, 9_000, T + 100), (11.0, 4.0, 9_000, T + 2100)]], [], seq((T + 100, 8_000), (T + 2100, 5_000))),
    ("e00003", "FARAWAY", "A20N", "A3", [[(-150.0, -40.0, 30_000, T - 9000), (-149.0, -40.0, 30_000, T - 8000)]], seq((T - 9000, "2000"), (T - 8000, "2000"), kind=str), seq((T - 9000, 30_000), (T - 8000, 30_000))),
    ("e00004", "BROKEN4", "P28A", "A1", [[(50.0, 0.0, 2_000, T), (50.1, 0.0, 2_000, T + 200)], [(50.5, 0.0, 6_000, T + 3800), (50.6, 0.0, 6_000, T + 4000)]], [], None),
]
SCHEMA = "icao24 string, callsign string, icao_type string, emitter_category string, path array<array<struct<lon:double,lat:double,alt:double,t:double>>>, squawk_seq array<array<struct<t:double,v:string>>>, path_agl_ft array<array<struct<t:double,v:double>>>"


@pytest.fixture(scope="module")
def flights(spark):
    rows = [(*f[:4], [[tuple(map(float, v)) for v in p] for p in f[4]], *f[5:]) for f in FLIGHTS]
    return fl.measured(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.fixture(scope="module")
def airframes(spark):
    return spark.createDataFrame([("e00001", "X-OWNED", "A20N", 1, "OWN MODEL 20", 2019, "Own Lines")], "icao24 string, registration string, icao_type string, flags int, model string, year int, operator string")


def found(flights, match, airframes=None):
    return {r.icao24 for r in Engine(flights, airframes).select(match).collect()}


EAST, NORTH, FAR, BROKEN = "e00001", "e00002", "e00003", "e00004"
START = geo.Circle(9.0, 0.0, 20_000)
at = lambda s: datetime.fromtimestamp(T + s, timezone.utc).replace(tzinfo=None)
CASES = [
    # time inside: 2000 s of EAST and 500 s of NORTH; the degree of latitude is 110,574 m
    (P.Trajectory(STRIP, dwell_s=P.Range(1990, 2010)), EAST, True),
    (P.Trajectory(STRIP, dwell_s=P.Range(2010)), EAST, False),
    (P.Trajectory(STRIP, dwell_s=P.Range(490, 510)), NORTH, True),
    (P.Trajectory(STRIP, distance_m=P.Range(222_000, 223_000)), EAST, True),
    (P.Trajectory(STRIP, distance_m=P.Range(223_500)), EAST, False),
    (P.Trajectory(STRIP, distance_m=P.Range(110_000, 111_000)), NORTH, True),
    (P.Trajectory(STRIP), FAR, False),
    (P.Trajectory(STRIP, mode="within"), EAST, False),
    (P.Trajectory(geo.Polygon.of_box(8.0, -1.0, 14.0, 1.0), mode="within"), EAST, True),
    # windows: EAST is inside from T + 1000 on
    (P.Trajectory(STRIP, time_from=at(0), time_to=at(900)), EAST, False),
    (P.Trajectory(STRIP, time_from=at(0), time_to=at(1100)), EAST, True),
    (P.Trajectory(time_from=at(3000), time_to=at(3500), dwell_s=P.Range(400, 600)), EAST, True),
    # bands: EAST is between 21,000 and 23,000 ft inside, and at 22,000 to 23,000 ft for half of it
    (P.Trajectory(STRIP, altitude=P.Range(225, 227), unit="fl"), EAST, True),
    (P.Trajectory(STRIP, altitude=P.Range(235), unit="fl"), EAST, False),
    (P.Trajectory(STRIP, altitude=P.Range(220, 230), unit="fl", dwell_s=P.Range(990, 1010)), EAST, True),
    (P.Trajectory(altitude=P.Range(8_900, 9_100), mode="within"), NORTH, True),
    # heights: EAST as its altitude, NORTH falls from 8,000 to 7,250 ft inside, to 5,000 at its end
    (P.Trajectory(STRIP, agl_ft=P.Range(22_500)), EAST, True),
    (P.Trajectory(STRIP, agl_ft=P.Range(23_500)), EAST, False),
    (P.Trajectory(STRIP, agl_ft=P.Range(22_000), dwell_s=P.Range(950, 1050)), EAST, True),
    (P.Trajectory(STRIP, mode="within", agl_ft=P.Range(4_000)), NORTH, False),  # it leaves the strip
    (P.Trajectory(mode="within", agl_ft=P.Range(4_900)), NORTH, True),
    (P.Trajectory(mode="within", agl_ft=P.Range(5_100)), NORTH, False),
    (P.Trajectory(agl_ft=P.Range(5_500, 6_000)), NORTH, True),
    (P.Trajectory(agl_ft=P.Range(0, 90_000)), BROKEN, False),  # no heights are known
    # codes: inside, 4321 for 1000 s and 0707 for 1000 s; 0707 not before T + 2000, which is at 11 degrees
    (P.Trajectory(squawk_codes=("0707",)), EAST, True),
    (P.Trajectory(STRIP, squawk_codes=("4321",), dwell_s=P.Range(990, 1010)), EAST, True),
    (P.Trajectory(geo.Polygon.of_box(9.5, -1.0, 10.5, 1.0), squawk_codes=("0707",)), EAST, False),
    (P.Trajectory(STRIP, agl_ft=P.Range(22_500), squawk_codes=("4321",)), EAST, False),
    (P.Trajectory(STRIP, squawk_codes=("2000",)), FAR, False),
    # the gap of BROKEN counts where its whole flight is measured
    (P.Trajectory(dwell_s=P.Range(3990, 4010)), BROKEN, True),
    (P.Trajectory(distance_m=P.Range(66_000, 67_500)), BROKEN, True),
    (P.Trajectory(geo.Circle(50.05, 0.0, 30_000)), BROKEN, True),
    (P.EndpointWithin(START, "start"), EAST, True),
    (P.EndpointWithin(START, "both"), EAST, False),
    (P.EndpointWithin(START, "either"), FAR, False),
    (P.And(()), FAR, True),
    (P.Or(()), FAR, False),
    (~P.CallsignPrefix("broken-4"), BROKEN, False),
]


@pytest.mark.parametrize(("match", "icao24", "expected"), CASES)
def test_predicates(flights, match, icao24, expected):
    assert (icao24 in found(flights, match)) is expected


def test_registration_and_json(flights, airframes):
    assert found(flights, {"registration_prefix": "xow"}, airframes) == {EAST}
    tree = {"and": [{"icao_type": ["a-20n"]}, {"not": {"callsign_prefix": "FAR"}}, {"trajectory_intersects": {"geometry": {"type": "Polygon", "coordinates": [list(map(list, STRIP.rings[0]))]}, "altitude": {"min": 210, "unit": "fl"}}}]}
    assert found(flights, tree) == {EAST}
    form = {"mode": "any", "items": [{"kind": "callsign_prefix", "value": ""}, {"items": []}, {"kind": "duration_min", "value": {"min": 66, "max": 67}, "negate": False}]}
    assert found(flights, P.from_filter_tree(form)) == {EAST, BROKEN}
    assert P.from_filter_tree({"items": []}) is None
    for bad in ({"trajectory_intersects": {}}, {"nope": 1}, {"icao24": []}, {"trajectory_intersects": {"geometry": {"type": "Circle", "coordinates": [0, 0], "radius": 0}}}, {"trajectory_intersects": {"geometry": {"type": "Polygon", "coordinates": [[[-60, -60], [60, -60], [60, 60], [-60, 60], [-60, -60]]]}}}):
        with pytest.raises(ValueError):
            P.from_dict(bad)
    assert P.strict({"trajectory_intersects": {"altitude": {"min": 5, "max": 1}}}) and not P.strict({"icao24": ["a"]})
    assert P.days(date(2025, 6, 15), date(2025, 6, 15))[1] == datetime(2025, 6, 16, tzinfo=timezone.utc)


def test_pages(flights):
    engine = Engine(flights)
    pages = list(engine.pages(Request(P.And(()), limit=1)))
    assert [r.icao24 for p in pages for r in p.rows] == [NORTH, BROKEN, EAST, FAR] and pages[-1].cursor is None
    assert "path" not in engine.page(Request(P.And(()), include_path=False)).rows[0]
    old = engine.page(Request(P.And(()), end_date=datetime(2025, 6, 23)))
    assert not old.rows and old.cursor  # an empty window goes on at its floor
    assert [r.icao24 for r in engine.page(Request(P.And(()), cursor=old.cursor)).rows][0] == NORTH
    at = datetime(2025, 4, 1, 10, 0, 0, 123456, timezone.utc)
    assert read_token(token(at, "x")) == (at, "x")
    for bad in (dict(window_days=8), dict(limit=0), dict(start_from=datetime(2025, 1, 2), end_date=datetime(2025, 1, 1))):
        with pytest.raises(ValueError):
            Request(P.And(()), **bad)
    row = engine.flight("E00001:2025-06-15T15:06:40Z").first()
    assert row.icao24 == EAST and engine.data_range().first().min_date == date(2025, 6, 15)


def test_profiles(flights, spark):
    rows = profiles.segment_table(flights.where(F.col("icao24") == EAST)).collect()
    assert len(rows) == 1 and rows[0].squawk == "4321" and rows[0].agl0 == 20_000 and rows[0].alt_mid == 22_000
    near = profiles.closest_approach(flights.where(F.col("icao24") == BROKEN), 50.05, 0.0).first()
    assert near.distance_m == pytest.approx(0, abs=1) and near.t == pytest.approx(T + 100)
    assert {r.ground for r in profiles.height_profile(flights.where(F.col("icao24") == BROKEN)).collect()} == {None}
    airports = spark.createDataFrame([("own", "OWNA", "Own Field")], "id string, ident string, name string")
    routed = lookups.with_routes(flights.withColumn("start_airport_ident", F.lit("own")).withColumn("end_airport_ident", F.lit("none")), airports)
    card = {r.icao24: r for r in profiles.cards(routed).collect()}[EAST]
    assert card["from"] == "OWNA" and card["to"] is None and card.track_nm >= card.straight_nm > 100 and card.duration_s == 4000


def test_lookups(spark):
    points = [("a1", "airport", "London Heathrow", "EGLL", "LHR", 3, -0.45, 51.47), ("a2", "airport", "London Closed", "EGXX", None, 8, 0.0, 51.0), ("a3", "airport", "Lhrland", "LHR", None, 3, 1.0, 50.0), ("n1", "navaid", "London VOR", "LON", None, 4, -0.46, 51.48), ("r1", "reporting_point", "London bridge", None, None, None, 0.0, 51.5), ("a4", "airport", "No type London", None, None, None, 0.1, 51.5)]
    way = spark.createDataFrame(points, "id string, kind string, name string, ident string, iata_code string, type_code int, lon double, lat double")
    square = lambda x, y, h: [[[[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h], [x - h, y - h]]]]
    areas = spark.createDataFrame([("s1", "LONDON CTR", 4, 0.0, square(-0.45, 51.47, 0.2)), ("s2", "HEATHROW ATZ", 13, 500.0, square(-0.45, 51.47, 0.05)), ("s3", "LONDON TMA", 7, None, square(-0.45, 51.47, 1.0)), ("s4", "FAR", 4, 1.0, square(9, 9, 0.1))], "id string, name string, type_code int, lower_value double, rings array<array<array<array<double>>>>")
    engine = Engine(way.limit(0), waypoints=way, airspaces=areas)
    assert [r.id for r in engine.search_waypoints("lond").collect()] == ["a1", "a4", "n1", "r1", "s1", "s3"]
    assert [r.id for r in engine.search_waypoints("lond", ["navaid"]).collect()] == ["n1"] and engine.search_waypoints("-").count() == 0
    assert engine.airport("lhr").first().id == "a3" and engine.airport("egll").first().id == "a1"
    assert [x.type for x in engine.airport("EGLL").first().airspaces] == ["ATZ", "CTR"]
    assert [r.id for r in engine.airspaces_near(51.47, -0.1, 15.0).collect()] == ["s1", "s2", "s3"] or [r.id for r in engine.airspaces_near(51.47, -0.1, 15.0).collect()] == ["s1", "s3"]
    assert engine.waypoint("n1").count() == 1
    assert lookups.altitude_bounds({"value": 0, "unit": "ft", "ref": "gnd"}, {"value": 100, "unit": "fl", "ref": "std"}) == {"unit": "fl", "min": 0.0, "max": 100.0}


def test_rollups(flights, airframes):
    stats = rollups.type_stats(flights, airframes)
    rows = {r.icao_type: r for r in rollups.type_counts(stats, "2025-06-15", "2025-06-15").collect()}
    assert rows["A20N"].flight_count == 2 and rows["A20N"].model == "OWN MODEL 20" and rows["AT76"].model is None
    assert rollups.type_counts(stats, "2024-01-01", "2024-01-02").count() == 0


def answer(sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_catalog_against_sql(spark, name):
    columns, rows = answer(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    same = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=repr)
    assert sorted(got.columns) == sorted(columns)
    assert same(got.select(*columns).collect()) == same(rows)


def test_catalog_without_sql_runs(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, SF).count() > 0
