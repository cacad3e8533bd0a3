"""Sources, enrichment, writes, exports, the daily build and the stream."""

import gzip
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import enrich, exports, writes
from skein.operators import flights as fl
from skein.plans import catalog, daily
from skein.sources import fields, reference_data, traces
from skein.sources.synthetic import view
from skein.streaming import flights as stream

SF = "/root/testdata/sf0.001"


def entry(after, lat, lon, alt, gs=None, track=None, flags=0, vr=None, more=None, ias=None):
    """One report of a trace document, in the format's order of fields."""
    return [after, lat, lon, alt, gs, track, flags, vr, more, "adsb_icao", None, None, ias, None]


GOOD = [
    entry(5, 10.25, 20.5, 12_000, 300, 45, 2, -640, {"flight": "OWN77  ", "squawk": "0123", "category": "A5"}, 250),
    entry(10, 10.5, 20.5, "ground", flags="?"),
    entry(20, "10.75", "20.25", None, 7, 8, 0, 9, {"flight": "  ", "squawk": 4567}),
]
BAD = [[15, 10.5], [16, None, 20.0, 1, 1], ["late", 1, 2, 3]]


def trace(icao="3F00AA", base=50_000.0, reports=None):
    return json.dumps({"icao": icao, "t": "E190", "timestamp": base, "trace": GOOD[:2] + BAD + GOOD[2:] if reports is None else reports})


def test_trace_files(spark, tmp_path):
    (tmp_path / "day" / "aa").mkdir(parents=True)
    (tmp_path / "day/aa/trace_full_3f00aa.json").write_text(trace())
    with gzip.open(tmp_path / "day/aa/trace_full_3f00bb.json.gz", "wt") as f:
        f.write(trace(icao="3F00BB"))
    for k, bad in enumerate(["{", trace(icao=""), trace(base="never"), trace(reports={"no": "list"})]):
        (tmp_path / f"day/odd{k}.json").write_text(bad)
    raw = traces.read_traces(spark, str(tmp_path), "2025-06-15")
    rows = traces.points(raw).orderBy("icao24", "t").collect()
    assert [(r.icao24, r.t) for r in rows] == [(i, 50_000 + s) for i in ("3f00aa", "3f00bb") for s in (5, 10, 20)]
    first, second, last = rows[:3]
    assert (first.callsign, first.squawk, first.emitter_category, first.new_leg, first.alt_baro, first.gs, first.track, first.vr, first.ias, first.icao_type) == ("OWN77", "0123", "A5", True, 12_000, 300, 45, -640, 250, "E190")
    assert second.alt_baro is None and not second.new_leg and last.squawk == "4567" and last.callsign is None and last.lat == 10.75
    assert traces.rejects(raw).count() == 4


def test_airframe_lines(spark, tmp_path):
    lines = ["3F00AA;X-ONE;E190;0101;Own Jet 190;1999;Own Lines", "3f0;X;Y;0;short id", "3f00bb; ;AT76;0;;year;", "3f00cc;X-\\;TWO;C150;11", "3f00dd;X-FEW"]
    (tmp_path / "own.csv").write_text("\n".join(lines) + "\n")
    rows = {r.icao24: r for r in reference_data.read_airframes(spark, str(tmp_path / "own.csv")).collect()}
    assert set(rows) == {"3f00aa", "3f00bb", "3f00cc"}
    assert rows["3f00aa"].flags == 10 and rows["3f00aa"].year == 1999 and rows["3f00bb"].registration is None and rows["3f00bb"].year is None and rows["3f00cc"].registration == "X-;TWO"


def test_week_manifest_hash_follows_content_only(spark):
    rows = spark.range(50).select(F.lit("2025-06-09").cast("date").alias("start_week"), "id", (F.col("id") * 2).alias("v"))
    of = lambda d: writes.week_manifest(d).first()
    assert of(rows) == of(rows.orderBy(F.desc("id")).repartition(5)) and of(rows).row_count == 50
    assert of(rows).content_hash != of(rows.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v")))).content_hash


def test_features(spark, tmp_path):
    point = {"type": "Point", "coordinates": [1.5, 51.5]}
    lines = [
        {"type": "Feature", "properties": {"_id": "a", "name": "Airport", "icaoCode": "egll", "iataCode": "", "type": 3, "country": "GB", "elevation": {"value": 25, "unit": 0}}, "geometry": point},
        {"type": "Feature", "properties": {"name": "no id"}, "geometry": point},
    ]
    navaid = {"type": "Feature", "properties": {"_id": "n", "name": "VOR", "identifier": "lon", "type": 4, "frequency": {"value": "113600", "unit": 1}, "elevation": {"value": 10.5, "unit": 1}}, "geometry": point}
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    space = [{"type": "Feature", "properties": {"_id": f"s{k}", "name": "CTR", "type": 4, "icaoClass": 3, "upperLimit": {"value": 65, "unit": 6, "referenceDatum": 2}, "lowerLimit": {"value": 0, "unit": 1, "referenceDatum": 0}}, "geometry": {"type": t, "coordinates": c}} for k, (t, c) in enumerate((("Polygon", [ring]), ("MultiPolygon", [[ring], [ring]])))]
    for name, rows in (("gb_apt", lines), ("gb_nav", [navaid]), ("gb_asp", space)):
        (tmp_path / f"{name}.ndgeojson").write_text("\n".join(map(json.dumps, rows)))
    read = lambda g: reference_data.read_features(spark, str(tmp_path), g)
    (a,) = reference_data.airports(read("*_apt.ndgeojson")).collect()
    assert (a.ident, a.iata_code, a.elevation_ft, a.lon) == ("EGLL", None, 82, 1.5)
    (n,) = reference_data.navaids(read("*_nav.ndgeojson")).collect()
    assert n.frequency_mhz == pytest.approx(113.6) and n.elevation_ft == 10 and n.ident == "LON"
    spaces = reference_data.airspaces(read("*_asp.ndgeojson")).orderBy("id").collect()
    assert [len(s.rings) for s in spaces] == [1, 2] and spaces[0].upper_value == 65 and spaces[0].lower_ref == 0
    merged = reference_data.upserted(reference_data.airports(read("*_apt.ndgeojson")), reference_data.airports(read("*_apt.ndgeojson")).withColumn("name", F.lit("New")))
    assert [r.name for r in merged.collect()] == ["New"]


def test_pressure_and_terrain(spark):
    cube = spark.createDataFrame([(t, y, x, 1000.0 + x / 10) for t in (0.0, 3600.0) for y in (-90.0, 0.0, 90.0) for x in (0.0, 90.0, 180.0, 270.0)], "t double, lat double, lon double, pressure double")
    rows = spark.createDataFrame([(1, 1800.0, 45.0, 45.0), (2, 99999.0, 10.0, -45.0), (3, 0.0, 90.0, 270.0)], "id int, t double, lat double, lon double")
    got = {r.id: r.hpa for r in enrich.pressure_at(rows, fields.pressure_cube(cube), ["id"]).collect()}
    assert got[1] == pytest.approx(1004.5) and got[2] == pytest.approx(1013.5) and got[3] == pytest.approx(1027.0)
    pascal = fields.pressure_cube(cube.withColumn("pressure", F.col("pressure") * 100))
    assert pascal.agg(F.max("hpa")).first()[0] == pytest.approx(1027.0)
    flat = fl.measured(catalog.raw_flights(spark, SF).limit(5))
    even = spark.createDataFrame([(t, y, x, 1003.25) for t in (0.0, 2e9) for y in (-90.0, 90.0) for x in (0.0, 180.0)], "t double, lat double, lon double, pressure double")
    out = fl.measured(enrich.with_pressure(flat, fields.pressure_cube(even))).collect()
    assert all(abs(s.v + 273) < 1e-6 for r in out for part in r.alt_correction_ft for s in part) and all(r.min_qnh_alt == pytest.approx(r.min_alt - 273, abs=0.5) for r in out)
    tiles = fields.terrain_tiles(spark.createDataFrame([(y, x, r, c, 100.0) for y in range(45, 62) for x in range(-8, 20) for r in range(2) for c in range(2)], "tile_lat int, tile_lon int, row int, col int, elevation_m double"))
    agl = enrich.with_agl(flat, tiles, reach_m=50_000.0, pixels=2).collect()
    assert all(part[0].v == pytest.approx(r.path[k][0].alt - 328) for r in agl for k, part in enumerate(r.path_agl_ft))


def test_nearest_airport_prefers_heliports_for_rotorcraft(spark):
    airports = spark.createDataFrame([("fixed", 3, 51.0, 0.0), ("heli", 7, 51.0, 0.01), ("closed", 8, 51.0, 0.0), ("north", 3, 80.0, 10.0)], "id string, type_code int, lat double, lon double")
    rows = spark.createDataFrame([("a3", 51.0, 0.001, "A3", None), ("a7", 51.0, 0.001, "A7", None), ("high", 51.0, 0.001, "A3", 1000.1), ("edge", 51.0, 0.001, "A3", 1000.0), ("far", 51.0, 0.2, "A3", None), ("pole", 80.0, 10.2, None, None)], "key string, lat double, lon double, emitter_category string, agl double")
    got = {r.key: r.airport_id for r in enrich.nearest_airport(rows, airports).collect()}
    assert got == {"a3": "fixed", "a7": "heli", "high": None, "edge": "fixed", "far": None, "pole": "north"}


def test_upsert_and_stale_rows(spark, tmp_path):
    path = str(tmp_path / "flights")
    row = lambda i, day, n, batch: (i, datetime(2025, 3, 31) + timedelta(days=day), n, date.fromisoformat(batch), (datetime(2025, 3, 31) + timedelta(days=day - day % 7)).date())
    make = lambda *rows: spark.createDataFrame(list(rows), "icao24 string, start_ts timestamp, n int, ingest_batch_date date, start_week date")
    writes.upsert_flights(spark, path, make(row("a", 0, 1, "2025-04-01"), row("b", 1, 1, "2025-04-01"), row("c", 8, 1, "2025-04-08")))
    writes.upsert_flights(spark, path, make(row("a", 0, 2, "2025-04-01"), row("d", 2, 2, "2025-04-01")), date(2025, 4, 1))
    assert {(r.icao24, r.n) for r in spark.read.parquet(path).collect()} == {("a", 2), ("d", 2), ("c", 1)}
    writes.upsert_flights(spark, path, make(row("e", 1, 3, "2025-04-08")), date(2025, 4, 8))  # c's week is left empty
    assert {(r.icao24, r.n) for r in spark.read.parquet(path).collect()} == {("a", 2), ("d", 2), ("e", 3)}


def test_due_weeks_retention_and_states(spark):
    weeks = spark.createDataFrame([(date(2025, 3, d),) for d in (3, 10, 17, 24)], "start_week date")
    batches = spark.createDataFrame([(date(2025, 3, 27), "succeeded", datetime(2025, 3, 28)), (date(2025, 3, 20), "succeeded", datetime(2025, 3, 29)), (date(2025, 4, 9), "errored", datetime(2025, 4, 9))], "batch_date date, status string, finished_at timestamp")
    manifests = spark.createDataFrame([(date(2025, 3, 3), "parquet-zstd", True, datetime(2025, 3, 20)), (date(2025, 3, 10), "old", True, datetime(2025, 3, 20)), (date(2025, 3, 17), "parquet-zstd", True, datetime(2025, 3, 20))], "start_week date, format string, has_file boolean, exported_at timestamp")
    assert {r.start_week for r in writes.due_weeks(weeks, batches, manifests).collect()} == {date(2025, 3, 10), date(2025, 3, 17)}
    assert writes.retained(batches, "batch_date", None).count() == 3 and writes.retained(batches, "batch_date", 1, F.lit(date(2025, 4, 27))).count() == 2
    landed = spark.createDataFrame([(date(2025, 3, d),) for d in (19, 21, 27, 28, 29)], "batch_date date")
    assert [r.batch_date for r in daily.pending_days(landed, batches, date(2025, 3, 30), 10).collect()] == [date(2025, 3, 28), date(2025, 3, 29)]
    done = []
    said = daily.reprocess(daily.day_range(date(2025, 1, 1), date(2025, 1, 3)), {date(2025, 1, 1), date(2025, 1, 3)}, done.append)
    assert done == [date(2025, 1, 1), date(2025, 1, 3)] and said[date(2025, 1, 2)] == "no input"


def test_manifest_hash_follows_content(spark):
    rows = catalog.raw_flights(spark, SF).select("icao24", "start_t", "start_week", "callsign")
    a, b, c = (writes.week_manifest(x).first() for x in (rows, rows.repartition(7), rows.withColumn("callsign", F.lit("x"))))
    assert a.content_hash == b.content_hash != c.content_hash and a.row_count == c.row_count


def test_exports_are_well_formed(spark):
    import xml.dom.minidom as dom

    rows = catalog.raw_flights(spark, SF).limit(3).withColumn("callsign", F.lit("A<&>'\""))
    for made, frame in ((exports.gpx_tracks(rows), exports.GPX), (exports.kml_placemarks(rows), exports.KML), (exports.kml_placemarks(rows, timed=False), exports.KML)):
        doc = dom.parseString(exports.whole_document(made, frame).first().value)
        assert "A<&>'\"" in doc.documentElement.toxml() or doc.getElementsByTagName("name")[0].firstChild.data == "A<&>'\""
    feature = json.loads(exports.geojson_features(rows).first().value)
    assert feature["geometry"]["type"] == "MultiLineString" and feature["properties"]["callsign"] == "A<&>'\""
    assert exports.csv_lines(rows).columns == exports.CSV_COLUMNS and exports.csv_lines(rows).first().registration is None
    owned = rows.withColumn("af", F.struct(F.lit("X-OWN").alias("registration"), F.lit("Own, Jet").alias("model"), F.lit("Own ]]> Lines").alias("operator")))
    one, feature = exports.csv_lines(owned).first(), json.loads(exports.geojson_features(owned).first().value)
    assert (one.registration, one.model) == ("X-OWN", "Own, Jet") and one.start_ts < one.end_ts and one.timestamp_utc == one.start_ts
    assert list(feature["properties"]) == ["flight_id", "icao24", "callsign", "registration", "model", "operator", "icao_type", "start_ts", "end_ts"]
    assert feature["properties"]["operator"] == "Own ]]> Lines" and feature["properties"]["icao_type"] is None
    about = dom.parseString(exports.whole_document(exports.kml_placemarks(owned), exports.KML).first().value).getElementsByTagName("description")[0]
    said = "".join(n.data for n in about.childNodes)
    assert said.splitlines()[1:4] == ["Reg: X-OWN", "Model: Own, Jet", "Operator: Own ]]> Lines"] and len(said.splitlines()) == 6


def test_split_archives(spark, tmp_path):
    """Members of an archive in two parts, of a whole one, and of one that breaks off; members that cannot be unpacked are named."""
    import io
    import tarfile

    from skein.sources import archives

    def tar(*members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, body in members:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    packed = lambda icao: gzip.compress(trace(icao=icao).encode())
    whole = tar(("./traces/aa/trace_full_3f00aa.json", packed("3F00AA")), ("index.json", b"{}"), ("traces/bb/trace_full_3f00bb.json.gz", packed("3F00BB")), ("traces/cc/broken.json.gz", packed("3F00CC")[:40]), ("traces/dd/pic.png", b"x"), ("traces/ee/trace_full_3f00ee.json", trace(icao="3F00EE").encode()))
    (tmp_path / "day").mkdir()
    cut = len(whole) // 3  # in the middle of a member
    (tmp_path / "day/v1-prod.tar.aa").write_bytes(whole[:cut])
    (tmp_path / "day/v1-prod.tar.ab").write_bytes(whole[cut:])
    (tmp_path / "day/v2.tar").write_bytes(tar(("traces/trace_full_3f00ff.json", packed("3F00FF"))))
    (tmp_path / "day/v3.tar").write_bytes(tar(("traces/trace_full_3f0011.json", packed("3F0011")), ("traces/t.json", b"y" * 5000))[:3000])
    (tmp_path / "day/readme.txt").write_text("no archive")
    raw = archives.read_archives(spark, str(tmp_path / "day"), "2025-06-15")
    rows = traces.points(raw).select("icao24", "t").collect()
    assert sorted({r.icao24 for r in rows}) == ["3f0011", "3f00aa", "3f00bb", "3f00ee", "3f00ff"] and len(rows) == 15
    assert {r.name for r in traces.rejects(raw).collect()} >= {"traces/cc/broken.json.gz"}
    assert archives.archives(["b.tar.ab", "a.tar", "b.tar.aa", "c.tar.gz", "d.json"]) == [["a.tar"], ["b.tar.aa", "b.tar.ab"]]


def test_as_of_two_tables(spark):
    import random

    from skein.operators.asof import as_of

    rng = random.Random(6)
    some = lambda v, p=0.1: None if rng.random() < p else v
    left = [(k, some(rng.choice("ab")), rng.choice("xy"), some(float(rng.randint(0, 60)))) for k in range(200)]
    right = [(100 + k, some(rng.choice("ab")), rng.choice("xyz"), some(float(rng.randint(0, 60)))) for k in range(80)]
    names = "n int, g string, h string, t double"
    a, b = spark.createDataFrame(left, names).repartition(3), spark.createDataFrame(right, names.replace("t double", "at double")).repartition(2)

    def brute(within=None):
        out = {}
        for n, g, h, t in left:
            fits = [(x, m) for m, i, j, x in right if None not in (g, i, t, x) and (i, j) == (g, h) and x <= t and (within is None or t - x <= within)]
            out[n] = max(fits)[1] if fits else None
        return out

    for stretch in (7.0, 1e9):
        got = as_of(a, b, ["g", "h"], right_t="at", ties=["n"], stretch=stretch).collect()
        assert len(got) == len(left) and {r.n: r.as_of and r.as_of.n for r in got} == brute()
    near = as_of(a, b, ["g", "h"], right_t="at", ties=["n"], within=5.0, stretch=4.0, name="seen")
    assert {r.n: r.seen and r.seen.n for r in near.collect()} == brute(5.0) != brute()
    assert as_of(a.limit(0), b, ["g"], right_t="at").count() == 0
    assert as_of(a, b.limit(0), ["g"], right_t="at").where("as_of IS NULL").count() == len(left)


def test_token_index(spark, tmp_path):
    from skein.operators import lookups

    points = spark.createDataFrame([("w1", "airport", "Nord Field", "NFLD", 3, 1.0, 2.0), ("w2", "airport", "Nord Closed", "NCLO", 8, 1.0, 2.0), ("w3", "navaid", "Nordic Star", "NST", None, 1.0, 2.0), ("w4", "reporting_point", "Örnö nord-field", None, None, 1.0, 2.0)], "id string, kind string, name string, ident string, type_code int, lon double, lat double")
    areas = spark.createDataFrame([("s1", "NORD FIELD CTR", 4, 0.0, 0.0, 1.0, 1.0)], "id string, name string, type_code int, min_lon double, min_lat double, max_lon double, max_lat double")
    path = str(tmp_path / "index")
    lookups.store_index(lookups.token_index(points, areas), path)
    index = spark.read.parquet(path)
    for q in ("nord", "no fie", "field NORD", "nfld", "ör", "ö", "zz", "", "  ", "nord nord", "s", "nordi"):
        for kinds in (None, ["airport", "airspace"]):
            want = [(r.id, r.kind, r.name) for r in lookups.search(points, areas, q, kinds).collect()]
            assert [(r.id, r.kind, r.name) for r in lookups.search_index(index, q, kinds).collect()] == want, q
    assert [r.id for r in lookups.search_index(index, "nord", limit=2).collect()] == ["w1", "w3"]
    said = lookups.search_index(index, "fie")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(token,fie)" in said and "LessThanOrEqual(token,fie" in said


def test_airspace_labels(spark):
    from skein.functions import text

    rows = spark.createDataFrame([(4, 3), (13, 0), (23, 6), (24, 8), (None, None)], "t int, c int")
    assert [tuple(r) for r in rows.select(text.airspace_type(F.col("t")), text.airspace_class(F.col("c"))).collect()] == [("CTR", "D"), ("ATZ", "A"), ("Sport", "G"), (None, None), (None, None)]


def test_daily_build_twice_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    rows = view(spark, SF, "tracks").withColumnRenamed("event_id", "seq").withColumn("icao_type", F.lit("B738"))
    full = rows.select("icao24", "icao_type", "t", "lat", "lon", "alt_baro", *[F.lit(None).cast("double").alias(c) for c in ("track", "gs", "vr", "ias")], "squawk", "callsign", "emitter_category", "new_leg", F.col("seq").cast("int").alias("seq"), F.lit(date(2024, 1, 1)).alias("batch_date"))
    frames = view(spark, SF, "airframes")
    for _ in range(2):
        daily.run_day(spark, root, date(2024, 1, 1), lambda _: full, frames)
    built = spark.read.parquet(f"{root}/flights")
    assert built.count() == built.select("icao24", "start_ts").distinct().count() == catalog.full_flights(spark, SF).count()
    assert spark.read.parquet(f"{root}/icao_type_stats").agg(F.sum("flight_count")).first()[0] == built.count()
    states = writes.batch_states(spark.read.parquet(f"{root}/batches")).collect()
    assert [(s.status, s.flight_count) for s in states] == [("succeeded", built.count())]


class Held:
    """A list and a value in state, as the stream has them; what is written is counted."""

    def __init__(self):
        self.rows, self.value, self.timers, self.appended, self.rewritten = [], None, set(), 0, 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def getValueState(self, name, schema):  # noqa: N802
        outer = self

        class Value:
            get = staticmethod(lambda: outer.value)
            update = staticmethod(lambda v: setattr(outer, "value", v))
            clear = staticmethod(lambda: setattr(outer, "value", None))

        return Value()

    def get(self):
        return iter(self.rows)

    def appendList(self, rows):  # noqa: N802
        self.rows, self.appended = self.rows + rows, self.appended + len(rows)

    def put(self, rows):
        self.rows, self.rewritten = list(rows), self.rewritten + len(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_open_legs_in_any_batches_are_those_of_one():
    """Batches of any size, late reports among them: the same legs; new reports are appended, the list is not written again."""
    import random

    import pandas as pd

    rng = random.Random(3)
    t, reports = 0.0, []
    for _ in range(400):
        t += rng.choice([5.0, 20.0, 50.0, 700.0])
        reports.append({**dict.fromkeys(stream.COLUMNS), "t": t, "lat": 0.0005 * t % 1, "lon": 0.0, "alt_baro": rng.choice([None, 1000.0, 1500.0, 1500.0]), "new_leg": rng.random() < 0.02, "callsign": rng.choice([None, "OWN1"])})
    want = [(p[0]["t"], p[-1]["t"], len(p)) for p in stream._split(reports)]
    assert len(want) > 8
    plain = stream._row
    for late in (False, True):
        seen, held, legs = list(reports), Held(), stream.OpenLegs()
        if late:
            for k in range(0, 390, 7):  # neighbours change places
                seen[k], seen[k + 1] = seen[k + 1], seen[k]
        legs.init(held)
        got: list = []
        stream._row = lambda icao24, points: got.append((points[0]["t"], points[-1]["t"], len(points)))  # noqa: B023
        try:
            k = 0
            while k < len(seen):
                n = rng.randint(1, 5)
                if late and k % 7 == 0:
                    n += 1
                list(legs.handleInputRows(("a",), iter([pd.DataFrame(seen[k : k + n])]), held))
                k += n
            assert len(held.timers) == 1
            list(legs.handleExpiredTimer(("a",), held, None))
        finally:
            stream._row = plain
        assert not held.rows and held.value is None
        assert sum(n for *_, n in got) == len(reports)
        if late:  # a report that comes after its leg was closed begins another one
            assert got[-1] == want[-1] and len(set(got) & set(want)) > len(want) / 2
        else:  # a report is written once at most, those of a leg that the batch closes never
            assert got == want and held.appended + held.rewritten <= len(reports)


def test_week_manifest_hash_of_a_fixed_table(spark):
    """The hash is the sum of the rows' chained 64-bit hashes, by another implementation."""
    import struct

    import xxhash

    rows = [("a", 1, 5), ("b", 2, -7), ("é", 3, 0)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    chain = lambda s, *numbers: [h := xxhash.xxh64(s.encode(), 42).intdigest(), *[h := xxhash.xxh64(struct.pack("<q", n), h).intdigest() for n in numbers]][-1]
    table = spark.createDataFrame(rows, "s string, n long, m long").withColumn("start_week", F.lit(date(2025, 6, 9)))
    got = writes.week_manifest(table).first()
    assert got.row_count == 3 and int(got.content_hash) == sum(signed(chain(*r)) for r in rows)


def test_stream_makes_the_batch_builders_flights(spark, tmp_path):
    rows = view(spark, SF, "tracks").withColumnRenamed("event_id", "seq")
    full = rows.select("icao24", "t", "lat", "lon", "alt_baro", *[F.lit(None).cast("double").alias(c) for c in ("track", "gs", "vr", "ias")], "squawk", "callsign", "emitter_category", "new_leg")
    landed = str(tmp_path / "landed")
    times = [r.t for r in full.select("t").orderBy("t").collect()]
    edges = [times[0], times[len(times) // 3], times[2 * len(times) // 3], times[-1] + 1]
    for a, b in zip(edges, edges[1:], strict=False):
        full.where((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.mode("append").parquet(landed)
    # a report far ahead moves the watermark on, so that silence closes every leg
    late = full.limit(1).withColumn("icao24", F.lit("ffffff")).withColumn("t", F.col("t") + 864_000.0)
    late.coalesce(1).write.mode("append").parquet(landed)
    late.withColumn("t", F.col("t") + 10.0).coalesce(1).write.mode("append").parquet(landed)
    source = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    table = str(tmp_path / "flights")
    query = stream.into_table(stream.flights_stream(source, "10 minutes"), table, str(tmp_path / "checkpoint"))
    query.awaitTermination(300)
    got = {(r.icao24, round(r.start_t, 3), round(r.end_t, 3), r.raw_point_count, r.callsign, sum(map(len, r.path))) for r in spark.read.parquet(table).collect()}
    want = {(r.icao24, round(r.start_t, 3), round(r.end_t, 3), r.raw_point_count, r.callsign, sum(map(len, r.path))) for r in catalog.full_flights(spark, SF).collect()}
    assert got == want


def test_a_micro_batch_is_computed_once(spark, tmp_path):
    """Weeks, ranges, rows and cells of an upsert come from one evaluation of what is written."""
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    flights = catalog.built_flights(spark, SF).select("icao24", "start_ts", "start_week", "cells").coalesce(1).cache()
    rows, path = flights.mapInArrow(counted, flights.schema), str(tmp_path / "flights")
    writes.upsert_flights(spark, path, rows)
    assert calls.value == flights.count()
    writes.upsert_flights(spark, path, rows)
    assert calls.value == 2 * flights.count() and spark.read.parquet(path).count() == flights.count()


def test_few_blocks_come_to_the_rows(spark, monkeypatch):
    """Rows of one block are not gathered in one task where blocks are few; where they are many, the same values are found."""
    cube = spark.createDataFrame([(t, y, x, 1000.0 + t + y + x) for t in (0.0, 1.0) for y in (0.0, 1.0) for x in (0.0, 1.0)], "t double, lat double, lon double, hpa double")
    dem = spark.createDataFrame([(0, 0, r, c, 10.0 * r + c) for r in range(4) for c in range(4)], "tile_lat int, tile_lon int, row int, col int, elev_ft double")
    rows = spark.createDataFrame([(k, k / 40, k / 50, k / 60) for k in range(40)], "id int, t double, lat double, lon double")
    jobs = [lambda: enrich.pressure_at(rows, cube), lambda: enrich.terrain_at(rows, dem, pixels=4)]
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(enrich, "cut", lambda df: df)  # of unknown size until they are written, as tables of weeks of samples are
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for job in jobs:
            monkeypatch.setattr(enrich, "BROADCAST_VALUES", 1000)
            near = job()
            monkeypatch.setattr(enrich, "BROADCAST_VALUES", 1)
            dealt = job()
            assert "SortMergeJoin" not in plan(near) and "SortMergeJoin" in plan(dealt)
            assert sorted(near.collect()) == sorted(dealt.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
