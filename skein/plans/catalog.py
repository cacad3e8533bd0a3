"""The library's queries over the star schema's aircraft tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions import series as S
from ..operators import enrich, exports, lookups, profiles, rollups, tables, writes
from ..operators import flights as fl
from ..sources import traces
from ..session import stored_path
from ..sources.synthetic import oracle, view
from . import predicates as P
from .engine import Engine, before

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
T0 = 1_704_067_200.0
#: The last report of the tables is before this.
CUTOFF = T0 + 6_480.0
BOX = (-2.5, 50.0, 4.5, 56.0)
CIRCLE = geo.Circle(2.0, 53.0, 150_000.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared tables -------------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tracks").withColumnRenamed("event_id", "seq")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.legs(points(spark, sf_dir), first_only=True)


def built_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with every airborne report as a vertex: what SQL can follow."""
    return fl.build_flights(fl.capped(legs(spark, sf_dir)), clean=False, simplified=False)


def sources(sf_dir: str) -> list[str]:
    """The tables that flights and their dimensions are made from."""
    return [f"{sf_dir}/{name}.parquet" for name in ("events", "nation", "customer")]


def flights_path(spark: SparkSession, sf_dir: str) -> str:
    return stored_path(spark, f"flights of {sf_dir}", lambda path: tables.upsert_flights(spark, path, built_flights(spark, sf_dir)), sources(sf_dir))


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table of weeks: queries over flights read the weeks, columns and row groups they need, as they would in production."""
    return tables.read_flights(spark, flights_path(spark, sf_dir))


def full_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights as the daily build makes them: outliers left out, paths simplified."""
    return fl.build_flights(fl.capped(legs(spark, sf_dir)))


def hav(a: str, b: str, c: str, d: str) -> str:
    x = f"power(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians(({d}) - ({b})) / 2), 2)"
    return f"(12742000.0 * asin(sqrt(least(1.0, greatest(0.0, {x})))))"


TRACKS = f"tracks AS ({oracle('tracks')})"
LEGS = f"""{TRACKS},
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icao24, t ORDER BY event_id) AS rk FROM tracks) WHERE rk = 1),
prev AS (SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(alt_baro) OVER w AS palt FROM dedup WINDOW w AS (PARTITION BY icao24 ORDER BY t, event_id)),
far AS (SELECT *, t - pt AS gap, {hav('plat', 'plon', 'lat', 'lon')} AS d FROM prev),
brk AS (SELECT *, CASE WHEN pt IS NULL THEN 1 WHEN alt_baro IS NULL AND palt IS NULL AND gap > 600 THEN 1
  WHEN alt_baro IS NOT NULL AND palt IS NOT NULL AND gap > 60 THEN CASE WHEN gap > 43200 OR d > 350 * gap OR (gap > 600 AND d < 10 * gap) THEN 1 ELSE 0 END
  ELSE CAST(new_leg AS INT) END AS b FROM far),
legs AS (SELECT *, CAST(sum(b) OVER (PARTITION BY icao24 ORDER BY t, event_id) AS BIGINT) AS leg FROM brk)"""
VERTICES = f"""{LEGS},
air0 AS (SELECT *, lag(t) OVER (PARTITION BY icao24, leg ORDER BY t, event_id) AS at0 FROM legs WHERE alt_baro IS NOT NULL),
air1 AS (SELECT *, sum(CASE WHEN at0 IS NULL OR t - at0 > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY icao24, leg ORDER BY t, event_id) AS part FROM air0),
vertices AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY icao24, leg, part) AS n_part FROM air1) WHERE n_part >= 2),
started AS (SELECT icao24, leg, min(t) AS start_t, max(t) AS end_t FROM vertices GROUP BY icao24, leg),
segs AS (SELECT *, row_number() OVER (PARTITION BY icao24, leg ORDER BY t1) AS k FROM (SELECT icao24, leg, part, lag(part) OVER s AS part0, lag(t) OVER s AS t0, lag(lon) OVER s AS lon0, lag(lat) OVER s AS lat0, lag(alt_baro) OVER s AS z0, t AS t1, lon AS lon1, lat AS lat1, alt_baro AS z1
  FROM vertices WINDOW s AS (PARTITION BY icao24, leg ORDER BY t, event_id)) WHERE t0 IS NOT NULL)"""
FLIGHT = f"""{VERTICES},
named AS (SELECT icao24, leg, callsign, row_number() OVER (PARTITION BY icao24, leg ORDER BY n DESC, first_t) AS rk
  FROM (SELECT icao24, leg, callsign, count(*) AS n, min(t) AS first_t FROM legs WHERE callsign IS NOT NULL GROUP BY 1, 2, 3)),
counted AS (SELECT icao24, leg, count(*) AS raw_point_count, min(emitter_category) AS emitter_category FROM legs GROUP BY 1, 2),
codes AS (SELECT icao24, leg, part, t, squawk FROM vertices),
flights AS (SELECT v.icao24, v.leg, min(v.t) AS start_t, max(v.t) AS end_t, CAST(count(*) AS INT) AS n_vertices, CAST(count(DISTINCT v.part) AS INT) AS n_parts,
  min(v.alt_baro) AS min_alt, max(v.alt_baro) AS max_alt, min(v.lon) AS min_lon, max(v.lon) AS max_lon, min(v.lat) AS min_lat, max(v.lat) AS max_lat,
  arg_min(v.lon, v.t) AS start_lon, arg_min(v.lat, v.t) AS start_lat, arg_max(v.lon, v.t) AS end_lon, arg_max(v.lat, v.t) AS end_lat, bool_or(v.squawk = '7700') AS emergency,
  any_value(c.raw_point_count) AS raw_point_count, any_value(c.emitter_category) AS emitter_category, any_value(n.callsign) AS callsign
  FROM vertices v JOIN counted c USING (icao24, leg) LEFT JOIN named n ON n.icao24 = v.icao24 AND n.leg = v.leg AND n.rk = 1 GROUP BY v.icao24, v.leg)"""
FRAMES = f"airframes AS ({oracle('airframes')})"
AIRPORTS = f"airports AS ({oracle('airports')})"
SPACES = f"airspaces AS ({oracle('airspaces')})"
STAMP = "make_timestamp(CAST(round({}*1000000) AS BIGINT))"


def r3(c: Column) -> Column:
    return F.round(c, 3)


# --- flight building -----------------------------------------------------------------------------------------------


@query(f"WITH {TRACKS} SELECT icao24, count(*) AS reports, count(DISTINCT t) AS instants, min(event_id) AS first_report FROM tracks GROUP BY icao24")
def f01_reports_by_aircraft(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rows.groupBy("icao24").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("t").alias("instants"), F.min("seq").alias("first_report"))


@query(f"WITH {LEGS} SELECT event_id, icao24, t, alt_baro, squawk FROM dedup")
def f02_first_report_of_instant(spark, sf_dir):
    return fl.deduplicated(points(spark, sf_dir)).select(F.col("seq").alias("event_id"), "icao24", "t", "alt_baro", "squawk")


@query(f"""WITH {TRACKS}, both_ AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS src FROM tracks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY icao24, t ORDER BY src, event_id) AS rk FROM both_)
SELECT event_id, icao24, t, CASE WHEN max(src) OVER (PARTITION BY icao24) = 1 THEN 'new' ELSE 'staged' END AS icao_type FROM ranked WHERE rk = 1""")
def f03_staged_and_new_reports(spark, sf_dir):
    """Every third report plays yesterday's staging."""
    rows = points(spark, sf_dir)
    staged, new = rows.where("seq % 3 = 0").withColumn("icao_type", F.lit("staged")), rows.where("seq % 3 <> 0").withColumn("icao_type", F.lit("new"))
    return fl.merge_reports(staged, new).select(F.col("seq").alias("event_id"), "icao24", "t", "icao_type")


@query(f"WITH {LEGS} SELECT event_id, icao24, leg FROM legs")
def f04_legs(spark, sf_dir):
    return legs(spark, sf_dir).select(F.col("seq").alias("event_id"), "icao24", "leg")


@query(f"""WITH {LEGS}, ends AS (SELECT icao24, leg, count(*) AS n, max(t) AS t1, arg_max(alt_baro, t) FILTER (WHERE true) AS a0 FROM legs GROUP BY icao24, leg),
lastp AS (SELECT icao24, leg, alt_baro AS a, t, row_number() OVER (PARTITION BY icao24 ORDER BY leg DESC, t DESC, event_id DESC) AS rk FROM legs),
open_ AS (SELECT l.icao24, l.leg FROM lastp l JOIN ends e USING (icao24, leg) WHERE l.rk = 1 AND e.n >= 2 AND l.t >= {CUTOFF} - CASE WHEN l.a IS NULL THEN 600 ELSE 3600 END)
SELECT legs.event_id, legs.icao24, legs.leg FROM legs JOIN open_ USING (icao24, leg)""")
def f05_open_legs(spark, sf_dir):
    return fl.open_legs(legs(spark, sf_dir), CUTOFF).select(F.col("seq").alias("event_id"), "icao24", "leg")


@query(f"WITH {LEGS} SELECT event_id, icao24, last_value(squawk IGNORE NULLS) OVER (PARTITION BY icao24, leg ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS squawk FROM legs")
def f06_squawk_filled(spark, sf_dir):
    return fl.filled_forward(legs(spark, sf_dir), "squawk", ["icao24", "leg"], ["t", "seq"]).select(F.col("seq").alias("event_id"), "icao24", "squawk")


@query(f"""WITH {LEGS}, known AS (SELECT *, last_value(CASE WHEN alt_baro IS NOT NULL THEN t END IGNORE NULLS) OVER a AS ta, last_value(alt_baro IGNORE NULLS) OVER a AS va,
  first_value(CASE WHEN alt_baro IS NOT NULL THEN t END IGNORE NULLS) OVER b AS tb, first_value(alt_baro IGNORE NULLS) OVER b AS vb FROM legs
  WINDOW a AS (PARTITION BY icao24, leg ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY icao24, leg ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, icao24, round(coalesce(alt_baro, va + CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0.5 END * (vb - va)), 3) AS alt_baro FROM known""")
def f07_altitude_interpolated(spark, sf_dir):
    return fl.filled_linear(legs(spark, sf_dir), "alt_baro", ["icao24", "leg"], order=["t", "seq"]).select(F.col("seq").alias("event_id"), "icao24", r3(F.col("alt_baro")).alias("alt_baro"))


@query(f"""WITH {FLIGHT} SELECT icao24, start_t, end_t, n_vertices, n_parts, CAST(raw_point_count AS INT) AS raw_point_count, callsign, emitter_category,
  min_alt, max_alt, start_lon, start_lat, end_lon, end_lat, min_lon, min_lat, max_lon, max_lat FROM flights""")
def f08_flights(spark, sf_dir):
    rows = built_flights(spark, sf_dir)
    heights = F.transform(F.flatten("path"), lambda v: v["alt"])
    return rows.select("icao24", "start_t", "end_t", S.num_instants(F.col("path")).alias("n_vertices"), F.size("path").alias("n_parts"), "raw_point_count", "callsign", "emitter_category", F.array_min(heights).alias("min_alt"), F.array_max(heights).alias("max_alt"), "start_lon", "start_lat", "end_lon", "end_lat", "min_lon", "min_lat", "max_lon", "max_lat")


@query(f"""WITH {VERTICES}, coded AS (SELECT *, lag(squawk) OVER (PARTITION BY icao24, leg, part ORDER BY t, event_id) AS before FROM vertices WHERE squawk IS NOT NULL),
runs AS (SELECT icao24, leg, count(*) AS n_changes FROM coded WHERE before IS NULL OR before <> squawk GROUP BY 1, 2),
codes AS (SELECT icao24, leg, string_agg(DISTINCT squawk, ',' ORDER BY squawk) AS squawk_codes FROM vertices WHERE squawk IS NOT NULL GROUP BY 1, 2)
SELECT s.icao24, s.start_t, coalesce(squawk_codes, '') AS squawk_codes, CAST(coalesce(n_changes, 0) AS BIGINT) AS n_changes FROM started s LEFT JOIN runs USING (icao24, leg) LEFT JOIN codes USING (icao24, leg)""")
def f09_squawk_runs(spark, sf_dir):
    rows = raw_flights(spark, sf_dir)
    changes = lambda part: F.size(F.filter(part, lambda x, k: (k == 0) | (x["v"] != F.get(part, k - 1)["v"])))
    return rows.select("icao24", "start_t", F.array_join("squawk_codes", ",").alias("squawk_codes"), F.aggregate(F.transform("squawk_seq", changes), F.lit(0), lambda a, x: a + x).cast("long").alias("n_changes"))


def geodesic_sql(source: str, columns: str, name: str) -> str:
    """CTEs that end in ``name``: ``columns`` of ``source`` (lon0, lat0, lon1, lat1 among its columns) and the metres ``m`` between both ends."""
    a, e, f = f"{geo.WGS84_A!r}", f"{1 - geo.WGS84_F!r}", f"{geo.WGS84_F / 2!r}"
    return f"""hpq_{name} AS (SELECT *, atan({e} * tan(radians(lat0))) AS b1, atan({e} * tan(radians(lat1))) AS b2, radians(lon1 - lon0) / 2 AS hl FROM {source}),
hh_{name} AS (SELECT *, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q FROM hpq_{name}),
hs_{name} AS (SELECT *, least(1.0, greatest(0.0, power(sin(q), 2) + (power(cos(q), 2) - power(sin(p), 2)) * power(sin(hl), 2))) AS h FROM hh_{name}),
ln_{name} AS (SELECT *, 2 * asin(sqrt(h)) AS s FROM hs_{name}),
{name} AS (SELECT {columns}, CASE WHEN h <= 0 OR h >= 1 THEN {a} * s ELSE {a} * (s - {f} * ((s - sin(s)) * power(sin(p) * cos(q), 2) / (1 - h) + (s + sin(s)) * power(cos(p) * sin(q), 2) / h)) END AS m FROM ln_{name})"""


LENGTHS = f"{VERTICES}, {geodesic_sql('segs', 'icao24, leg, k', 'lengths')}"


@query(f"WITH {LENGTHS} SELECT started.icao24, start_t, round(sum(m), 2) AS length_m, round(sum(m) / 1852, 3) AS length_nm FROM started JOIN lengths USING (icao24, leg) GROUP BY started.icao24, start_t")
def f10_path_length(spark, sf_dir):
    rows = raw_flights(spark, sf_dir).withColumn("m", S.path_length_m(F.col("path")))
    return rows.select("icao24", "start_t", F.round("m", 2).alias("length_m"), F.round(F.col("m") / geo.NM_M, 3).alias("length_nm"))


@query()
def f11_flights_simplified(spark, sf_dir):
    """Outliers left out and paths simplified by the time-ratio rule: beyond SQL, held against brute force in the tests."""
    rows = full_flights(spark, sf_dir)
    return rows.select("icao24", "start_ts", "end_ts", "callsign", "raw_point_count", "dropped", S.num_instants(F.col("path")).alias("n_vertices"), F.size("path").alias("n_parts"), F.round("path_length_m", 1).alias("path_length_m"), "squawk_codes")


AIRBORNE = f"""{LEGS},
air AS (SELECT *, row_number() OVER (PARTITION BY icao24, leg ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY icao24, leg) AS n FROM legs WHERE alt_baro IS NOT NULL),
walk AS (SELECT icao24, leg, rn, event_id, true AS kept, t AS lt, lat AS llat, lon AS llon, alt_baro AS lalt FROM air WHERE rn = 1 AND n >= 2
  UNION ALL SELECT icao24, leg, rn, event_id, ok, CASE WHEN ok THEN t ELSE lt END, CASE WHEN ok THEN lat ELSE llat END, CASE WHEN ok THEN lon ELSE llon END, CASE WHEN ok THEN alt_baro ELSE lalt END
  FROM (SELECT w.icao24, w.leg, a.rn, a.event_id, w.lt, w.llat, w.llon, w.lalt, a.t, a.lat, a.lon, a.alt_baro,
    a.t - w.lt <= 0 OR ({hav('w.llat', 'w.llon', 'a.lat', 'a.lon')} / (a.t - w.lt) <= 500 AND abs(a.alt_baro - w.lalt) / (a.t - w.lt) <= 300) AS ok FROM walk w JOIN air a ON a.icao24 = w.icao24 AND a.leg = w.leg AND a.rn = w.rn + 1)),
fits AS (SELECT a.*, lag(a.t) OVER (PARTITION BY a.icao24, a.leg ORDER BY a.rn) AS before FROM air a JOIN walk w USING (event_id) WHERE w.kept),
stretch AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY icao24, leg ORDER BY rn) AS part FROM fits),
whole AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY icao24, leg, part) AS n_part FROM stretch) WHERE n_part >= 2),
cleaned AS (SELECT icao24, leg, min(t) AS start_t, max(t) AS end_t, CAST(count(*) AS INT) AS n_vertices, CAST(count(DISTINCT part) AS INT) AS n_parts FROM whole GROUP BY icao24, leg),
refused AS (SELECT icao24, leg, CAST(count(*) FILTER (WHERE NOT kept) AS INT) AS dropped FROM walk GROUP BY icao24, leg)"""


@query(f"WITH RECURSIVE {AIRBORNE} SELECT CAST(coalesce(sum(dropped), 0) AS BIGINT) AS dropped, count(DISTINCT CASE WHEN dropped > 0 THEN icao24 END) AS aircraft FROM cleaned JOIN refused USING (icao24, leg)")
def f12_implausible_reports(spark, sf_dir):
    return fl.dropped_reports(full_flights(spark, sf_dir))


@query(f"WITH RECURSIVE {AIRBORNE} SELECT icao24, start_t, end_t, n_vertices, n_parts, dropped FROM cleaned JOIN refused USING (icao24, leg)")
def f15_flights_cleaned(spark, sf_dir):
    """Outliers left out, judged against the last report kept; every other report stays a vertex."""
    rows = fl.build_flights(fl.capped(legs(spark, sf_dir)), clean=True, simplified=False)
    return rows.select("icao24", "start_t", "end_t", S.num_instants(F.col("path")).alias("n_vertices"), F.size("path").alias("n_parts"), "dropped")


@query(f"""WITH {VERTICES} SELECT icao24, start_t, CAST(floor((lat + 90) / 0.5) * 100000 + floor((lon + 180) / 0.5) AS BIGINT) AS start_cell FROM started JOIN vertices v USING (icao24, leg) WHERE v.t = start_t""")
def f13_start_cells(spark, sf_dir):
    return raw_flights(spark, sf_dir).select("icao24", "start_t", geo.cell(F.col("start_lon"), F.col("start_lat"), fl.CELL).alias("start_cell"))


CAP_S = 900.0


@query(f"""WITH RECURSIVE {LEGS}, starts AS (SELECT icao24, leg, min(t) AS s FROM legs GROUP BY icao24, leg
UNION ALL SELECT * FROM (SELECT icao24, leg, (SELECT min(l.t) FROM legs l WHERE l.icao24 = starts.icao24 AND l.leg = starts.leg AND l.t > starts.s + {CAP_S}) AS s FROM starts) WHERE s IS NOT NULL)
SELECT event_id, legs.icao24, legs.leg, CAST(count(*) - 1 AS INT) AS part FROM legs JOIN starts ON starts.icao24 = legs.icao24 AND starts.leg = legs.leg AND starts.s <= legs.t GROUP BY event_id, legs.icao24, legs.leg""")
def f14_capped_legs(spark, sf_dir):
    """Legs cut where a report is later than a quarter of an hour after its flight's start."""
    rows = fl.capped(legs(spark, sf_dir), longest_s=CAP_S)
    return rows.select(F.col("seq").alias("event_id"), "icao24", "leg", "part")


# --- joins ---------------------------------------------------------------------------------------------------------


@query(f"WITH {FLIGHT}, {FRAMES} SELECT f.icao24, start_t, registration, icao_type, model, CAST(year AS INT) AS year FROM flights f LEFT JOIN airframes a USING (icao24)")
def j01_flights_with_airframes(spark, sf_dir):
    rows = lookups.with_airframes(raw_flights(spark, sf_dir).drop("icao_type"), view(spark, sf_dir, "airframes"))
    return rows.select("icao24", "start_t", "af.registration", "af.icao_type", "af.model", F.col("af.year").cast("int").alias("year"))


NEAREST = f"""{TRACKS}, {AIRPORTS}, pairs AS (SELECT event_id, id, {hav('t.lat', 't.lon', 'a.lat', 'a.lon')} AS m, type_code IN (4, 7) AS heli FROM tracks t JOIN airports a
  ON a.lat BETWEEN t.lat - 0.05 AND t.lat + 0.05 AND a.lon BETWEEN t.lon - 0.12 AND t.lon + 0.12 WHERE type_code <> 8 AND (emitter_category = 'A7' OR type_code NOT IN (4, 7)) AND (alt_baro IS NULL OR alt_baro <= 1000)),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY heli DESC, m, id) AS rk FROM pairs WHERE m <= 5000)"""


@query(f"WITH {NEAREST} SELECT t.event_id, b.id AS airport_id, round(b.m, 2) AS airport_m FROM tracks t LEFT JOIN best b ON b.event_id = t.event_id AND b.rk = 1")
def j02_nearest_airport(spark, sf_dir):
    rows = view(spark, sf_dir, "tracks").select(F.col("event_id").alias("key"), "lat", "lon", "emitter_category", F.col("alt_baro").alias("agl"))
    return enrich.nearest_airport(rows, view(spark, sf_dir, "airports")).select(F.col("key").alias("event_id"), "airport_id", F.round("airport_m", 2).alias("airport_m"))


@query(f"""WITH {FLIGHT}, {AIRPORTS}, ends AS (SELECT icao24, start_t, 's' AS e, start_lon AS lon, start_lat AS lat, emitter_category FROM flights UNION ALL SELECT icao24, start_t, 'e', end_lon, end_lat, emitter_category FROM flights),
pairs AS (SELECT n.icao24, start_t, e, id, {hav('n.lat', 'n.lon', 'a.lat', 'a.lon')} AS m, type_code IN (4, 7) AS heli FROM ends n JOIN airports a ON abs(a.lat - n.lat) < 0.05 AND abs(a.lon - n.lon) < 0.12 WHERE type_code <> 8 AND (emitter_category = 'A7' OR type_code NOT IN (4, 7))),
best AS (SELECT *, row_number() OVER (PARTITION BY icao24, start_t, e ORDER BY heli DESC, m, id) AS rk FROM pairs WHERE m <= 5000)
SELECT f.icao24, f.start_t, s.id AS start_airport, d.id AS end_airport FROM flights f LEFT JOIN best s ON s.icao24 = f.icao24 AND s.start_t = f.start_t AND s.e = 's' AND s.rk = 1 LEFT JOIN best d ON d.icao24 = f.icao24 AND d.start_t = f.start_t AND d.e = 'e' AND d.rk = 1""")
def j03_flight_airports(spark, sf_dir):
    rows = enrich.with_airports(raw_flights(spark, sf_dir), view(spark, sf_dir, "airports"))
    return rows.select("icao24", "start_t", F.col("start_airport_ident").alias("start_airport"), F.col("end_airport_ident").alias("end_airport"))


@query(f"WITH {TRACKS}, {SPACES} SELECT event_id, id AS airspace_id, type_code FROM tracks t JOIN airspaces a ON t.lon > min_lon AND t.lon < max_lon AND t.lat > min_lat AND t.lat < max_lat")
def j04_reports_in_airspaces(spark, sf_dir):
    rows = view(spark, sf_dir, "tracks").select("event_id", "lon", "lat")
    return lookups.containing(rows, view(spark, sf_dir, "airspaces")).select("event_id", F.col("id").alias("airspace_id"), "type_code")


@query(f"""WITH {TRACKS}, {SPACES}, d AS (SELECT event_id, id, greatest(0, min_lon - t.lon, t.lon - max_lon) * cos(radians(t.lat)) * 111320.0 AS dx, greatest(0, min_lat - t.lat, t.lat - max_lat) * 111320.0 AS dy FROM tracks t JOIN airspaces a
  ON t.lon > min_lon - 0.5 AND t.lon < max_lon + 0.5 AND t.lat > min_lat - 0.5 AND t.lat < max_lat + 0.5 WHERE type_code = 13)
SELECT event_id, id AS airspace_id, round(sqrt(dx * dx + dy * dy), 1) AS distance_m FROM d WHERE sqrt(dx * dx + dy * dy) <= 10000""")
def j05_airspaces_near_reports(spark, sf_dir):
    rows = view(spark, sf_dir, "tracks").select("event_id", "lon", "lat")
    near = lookups.near(rows, view(spark, sf_dir, "airspaces").where("type_code = 13"), 10.0)
    return near.select("event_id", F.col("id").alias("airspace_id"), F.round("distance_m", 1).alias("distance_m"))


@query(f"WITH {AIRPORTS}, {SPACES} SELECT p.id AS airport_id, a.id AS airspace_id, CASE a.type_code WHEN 13 THEN 'ATZ' WHEN 4 THEN 'CTR' END AS type FROM airports p JOIN airspaces a ON a.type_code IN (4, 13, 14) AND p.lon > min_lon AND p.lon < max_lon AND p.lat > min_lat AND p.lat < max_lat")
def j06_airport_airspaces(spark, sf_dir):
    rows = lookups.aerodrome_airspaces(view(spark, sf_dir, "airports"), view(spark, sf_dir, "airspaces"))
    return rows.select(F.col("id").alias("airport_id"), F.explode("airspaces").alias("a")).select("airport_id", F.col("a.id").alias("airspace_id"), F.col("a.type").alias("type"))


@query(f"WITH {LEGS} SELECT f.event_id, max(g.t) AS last_t, arg_max(g.squawk, g.t) AS squawk FROM legs f JOIN legs g ON g.icao24 = f.icao24 AND g.leg = f.leg AND g.t <= f.t AND g.squawk IS NOT NULL GROUP BY f.event_id")
def j07_squawk_as_of(spark, sf_dir):
    """The last code at or before each report of its leg: an as-of join, as a running window."""
    rows = legs(spark, sf_dir).withColumn("known", F.when(F.col("squawk").isNotNull(), F.struct("t", "squawk")))
    return fl.filled_forward(rows, "known", ["icao24", "leg"], ["t", "seq"]).where("known IS NOT NULL").select(F.col("seq").alias("event_id"), F.col("known.t").alias("last_t"), F.col("known.squawk").alias("squawk"))


TYPED = f"{FLIGHT}, {FRAMES}, typed AS (SELECT f.*, a.icao_type FROM flights f JOIN airframes a USING (icao24)), best AS (SELECT icao_type, model FROM (SELECT icao_type, model, row_number() OVER (PARTITION BY icao_type ORDER BY count(*) DESC, model) AS rk FROM airframes GROUP BY 1, 2) WHERE rk = 1)"


def typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames = view(spark, sf_dir, "airframes")
    rows = lookups.with_airframes(raw_flights(spark, sf_dir).drop("icao_type"), frames)
    return rows.withColumn("icao_type", F.col("af.icao_type")), frames


# --- predicates ----------------------------------------------------------------------------------------------------


def chosen(match: P.Predicate) -> Query:
    return lambda spark, sf_dir: Engine.of_table(spark, flights_path(spark, sf_dir), airframes=view(spark, sf_dir, "airframes")).select(match).select("icao24", "start_t")


def moment(seconds: float) -> datetime:
    return datetime.fromtimestamp(T0 + seconds, timezone.utc)


def nation_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse tiles of four by four pixels, one for each nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    grid = nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    tile = [(48 + F.col("n_nationkey") % 10).cast("int").alias("tile_lat"), (F.col("n_nationkey") % 20 - 5).cast("int").alias("tile_lon")]
    return grid.groupBy(*tile, F.floor(F.col("i") / 4).cast("int").alias("row"), (F.col("i") % 4).cast("int").alias("col")).agg(F.max(100 * (F.col("n_nationkey") + 1) + 10 * F.col("i")).alias("elev_ft"))


def high_path(spark: SparkSession, sf_dir: str) -> str:
    """Flights with their heights above the nations' tiles, at every vertex."""
    built = lambda: enrich.with_agl(raw_flights(spark, sf_dir), nation_dem(spark, sf_dir), reach_m=1e9, pixels=4, thin=False)
    return stored_path(spark, f"heights of {sf_dir}", lambda path: tables.upsert_flights(spark, path, built()), sources(sf_dir))


def level(match: P.Predicate) -> Query:
    return lambda spark, sf_dir: Engine.of_table(spark, high_path(spark, sf_dir)).select(match).select("icao24", "start_t")


def predicate(name: str, match: P.Predicate, where: str, ctes: str = FLIGHT, source: str = "flights f") -> None:
    QUERIES[name] = chosen(match) if not name.endswith(("_agl", "_agl_ever", "_agl_always")) else level(match)
    SQL[name] = f"WITH {ctes} SELECT f.icao24, f.start_t FROM {source} WHERE {where}"


predicate("p01_callsign_prefix", P.CallsignPrefix("ba-w1"), "callsign LIKE 'BAW1%'")
predicate("p02_emitter_category", P.EmitterCategory(("a7",)), "emitter_category = 'A7'")
predicate("p03_icao24", P.Icao24(("400001", "400002 ", "40000A")), "f.icao24 IN ('400001', '400002', '40000a')")
predicate("p04_duration", P.Duration(600, 3000), "end_t - start_t BETWEEN 600 AND 3000")
predicate("p05_registration_prefix", P.RegistrationPrefix("G-MA"), "replace(upper(a.registration), '-', '') LIKE 'GMA%'", f"{FLIGHT}, {FRAMES}", "flights f JOIN airframes a USING (icao24)")
predicate("p06_and_or_not", (P.CallsignPrefix("RYR") & P.Duration(min_s=300)) | ~P.EmitterCategory(("A3",)), "(callsign LIKE 'RYR%' AND end_t - start_t >= 300) OR NOT (emitter_category = 'A3')")
predicate("p07_endpoint_in_box", P.EndpointWithin(geo.Polygon.of_box(*BOX), "both"), f"start_lon > {BOX[0]} AND start_lon < {BOX[2]} AND start_lat > {BOX[1]} AND start_lat < {BOX[3]} AND end_lon > {BOX[0]} AND end_lon < {BOX[2]} AND end_lat > {BOX[1]} AND end_lat < {BOX[3]}")
predicate("p08_endpoint_in_circle", P.EndpointWithin(CIRCLE, "either", start_from=moment(600)), f"(sqrt(power(start_lon - 2.0, 2) + power(start_lat - 53.0, 2)) <= {CIRCLE.radius_m / geo.DEGREE_M!r} AND start_t >= {T0 + 600}) OR sqrt(power(end_lon - 2.0, 2) + power(end_lat - 53.0, 2)) <= {CIRCLE.radius_m / geo.DEGREE_M!r}")
predicate("p09_time_window", P.Trajectory(time_from=moment(1000), time_to=moment(2000)), f"end_t >= {T0 + 1000} AND start_t < {T0 + 2000}")
predicate("p10_altitude_ever", P.Trajectory(altitude=P.Range(20, 60), unit="fl"), "max_alt >= 2000 AND min_alt <= 6000")
predicate("p11_altitude_always", P.Trajectory(mode="within", altitude=P.Range(1200, 9000)), "min_alt >= 1200 AND max_alt <= 9000")
predicate("p12_squawk_ever", P.Trajectory(squawk_codes=("7700",)), "emergency")
IN_BOX = f"""{VERTICES}, part AS (SELECT *, CASE WHEN lon1 = lon0 THEN CASE WHEN lon0 > {BOX[0]} AND lon0 < {BOX[2]} THEN 0.0 ELSE 2.0 END ELSE least(({BOX[0]} - lon0) / (lon1 - lon0), ({BOX[2]} - lon0) / (lon1 - lon0)) END AS xa,
  CASE WHEN lon1 = lon0 THEN 1.0 ELSE greatest(({BOX[0]} - lon0) / (lon1 - lon0), ({BOX[2]} - lon0) / (lon1 - lon0)) END AS xb,
  CASE WHEN lat1 = lat0 THEN CASE WHEN lat0 > {BOX[1]} AND lat0 < {BOX[3]} THEN 0.0 ELSE 2.0 END ELSE least(({BOX[1]} - lat0) / (lat1 - lat0), ({BOX[3]} - lat0) / (lat1 - lat0)) END AS ya,
  CASE WHEN lat1 = lat0 THEN 1.0 ELSE greatest(({BOX[1]} - lat0) / (lat1 - lat0), ({BOX[3]} - lat0) / (lat1 - lat0)) END AS yb FROM segs),
cut AS (SELECT *, greatest(0.0, xa, ya) AS a, least(1.0, xb, yb) AS b FROM part)"""
predicate("p13_meets_box", P.Trajectory(geo.Polygon.of_box(*BOX)), "EXISTS (SELECT 1 FROM cut c WHERE c.icao24 = f.icao24 AND c.leg = f.leg AND c.part = c.part0 AND c.b >= c.a)", IN_BOX, "started f")
predicate("p14_stays_in_box", P.Trajectory(geo.Polygon.of_box(*BOX), mode="within"), f"NOT EXISTS (SELECT 1 FROM vertices v WHERE v.icao24 = f.icao24 AND v.leg = f.leg AND NOT (lon > {BOX[0]} AND lon < {BOX[2]} AND lat > {BOX[1]} AND lat < {BOX[3]}))", VERTICES, "started f")
predicate("p15_dwell_in_box", P.Trajectory(geo.Polygon.of_box(*BOX), dwell_s=P.Range(min=700)), "f.end_t - f.start_t >= 700 AND (SELECT sum((t1 - t0) * greatest(0, b - a)) FROM cut c WHERE c.icao24 = f.icao24 AND c.leg = f.leg) >= 700 AND EXISTS (SELECT 1 FROM cut c WHERE c.icao24 = f.icao24 AND c.leg = f.leg AND c.part = c.part0 AND c.b >= c.a)", IN_BOX, "started f")
BAND = f"""{VERTICES}, band AS (SELECT *, CASE WHEN z1 = z0 THEN CASE WHEN z0 BETWEEN 3000 AND 8000 THEN 0.0 ELSE 2.0 END ELSE greatest(0.0, least((3000 - z0) / (z1 - z0), (8000 - z0) / (z1 - z0))) END AS a,
  CASE WHEN z1 = z0 THEN 1.0 ELSE least(1.0, greatest((3000 - z0) / (z1 - z0), (8000 - z0) / (z1 - z0))) END AS b FROM segs),
ranged AS (SELECT icao24, leg, min(alt_baro) AS lo, max(alt_baro) AS hi FROM vertices GROUP BY 1, 2)"""
predicate("p16_dwell_in_band", P.Trajectory(altitude=P.Range(3000, 8000), dwell_s=P.Range(min=300)), "f.end_t - f.start_t >= 300 AND hi >= 3000 AND lo <= 8000 AND (SELECT sum((t1 - t0) * greatest(0, b - a)) FROM band c WHERE c.icao24 = f.icao24 AND c.leg = f.leg) >= 300", BAND, "started f JOIN ranged USING (icao24, leg)")
predicate("p17_whole_distance", P.Trajectory(distance_m=P.Range(20_000, 90_000)), "(SELECT CAST(sum(m) AS FLOAT) FROM lengths c WHERE c.icao24 = f.icao24 AND c.leg = f.leg) BETWEEN 20000 AND 90000", LENGTHS, "started f")
predicate("p18_box_and_band", P.Trajectory(geo.Polygon.of_box(*BOX), altitude=P.Range(3000, 8000)), "EXISTS (SELECT 1 FROM cut c WHERE c.icao24 = f.icao24 AND c.leg = f.leg AND c.part = c.part0 AND least(c.b, CASE WHEN z1 = z0 THEN 1.0 ELSE greatest((3000 - z0) / (z1 - z0), (8000 - z0) / (z1 - z0)) END) > greatest(c.a, CASE WHEN z1 = z0 THEN CASE WHEN z0 BETWEEN 3000 AND 8000 THEN 0.0 ELSE 2.0 END ELSE least((3000 - z0) / (z1 - z0), (8000 - z0) / (z1 - z0)) END))", IN_BOX, "started f")


TERRAIN = """grid AS (SELECT n_nationkey, range AS i FROM nation, range(16)),
dem AS (SELECT CAST(48 + n_nationkey % 10 AS INT) AS tile_lat, CAST(n_nationkey % 20 - 5 AS INT) AS tile_lon, CAST(i // 4 AS INT) AS r, CAST(i % 4 AS INT) AS c, max(100 * (n_nationkey + 1) + 10 * i) AS elev FROM grid GROUP BY 1, 2, 3, 4),
pixel AS (SELECT event_id, CAST(floor(lat) AS INT) AS ty, CAST(floor(lon) AS INT) AS tx, greatest(0.0, least(3.0, (1.0 - (lat - floor(lat))) * 4 - 0.5)) AS fr, greatest(0.0, least(3.0, (lon - floor(lon)) * 4 - 0.5)) AS fc FROM tracks),
weighed AS (SELECT event_id, ty, tx, least(floor(fr) + a, 3) AS r, least(floor(fc) + b, 3) AS c, CASE WHEN a = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE WHEN b = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS wt
  FROM pixel, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
terrain AS (SELECT event_id, coalesce(sum(wt * elev), 0) AS terrain_ft FROM weighed w LEFT JOIN dem d ON d.tile_lat = ty AND d.tile_lon = tx AND d.r = w.r AND d.c = w.c GROUP BY event_id)"""
HIGH = f"""{IN_BOX}, {TERRAIN}, high AS (SELECT icao24, leg, t, round(alt_baro - terrain_ft, 4) AS agl FROM vertices JOIN terrain USING (event_id)),
heights AS (SELECT icao24, leg, min(agl) AS lowest, max(agl) AS highest FROM high GROUP BY 1, 2)"""
INSIDE_HIGH = """EXISTS (SELECT 1 FROM (SELECT c.*, x.agl AS h0, y.agl AS h1 FROM cut c JOIN high x ON x.icao24 = c.icao24 AND x.leg = c.leg AND x.t = c.t0 JOIN high y ON y.icao24 = c.icao24 AND y.leg = c.leg AND y.t = c.t1) c
  WHERE c.icao24 = f.icao24 AND c.leg = f.leg AND c.part = c.part0 AND least(c.b, CASE WHEN h1 = h0 THEN 1.0 ELSE greatest((4000 - h0) / (h1 - h0), (6000 - h0) / (h1 - h0)) END)
    > greatest(c.a, CASE WHEN h1 = h0 THEN CASE WHEN h0 BETWEEN 4000 AND 6000 THEN 0.0 ELSE 2.0 END ELSE least((4000 - h0) / (h1 - h0), (6000 - h0) / (h1 - h0)) END))"""
predicate("p21_box_and_agl", P.Trajectory(geo.Polygon.of_box(*BOX), agl_ft=P.Range(4000, 6000)), INSIDE_HIGH, HIGH, "started f")
predicate("p22_agl_ever", P.Trajectory(agl_ft=P.Range(min=5_000)), "highest >= 5000", HIGH, "started f JOIN heights USING (icao24, leg)")
predicate("p23_agl_always", P.Trajectory(mode="within", agl_ft=P.Range(min=400)), "lowest >= 400", HIGH, "started f JOIN heights USING (icao24, leg)")
FAR = f"""{IN_BOX}, pieces AS (SELECT icao24, leg, lon0 + (lon1 - lon0) * a AS lon0, lat0 + (lat1 - lat0) * a AS lat0, lon0 + (lon1 - lon0) * b AS lon1, lat0 + (lat1 - lat0) * b AS lat1 FROM cut WHERE b > a),
{geodesic_sql('pieces', 'icao24, leg', 'inside')}, spanned AS (SELECT icao24, leg, sum(m) AS metres FROM inside GROUP BY 1, 2)"""
MEETS = "EXISTS (SELECT 1 FROM cut c WHERE c.icao24 = f.icao24 AND c.leg = f.leg AND c.part = c.part0 AND c.b >= c.a)"
predicate("p26_distance_in_box", P.Trajectory(geo.Polygon.of_box(*BOX), distance_m=P.Range(100_000, 600_000)), f"metres BETWEEN 100000 AND 600000 AND {MEETS}", FAR, "started f JOIN spanned USING (icao24, leg)")
CODED = f"""{IN_BOX}, known AS (SELECT icao24, leg, t, last_value(squawk IGNORE NULLS) OVER (PARTITION BY icao24, leg, part ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code FROM vertices)"""
predicate("p24_squawk_in_box", P.Trajectory(geo.Polygon.of_box(*BOX), squawk_codes=("7700",)), "EXISTS (SELECT 1 FROM cut c JOIN known x ON x.icao24 = c.icao24 AND x.leg = c.leg AND x.t = c.t0 JOIN known y ON y.icao24 = c.icao24 AND y.leg = c.leg AND y.t = c.t1 WHERE c.icao24 = f.icao24 AND c.leg = f.leg AND c.part = c.part0 AND c.b >= c.a AND (x.code = '7700' OR (y.code = '7700' AND c.b >= 1)))", CODED, "started f")


@query(f"WITH {TYPED} SELECT icao24, start_t, icao_type FROM typed WHERE icao_type IN ('B738', 'C172')")
def p25_icao_type(spark, sf_dir):
    rows, _ = typed(spark, sf_dir)
    return Engine(rows).select(P.IcaoType(("b-738", "C172"))).select("icao24", "start_t", "icao_type")


@query(f"WITH {IN_BOX} SELECT icao24, start_t, round(sum((t1 - t0) * greatest(0, b - a)), 3) AS dwell_s, round(sum(CASE WHEN part = part0 THEN (t1 - t0) * greatest(0, b - a) ELSE 0 END), 3) AS observed_s FROM started JOIN cut USING (icao24, leg) GROUP BY icao24, start_t")
def g01_time_in_box(spark, sf_dir):
    """Seconds inside a box, over the stitched path and over the observed stretches only."""
    shape = geo.Polygon.of_box(*BOX)
    took = lambda stitched: r3(S.duration_s(S.clip(F.col("path"), shape, stitched=stitched)))
    return raw_flights(spark, sf_dir).select("icao24", "start_t", took(True).alias("dwell_s"), took(False).alias("observed_s"))


@query(f"""WITH {VERTICES}, q AS (SELECT *, (lon0 - 2.0) * kx AS px, (lat0 - 53.0) * ky AS py, (lon1 - lon0) * kx AS vx, (lat1 - lat0) * ky AS vy FROM segs, (SELECT {S._metres_per_degree(53.0)[0]!r} AS kx, {S._metres_per_degree(53.0)[1]!r} AS ky)),
abc AS (SELECT *, vx * vx + vy * vy AS qa, 2 * (px * vx + py * vy) AS qb, px * px + py * py - {CIRCLE.radius_m**2!r} AS qc FROM q),
cut AS (SELECT *, CASE WHEN qa = 0 THEN CASE WHEN qc <= 0 THEN 0.0 ELSE 2.0 END WHEN qb * qb < 4 * qa * qc THEN 2.0 ELSE (-qb - sqrt(greatest(0, qb * qb - 4 * qa * qc))) / (2 * qa) END AS a,
  CASE WHEN qa = 0 THEN 1.0 ELSE (-qb + sqrt(greatest(0, qb * qb - 4 * qa * qc))) / (2 * qa) END AS b FROM abc)
SELECT icao24, start_t, round(sum((t1 - t0) * greatest(0, least(1, b) - greatest(0, a))), 2) AS dwell_s FROM started JOIN cut USING (icao24, leg) GROUP BY icao24, start_t""")
def g02_time_in_circle(spark, sf_dir):
    return raw_flights(spark, sf_dir).select("icao24", "start_t", F.round(S.duration_s(S.clip(F.col("path"), CIRCLE)), 2).alias("dwell_s"))


@query(f"WITH {VERTICES} SELECT icao24, start_t, round(sum(greatest(0, least(t1, {T0 + 2000}) - greatest(t0, {T0 + 1000}))), 3) AS seconds FROM started JOIN segs USING (icao24, leg) GROUP BY icao24, start_t")
def g03_time_in_window(spark, sf_dir):
    return raw_flights(spark, sf_dir).select("icao24", "start_t", r3(S.duration_s(S.clip(F.col("path"), t_from=T0 + 1000, t_to=T0 + 2000))).alias("seconds"))


@query(f"WITH {VERTICES} SELECT s.icao24, s.start_t, arg_max(v.squawk, v.t) AS squawk FROM started s LEFT JOIN vertices v ON v.icao24 = s.icao24 AND v.leg = s.leg AND v.t <= {T0 + 1500} AND v.squawk IS NOT NULL GROUP BY s.icao24, s.start_t")
def g04_squawk_at_instant(spark, sf_dir):
    return raw_flights(spark, sf_dir).select("icao24", "start_t", S.step_at(F.col("squawk_seq"), T0 + 1500).alias("squawk"))


@query(f"WITH {TRACKS} SELECT event_id, round({hav('lat', 'lon', '53.0', '2.0')}, 2) AS metres, {hav('lat', 'lon', '53.0', '2.0')} / 1852 <= 100 AS within_100_nm FROM tracks")
def g05_distance_to_point(spark, sf_dir):
    far = geo.haversine(F.col("lat"), F.col("lon"), 53.0, 2.0)
    return view(spark, sf_dir, "tracks").select("event_id", F.round(far, 2).alias("metres"), (far / geo.NM_M <= 100).alias("within_100_nm"))


# --- rollups, sorting, lookups ---------------------------------------------------------------------------------------

@query(f"WITH {TYPED} SELECT CAST({STAMP.format('start_t')} AS DATE) AS day, t.icao_type, b.model, count(*) AS flight_count FROM typed t LEFT JOIN best b USING (icao_type) GROUP BY 1, 2, 3")
def a01_type_stats(spark, sf_dir):
    return rollups.type_stats(*typed(spark, sf_dir))


@query(f"WITH {TYPED} SELECT t.icao_type, b.model, CAST(count(*) AS BIGINT) AS flight_count FROM typed t LEFT JOIN best b USING (icao_type) GROUP BY 1, 2")
def a02_type_counts(spark, sf_dir):
    return rollups.type_counts(rollups.type_stats(*typed(spark, sf_dir)), "2024-01-01", "2024-01-07").select("icao_type", "model", "flight_count")


@query(f"WITH {FLIGHT} SELECT CAST(min({STAMP.format('start_t')}) AS DATE) AS min_date, CAST(max({STAMP.format('end_t')}) AS DATE) AS max_date FROM flights")
def a03_data_range(spark, sf_dir):
    return rollups.data_range(raw_flights(spark, sf_dir))


@query(f"WITH {FLIGHT} SELECT {STAMP.format('min(start_t)')} AS first_start, {STAMP.format('max(start_t)')} AS last_start FROM flights")
def a04_bounds(spark, sf_dir):
    out = rollups.bounds(raw_flights(spark, sf_dir))
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in out.columns])


@query(f"WITH {FLIGHT} SELECT (SELECT count(DISTINCT icao24) FROM dedup) AS aircraft, (SELECT count(*) FROM dedup) AS reports, (SELECT count(*) FROM flights) AS flights, CAST(0 AS BIGINT) AS dropped")
def a05_batch_counts(spark, sf_dir):
    return rollups.batch_counts(fl.deduplicated(points(spark, sf_dir)), raw_flights(spark, sf_dir)).withColumn("dropped", F.col("dropped").cast("long"))


@query(f"WITH {FLIGHT} SELECT icao24, start_t, callsign FROM flights ORDER BY start_t DESC, icao24 DESC LIMIT 201")
def l01_newest_flights(spark, sf_dir):
    return raw_flights(spark, sf_dir).orderBy(F.desc("start_ts"), F.desc("icao24")).limit(201).select("icao24", "start_t", "callsign")


@query(f"WITH {FLIGHT} SELECT icao24, start_t FROM flights WHERE start_t < {T0 + 2000} OR (start_t = {T0 + 2000} AND icao24 < '400100') ORDER BY start_t DESC, icao24 DESC LIMIT 100")
def l02_next_page(spark, sf_dir):
    rows = raw_flights(spark, sf_dir).where(before(moment(2000), "400100"))
    return rows.orderBy(F.desc("start_ts"), F.desc("icao24")).limit(100).select("icao24", "start_t")


@query(f"WITH {AIRPORTS}, {SPACES} SELECT id, kind, name FROM (SELECT id, kind, name, 0 AS o FROM airports WHERE type_code <> 8 AND lower(name) LIKE 'nation_1%' UNION ALL SELECT id, 'airspace', name, 3 FROM airspaces WHERE lower(name) LIKE 'nation_1%') ORDER BY o, name, id LIMIT 20")
def r01_search(spark, sf_dir):
    return lookups.search(view(spark, sf_dir, "airports"), view(spark, sf_dir, "airspaces"), "nation_1", limit=20).select("id", "kind", "name")


@query(f"WITH {VERTICES} SELECT s.icao24, s.start_t, g.t0, g.t1, g.lon0, g.lat0, g.lon1, g.lat1, g.z0 AS alt0, g.z1 AS alt1, (g.z0 + g.z1) / 2 AS alt_mid FROM started s JOIN segs g USING (icao24, leg) WHERE g.part = g.part0")
def r02_segments(spark, sf_dir):
    rows = profiles.segment_table(raw_flights(spark, sf_dir).withColumn("start_ts", F.col("start_t")))
    return rows.select("icao24", F.col("start_ts").alias("start_t"), "t0", "t1", "lon0", "lat0", "lon1", "lat1", "alt0", "alt1", "alt_mid")


@query(f"WITH {VERTICES} SELECT s.icao24, s.start_t, v.t, v.alt_baro AS alt FROM started s JOIN vertices v USING (icao24, leg)")
def r03_height_profile(spark, sf_dir):
    rows = profiles.height_profile(raw_flights(spark, sf_dir).withColumn("start_ts", F.col("start_t")))
    return rows.select("icao24", F.col("start_ts").alias("start_t"), "t", "alt")


@query(f"WITH {FLIGHT} SELECT icao24, start_t, round({hav('start_lat', 'start_lon', 'end_lat', 'end_lon')} / 1852, 3) AS straight_nm, round(end_t - start_t, 3) AS duration_s, CAST({STAMP.format('start_t')} AS DATE) AS day FROM flights")
def r04_flight_cards(spark, sf_dir):
    rows = raw_flights(spark, sf_dir)
    cards = profiles.cards(rows.withColumns({"start_ts": F.col("start_ts")}))
    return cards.join(rows.select("icao24", "start_ts", "start_t"), ["icao24", "start_ts"]).select("icao24", "start_t", r3(F.col("straight_nm")).alias("straight_nm"), r3(F.col("duration_s")).alias("duration_s"), "day")


CLOSEST = f"""{VERTICES}, turned AS (SELECT *, cos(radians(lat0)) AS kk FROM segs WHERE part = part0),
along AS (SELECT *, CASE WHEN lon1 = lon0 AND lat1 = lat0 THEN 0.0 ELSE least(1.0, greatest(0.0, ((2.0 - lon0) * kk * ((lon1 - lon0) * kk) + (53.0 - lat0) * (lat1 - lat0)) / (power((lon1 - lon0) * kk, 2) + power(lat1 - lat0, 2)))) END AS u FROM turned),
near AS (SELECT icao24, leg, t0 + (t1 - t0) * u AS at_t, z0 + (z1 - z0) * u AS alt, lon0 + (lon1 - lon0) * u AS lon0, lat0 + (lat1 - lat0) * u AS lat0, CAST(2.0 AS DOUBLE) AS lon1, CAST(53.0 AS DOUBLE) AS lat1 FROM along),
{geodesic_sql('near', 'icao24, leg, at_t, alt', 'reached')}"""


@query(f"WITH {CLOSEST} SELECT s.icao24, {STAMP.format('start_t')} AS start_ts, round(m, 1) AS distance_m, round(alt, 1) AS alt FROM (SELECT *, row_number() OVER (PARTITION BY icao24, leg ORDER BY m, at_t, alt) AS rk FROM reached) r JOIN started s USING (icao24, leg) WHERE rk = 1")
def r05_closest_approach(spark, sf_dir):
    rows = profiles.closest_approach(raw_flights(spark, sf_dir), 2.0, 53.0)
    return rows.select("icao24", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.round("distance_m", 1).alias("distance_m"), F.round("alt", 1).alias("alt"))


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query(f"WITH {TRACKS} SELECT icao24, t, lat, lon, alt_baro, squawk, callsign, emitter_category, new_leg FROM tracks")
def s01_traces_parsed(spark, sf_dir):
    """Reports written as trace documents, several for each aircraft, and read back by the trace reader."""
    rows = view(spark, sf_dir, "tracks")
    extra = F.to_json(F.struct(F.concat(F.col("callsign"), F.lit(" ")).alias("flight"), F.col("squawk"), F.col("emitter_category").alias("category")))
    number = lambda c, missing="null": F.coalesce(F.col(c).cast("string"), F.lit(missing))
    entry = F.concat(F.lit("["), F.concat_ws(",", number("t"), number("lat"), number("lon"), number("alt_baro", '"ground"'), F.lit("null"), F.lit("null"), F.when(F.col("new_leg"), "2").otherwise("0"), F.lit("null"), extra), F.lit("]"))
    docs = rows.withColumn("entry", entry).groupBy("icao24", F.pmod(F.xxhash64("event_id"), F.lit(8)).alias("part")).agg(F.concat_ws(",", F.collect_list("entry")).alias("trace"))
    body = F.concat(F.lit('{"icao":"'), F.upper("icao24"), F.lit('","timestamp":0,"trace":['), F.col("trace"), F.lit("]}"))
    raw = docs.select(F.lit("trace.json").alias("name"), body.alias("body"), F.to_date(F.lit("2024-01-01")).alias("batch_date"))
    return traces.points(raw).select("icao24", "t", "lat", "lon", "alt_baro", "squawk", "callsign", "emitter_category", "new_leg")


@query(f"""WITH {VERTICES}, {FRAMES} SELECT s.icao24, s.start_t, CAST(dense_rank() OVER (PARTITION BY s.icao24, s.start_t ORDER BY part) - 1 AS INT) AS seq, CAST(row_number() OVER (PARTITION BY s.icao24, s.start_t, part ORDER BY t) - 1 AS INT) AS point_idx,
  CAST(CAST(CAST(lon AS VARCHAR) AS DECIMAL(18, 6)) AS VARCHAR) AS longitude, CAST(CAST(CAST(lat AS VARCHAR) AS DECIMAL(18, 6)) AS VARCHAR) AS latitude, alt_baro AS altitude_ft,
  registration, model, strftime({STAMP.format('s.start_t')}, '%Y-%m-%dT%H:%M:%S.%gZ') AS start_ts, strftime({STAMP.format('s.end_t')}, '%Y-%m-%dT%H:%M:%S.%gZ') AS end_ts, strftime({STAMP.format('t')}, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp_utc
  FROM started s JOIN vertices v USING (icao24, leg) LEFT JOIN airframes a ON a.icao24 = s.icao24""")
def w01_csv_lines(spark, sf_dir):
    rows = lookups.with_airframes(raw_flights(spark, sf_dir), view(spark, sf_dir, "airframes"))
    lines = exports.csv_lines(rows.withColumn("callsign", F.col("start_t").cast("string")))
    return lines.select("icao24", F.col("callsign").cast("double").alias("start_t"), "seq", "point_idx", "longitude", "latitude", "altitude_ft", "registration", "model", "start_ts", "end_ts", "timestamp_utc")


PLACES = "CAST(CAST(CAST({} AS VARCHAR) AS DECIMAL(18, 6)) AS VARCHAR)"
WRITTEN = f"""{VERTICES}, written AS (SELECT icao24, leg, CAST(count(*) AS INT) AS n_points, CAST(count(DISTINCT part) AS INT) AS n_parts,
  string_agg({PLACES.format('lon')}, ' ' ORDER BY t) AS lons, string_agg({PLACES.format('lat')}, ' ' ORDER BY t) AS lats,
  string_agg(CAST(CAST(CAST(alt_baro * CAST(0.3048 AS DOUBLE) AS VARCHAR) AS DECIMAL(18, 1)) AS VARCHAR), ' ' ORDER BY t) AS heights_m,
  string_agg(strftime(make_timestamp(CAST(round(t * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ'), ' ' ORDER BY t) AS instants FROM vertices GROUP BY 1, 2)"""


@query(f"""WITH {VERTICES}, {FRAMES} SELECT s.icao24, s.start_t, CAST(dense_rank() OVER (PARTITION BY s.icao24, s.start_t ORDER BY part) - 1 AS INT) AS line, CAST(row_number() OVER (PARTITION BY s.icao24, s.start_t, part ORDER BY t) - 1 AS INT) AS place,
  CAST({PLACES.format('lon')} AS DOUBLE) AS lon, CAST({PLACES.format('lat')} AS DOUBLE) AS lat, CAST(alt_baro AS DOUBLE) AS alt, registration, model, strftime({STAMP.format('s.end_t')}, '%Y-%m-%dT%H:%M:%S.%gZ') AS end_ts FROM started s JOIN vertices v USING (icao24, leg) LEFT JOIN airframes a ON a.icao24 = s.icao24""")
def w02_geojson(spark, sf_dir):
    """Features written and read back, point by point."""
    rows = lookups.with_airframes(raw_flights(spark, sf_dir), view(spark, sf_dir, "airframes")).withColumn("callsign", F.col("start_t").cast("string"))
    back = F.from_json("value", "properties struct<icao24:string,callsign:string,registration:string,model:string,end_ts:string>, geometry struct<coordinates:array<array<array<double>>>>")
    flight = [F.col("f.properties.icao24"), F.col("f.properties.callsign").cast("double").alias("start_t"), *[F.col(f"f.properties.{c}") for c in ("registration", "model", "end_ts")]]
    out = exports.geojson_features(rows).select(back.alias("f")).select(*flight, F.posexplode("f.geometry.coordinates").alias("line", "points"))
    out = out.select("*", F.posexplode("points").alias("place", "p")).drop("points")
    return out.select("*", *[F.col("p")[k].alias(c) for k, c in enumerate(("lon", "lat", "alt"))]).drop("p")


def _read_back(lines: DataFrame, lons: Column, lats: Column, heights: Column, instants: Column, part: str, point: str) -> DataFrame:
    name = F.regexp_extract("value", "<name>(.*?)</name>", 1)
    return lines.select(F.split_part(name, F.lit("|"), F.lit(1)).alias("icao24"), F.split_part(name, F.lit("|"), F.lit(2)).cast("double").alias("start_t"), F.regexp_count("value", F.lit(part)).alias("n_parts"), F.regexp_count("value", F.lit(point)).alias("n_points"), *[F.array_join(v, " ").alias(n) for n, v in (("lons", lons), ("lats", lats), ("heights_m", heights), ("instants", instants))])


@query(f"WITH {WRITTEN} SELECT w.icao24, start_t, n_parts, n_points, lons, lats, heights_m, instants FROM written w JOIN started USING (icao24, leg)")
def w03_gpx(spark, sf_dir):
    rows = raw_flights(spark, sf_dir).withColumn("callsign", F.concat_ws("|", "icao24", F.col("start_t").cast("string")))
    values = lambda c: F.regexp_extract_all("value", F.lit(f' {c}="([^"]*)"'), F.lit(1))
    inner = lambda tag: F.regexp_extract_all("value", F.lit(f"<{tag}>([^<]*)</{tag}>"), F.lit(1))
    return _read_back(exports.gpx_tracks(rows), values("lon"), values("lat"), inner("ele"), inner("time"), "<trkseg>", "<trkpt ")


@query(f"WITH {WRITTEN} SELECT w.icao24, start_t, n_parts, n_points, lons, lats, heights_m, instants FROM written w JOIN started USING (icao24, leg)")
def w04_kml(spark, sf_dir):
    rows = raw_flights(spark, sf_dir).withColumn("callsign", F.concat_ws("|", "icao24", F.col("start_t").cast("string")))
    values = lambda k: F.regexp_extract_all("value", F.lit("<gx:coord>([^ ]*) ([^ ]*) ([^<]*)"), F.lit(k))
    instants = F.regexp_extract_all("value", F.lit("<when>([^<]*)</when>"), F.lit(1))
    return _read_back(exports.kml_placemarks(rows), values(1), values(2), values(3), instants, "<gx:Track>", "<gx:coord>")


@query(f"WITH {FLIGHT} SELECT CAST(date_trunc('week', {STAMP.format('start_t')}) AS DATE) AS start_week, count(*) AS row_count FROM flights GROUP BY 1")
def w05_week_manifest(spark, sf_dir):
    return writes.week_manifest(raw_flights(spark, sf_dir)).select("start_week", "row_count")


@query(f"WITH {FLIGHT}, old AS (SELECT icao24, start_t, raw_point_count FROM flights WHERE start_t < {T0 + 4000}), new AS (SELECT icao24, start_t, raw_point_count + 1000 AS raw_point_count FROM flights WHERE start_t >= {T0 + 2000}) SELECT icao24, start_t, CAST(raw_point_count AS INT) AS raw_point_count FROM new UNION ALL SELECT o.icao24, o.start_t, CAST(o.raw_point_count AS INT) FROM old o ANTI JOIN new n ON n.icao24 = o.icao24 AND n.start_t = o.start_t")
def w06_upserted(spark, sf_dir):
    rows = raw_flights(spark, sf_dir).select("icao24", "start_t", "raw_point_count")
    old, new = rows.where(F.col("start_t") < T0 + 4000), rows.where(F.col("start_t") >= T0 + 2000).withColumn("raw_point_count", (F.col("raw_point_count") + 1000).cast("int"))
    return writes.merged(old, new, key=["icao24", "start_t"])


@query(f"WITH {TRACKS}, {TERRAIN} SELECT event_id, round(terrain_ft, 3) AS terrain_ft, round(alt_baro - terrain_ft, 3) AS agl_ft FROM tracks JOIN terrain USING (event_id)")
def e01_height_above_terrain(spark, sf_dir):
    """Reports over the nations' tiles."""
    rows = enrich.terrain_at(view(spark, sf_dir, "tracks").select("event_id", "lat", "lon", "alt_baro"), nation_dem(spark, sf_dir), pixels=4)
    return rows.select("event_id", r3(F.col("terrain_ft")).alias("terrain_ft"), r3(F.col("alt_baro") - F.col("terrain_ft")).alias("agl_ft"))


@query(f"""WITH {TRACKS}
SELECT event_id, round((1000.0 + (SELECT min(n_regionkey) FROM nation) + 2 * (t - {T0!r}) / 3600 + 0.1 * lat + 0.05 * CASE WHEN lon >= 0 THEN lon ELSE 350 + (lon + 10) / 10 * (0 - 350) END - 1013.25) * 27.3, 3) AS correction_ft FROM tracks""")
def e02_pressure_correction(spark, sf_dir):
    """Reports in a pressure cube that is linear in each coordinate, so that interpolation gives it back; the seam is padded."""
    from ..sources.fields import pressure_cube

    base = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.min("n_regionkey").alias("r"))
    axes = base.select("r", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("h")).select("r", "h", F.explode(F.array(*map(F.lit, (-90, 0, 45, 90)))).alias("y")).select("r", "h", "y", F.explode(F.array(*map(F.lit, (0, 100, 200, 350)))).alias("x"))
    raw = axes.select((F.lit(T0) + 3600.0 * F.col("h")).alias("t"), F.col("y").cast("double").alias("lat"), F.col("x").cast("double").alias("lon"), (100 * (1000.0 + F.col("r") + 2 * F.col("h") + 0.1 * F.col("y") + 0.05 * F.col("x"))).alias("pressure"))
    rows = enrich.pressure_at(view(spark, sf_dir, "tracks").select("event_id", "t", "lat", "lon"), pressure_cube(raw))
    return rows.select("event_id", r3(enrich.correction_ft(F.col("hpa"))).alias("correction_ft"))


@query(f"WITH {TRACKS} SELECT event_id, icao24 || ':' || strftime({STAMP.format('floor(t)')}, '%Y-%m-%dT%H:%M:%SZ') AS flight_id, replace(upper(callsign), '-', '') AS callsign FROM tracks")
def x01_identifiers(spark, sf_dir):
    rows = view(spark, sf_dir, "tracks")
    return rows.select("event_id", text.flight_id(text.icao24(F.col("icao24")), F.timestamp_micros(F.floor(F.col("t")) * 1_000_000)).alias("flight_id"), text.norm(F.col("callsign")).alias("callsign"))


from . import catalog_parts, catalog_tables  # noqa: E402, F401  (they add their queries to these)
