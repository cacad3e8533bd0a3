"""Queries about single parts: readers of files, dimensions, fields, staging and states, series, labels, the stream."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions import series as S
from ..operators import enrich, lookups, rollups, tables, writes
from ..operators import flights as fl
from ..session import scratch_dir
from ..sources import fields, reference_data, traces
from ..sources.synthetic import view
from ..streaming import flights as stream
from . import daily
from . import predicates as P
from .catalog import AIRBORNE, AIRPORTS, BOX, FAR, FLIGHT, FRAMES, LEGS, LENGTHS, MEETS, SPACES, T0, TRACKS, VERTICES, chosen, legs, points, predicate, query, raw_flights


def folder(spark: SparkSession) -> str:
    """A new folder of the shared one, for files that a query writes and reads back."""
    return f"{scratch_dir(spark)}/skein-files-{uuid.uuid4().hex}"


# --- readers -------------------------------------------------------------------------------------------------------


@query(f"""WITH {TRACKS}, a AS (SELECT DISTINCT icao24, CAST('0x' || icao24 AS BIGINT) % 6 AS k FROM tracks)
SELECT icao24, CASE k WHEN 0 THEN 'not a trace' WHEN 1 THEN 'no icao' WHEN 2 THEN 'bad timestamp' WHEN 3 THEN 'trace is not a list' END AS bad FROM a WHERE k < 4""")
def s02_refused_traces(spark, sf_dir):
    """A trace document for each aircraft, four of six broken in some way: each is refused for its reason."""
    k = F.pmod(F.conv("icao24", 16, 10).cast("long"), F.lit(6))
    body = lambda icao, at, trace: F.concat(F.lit('{"icao":"'), icao, F.lit('","timestamp":'), F.lit(at), F.lit(',"trace":'), F.lit(trace), F.lit("}"))
    good = "[[1,50.0,1.0,1000]]"
    broken = F.when(k == 0, "{").when(k == 1, body(F.lit(" "), "5", good)).when(k == 2, body(F.col("icao24"), '"never"', good)).when(k == 3, body(F.col("icao24"), "5", '{"a":1}')).otherwise(body(F.col("icao24"), "5", good))
    raw = view(spark, sf_dir, "tracks").select("icao24").distinct().select(F.col("icao24").alias("name"), broken.alias("body"), F.to_date(F.lit("2024-01-01")).alias("batch_date"))
    return traces.rejects(raw).select(F.col("name").alias("icao24"), "bad")


@query(f"""WITH {FRAMES} SELECT icao24, registration, icao_type, CAST((CASE WHEN year % 2 = 1 THEN 1 ELSE 0 END) + (CASE WHEN year % 3 = 0 THEN 8 ELSE 0 END) AS SMALLINT) AS flags, model, CAST(CASE WHEN year % 5 <> 0 THEN year END AS SMALLINT) AS year,
  CASE WHEN year % 7 <> 0 THEN 'Owner; ' || year END AS operator FROM airframes""")
def s03_airframe_lines(spark, sf_dir):
    """The airframes written as lines of a list (flag bits lowest first, unreadable years, blanks, escaped separators) and read back."""
    rows = view(spark, sf_dir, "airframes")
    bit = lambda n, k: F.when(F.col("year") % n == k, "1").otherwise("0")
    year = F.when(F.col("year") % 5 != 0, F.col("year").cast("string")).otherwise("n/a")
    owner = F.when(F.col("year") % 7 != 0, F.concat(F.lit("Owner\\; "), F.col("year").cast("string"))).otherwise(" ")
    line = F.concat_ws(";", F.upper("icao24"), "registration", "icao_type", F.concat(bit(2, 1), F.lit("00"), bit(3, 0)), "model", year, owner)
    path = folder(spark)
    rows.select(line.alias("value")).unionByName(rows.limit(1).select(F.lit("short;X;Y;0").alias("value"))).write.text(path)
    return reference_data.read_airframes(spark, path)


def _features(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Features of the nations, newline by newline, read back."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k, lon, lat = F.col("n_nationkey"), (F.col("n_nationkey") % 20 - 5).cast("double"), (48 + F.col("n_nationkey") % 10).cast("double")
    limit = lambda value, unit, ref: F.struct(value.cast("double").alias("value"), unit.cast("int").alias("unit"), ref.cast("int").alias("referenceDatum"))
    height = F.struct((k * 10 + 0.5).cast("double").alias("value"), (k % 3).cast("int").alias("unit"))
    ring = F.array(*[F.array(lon + dx, lat + dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    properties = {
        "apt": [F.lower(F.substring("n_name", 8, 2)).alias("icaoCode"), F.when(k % 2 == 0, " ").otherwise("xy").alias("iataCode"), height.alias("elevation")],
        "nav": [F.concat(F.lit("n"), k.cast("string")).alias("identifier"), F.struct(F.when(k % 4 == 0, "bad").otherwise((k * 100).cast("string")).alias("value"), (k % 3).cast("int").alias("unit")).alias("frequency"), height.alias("elevation")],
        "rpp": [(k % 2 == 0).alias("compulsory")],
        "asp": [(k % 9).cast("int").alias("icaoClass"), limit(k, k % 7, k % 4).alias("lowerLimit"), limit(k * 10, k % 2, F.lit(2)).alias("upperLimit")],
    }[kind]
    head = [F.when(k % 11 != 10, k.cast("string")).alias("_id"), F.col("n_name").alias("name"), (k % 9).cast("int").alias("type"), F.lit("ZZ").alias("country")]
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")) if kind == "asp" else F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    path = folder(spark)
    n.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*head, *properties).alias("properties"), shape.alias("geometry"))).alias("value")).write.text(path)
    return reference_data.read_features(spark, path, "*.txt")


HALF_EVEN = "CAST(round_even({}, 0) AS INT)"
NATION = "n AS (SELECT n_nationkey AS k, n_name, n_nationkey % 20 - 5.0 AS lon, 48.0 + n_nationkey % 10 AS lat FROM nation WHERE n_nationkey % 11 <> 10)"
ELEVATION = HALF_EVEN.format("CASE k % 3 WHEN 0 THEN CAST(k * 10 + 0.5 AS DOUBLE) * CAST(3.28084 AS DOUBLE) ELSE CAST(k * 10 + 0.5 AS DOUBLE) END")


@query(f"WITH {NATION} SELECT CAST(k AS VARCHAR) AS id, 'airport' AS kind, n_name AS name, upper(substr(n_name, 8, 2)) AS ident, CASE WHEN k % 2 = 1 THEN 'XY' END AS iata_code, CAST(k % 9 AS INT) AS type_code, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, {ELEVATION} AS elevation_ft FROM n")
def s04_airport_features(spark, sf_dir):
    """Airports as features: metres and feet, blank codes, features without an id."""
    return reference_data.airports(_features(spark, sf_dir, "apt")).select("id", "kind", "name", "ident", "iata_code", "type_code", "lon", "lat", "elevation_ft")


@query(f"WITH {NATION} SELECT CAST(k AS VARCHAR) AS id, 'N' || k AS ident, CASE WHEN k % 4 <> 0 THEN CAST(k * 100 AS DOUBLE) / CASE k % 3 WHEN 1 THEN 1000 ELSE 1 END END AS frequency_mhz, {ELEVATION} AS elevation_ft FROM n")
def s05_navaid_features(spark, sf_dir):
    """Navaids: frequencies in kHz or MHz, or unreadable."""
    return reference_data.navaids(_features(spark, sf_dir, "nav")).select("id", "ident", "frequency_mhz", "elevation_ft")


@query(f"WITH {NATION} SELECT CAST(k AS VARCHAR) AS id, 'reporting_point' AS kind, n_name AS name, k % 2 = 0 AS compulsory FROM n")
def s06_reporting_points(spark, sf_dir):
    return reference_data.reporting_points(_features(spark, sf_dir, "rpp")).select("id", "kind", "name", "compulsory")


@query(f"""WITH {NATION} SELECT CAST(k AS VARCHAR) AS id, CAST(k % 9 AS INT) AS type_code, CAST(k % 9 AS INT) AS icao_class, CAST(k AS DOUBLE) AS lower_value, CASE k % 7 WHEN 0 THEN 'm' WHEN 1 THEN 'ft' WHEN 6 THEN 'fl' END AS lower_unit,
  CASE k % 4 WHEN 0 THEN 'gnd' WHEN 2 THEN 'std' ELSE 'msl' END AS lower_ref, CAST(k * 10 AS DOUBLE) AS upper_value, CASE k % 2 WHEN 0 THEN 'm' ELSE 'ft' END AS upper_unit, 'std' AS upper_ref, CAST(lon AS DOUBLE) AS min_lon, CAST(lat + 1 AS DOUBLE) AS max_lat FROM n""")
def s07_airspace_features(spark, sf_dir):
    """Airspaces: single polygons lifted to several, limits with their codes decoded."""
    rows = lookups.airspace_edges(reference_data.airspaces(_features(spark, sf_dir, "asp")))
    sides = [c for s in ("lower", "upper") for c in (F.col(f"{s}_value"), text.limit_unit(F.col(f"{s}_unit")).alias(f"{s}_unit"), text.limit_reference(F.col(f"{s}_ref")).alias(f"{s}_ref"))]
    return rows.select("id", "type_code", "icao_class", *sides, "min_lon", "max_lat")


@query(f"""SELECT CAST(n_nationkey AS INT) AS tile_lat, CAST(i AS INT) AS row, CAST(least(32767, greatest(-32768, round_even(CASE WHEN (n_nationkey * 7919 + i * 131) % 13 = 0 THEN 0.0 ELSE ((n_nationkey * 7919 + i * 131) % 30000 - 15000) * CAST(3.28084 AS DOUBLE) END, 0))) AS SMALLINT) AS elev_ft
FROM nation, range(8) t(i)""")
def s08_terrain_in_feet(spark, sf_dir):
    """Metres to whole feet of 16 bits, no data to 0."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    seed = F.col("n_nationkey") * 7919 + F.col("i") * 131
    raw = n.select(F.col("n_nationkey").cast("int").alias("tile_lat"), F.lit(0).alias("tile_lon"), F.col("i").alias("row"), F.lit(0).alias("col"), F.when(seed % 13 == 0, -9999.0).otherwise((seed % 30000 - 15000).cast("double")).alias("elevation_m"))
    return fields.terrain_tiles(raw).select("tile_lat", "row", "elev_ft")


@query("""WITH raw AS (SELECT CAST(n_nationkey AS DOUBLE) AS t, CAST(x AS DOUBLE) AS lon, 100000.0 + n_nationkey * 10 + x AS pressure FROM nation, (SELECT unnest([0, 120, 240]) AS x))
SELECT t, lon, round(pressure / 100, 6) AS hpa FROM raw UNION ALL SELECT t, lon + 360, round(pressure / 100, 6) FROM raw WHERE lon = 0 UNION ALL SELECT t, lon - 360, round(pressure / 100, 6) FROM raw WHERE lon = 240""")
def s09_pressure_cube(spark, sf_dir):
    """Pascals to hectopascals, the seam padded on both sides."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(F.array(*map(F.lit, (0, 120, 240)))).alias("x"))
    raw = n.select(F.col("n_nationkey").cast("double").alias("t"), F.lit(0.0).alias("lat"), F.col("x").cast("double").alias("lon"), (100000.0 + F.col("n_nationkey") * 10 + F.col("x")).alias("pressure"))
    return fields.pressure_cube(raw).select("t", "lon", F.round("hpa", 6).alias("hpa"))


# --- staging, states, dimensions -------------------------------------------------------------------------------------


@query(f"WITH {LEGS}, {FRAMES} SELECT icao24, registration || CASE WHEN year % 2 = 0 THEN '-NEW' ELSE '' END AS registration FROM airframes WHERE year % 3 <> 0 OR year % 2 = 0")
def w09_dimension_upserted(spark, sf_dir):
    """Airframes of some years, and newer rows for others: by key, the new ones in place of the old."""
    rows = view(spark, sf_dir, "airframes")
    old, new = rows.where("year % 3 <> 0"), rows.where("year % 2 = 0").withColumn("registration", F.concat("registration", F.lit("-NEW")))
    return reference_data.upserted(old, new, "icao24").select("icao24", "registration")


@query(f"WITH {TRACKS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-01-02' END AS batch_date FROM tracks WHERE event_id % 2 = 1 OR event_id % 3 = 0")
def w10_staging_rewritten(spark, sf_dir):
    """Two days of staging; the first day's is written again with fewer rows, the other's stays."""
    rows = points(spark, sf_dir).select(F.col("seq").alias("event_id"), F.when(F.col("seq") % 2 == 0, F.lit("2024-01-01")).otherwise("2024-01-02").cast("date").alias("batch_date"))
    path = folder(spark)
    writes.write_staging(rows, path)
    writes.write_staging(rows.where("event_id % 2 = 0 AND event_id % 3 = 0"), path)
    return spark.read.parquet(path).select("event_id", "batch_date")


DAYS = "days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY 1), states AS (SELECT d AS batch_date, n AS flight_count, CASE WHEN k % 3 = 0 THEN 'errored' ELSE 'succeeded' END AS status FROM days)"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each order date, some of which failed; each was running before."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    per_day = orders.groupBy(F.col("o_orderdate").cast("date").alias("batch_date")).agg(F.count(F.lit(1)).alias("flight_count"), F.min("o_orderkey").alias("k"))
    status = F.when(F.col("k") % 3 == 0, "errored").otherwise("succeeded")
    ended = per_day.select("batch_date", status.alias("status"), "flight_count", F.date_add("batch_date", 1).cast("timestamp").alias("finished_at"))
    return ended.unionByName(per_day.select("batch_date", F.lit("running").alias("status"), F.lit(None).cast("long").alias("flight_count"), F.col("batch_date").cast("timestamp").alias("finished_at")))


@query(f"WITH {DAYS} SELECT batch_date, status, flight_count FROM states")
def a07_batch_states(spark, sf_dir):
    return writes.batch_states(batches(spark, sf_dir)).select("batch_date", "status", "flight_count")


@query(f"WITH {DAYS} SELECT max(CASE WHEN status = 'succeeded' THEN batch_date END) AS batch_date FROM states")
def a08_latest_success(spark, sf_dir):
    return rollups.latest_success(batches(spark, sf_dir))


@query(f"WITH {DAYS}, edge AS (SELECT greatest(max(CASE WHEN status = 'succeeded' THEN batch_date END), DATE '1998-08-02' - 40) AS e FROM states WHERE batch_date < DATE '1998-07-15') SELECT batch_date FROM states WHERE batch_date > (SELECT e FROM edge)")
def a09_pending_days(spark, sf_dir):
    """Landed days after the latest success of what is known up to mid-July: those that are still to be built."""
    known = batches(spark, sf_dir).where(F.col("batch_date") < F.lit(date(1998, 7, 15)))
    landed = batches(spark, sf_dir).select("batch_date").distinct()
    return daily.pending_days(landed, known, date(1998, 8, 2), 40)


@query(f"""WITH {DAYS}, weeks AS (SELECT DISTINCT CAST(date_trunc('week', batch_date) AS DATE) AS w FROM states), newest AS (SELECT max(batch_date) AS newest FROM states WHERE status = 'succeeded'),
last AS (SELECT CAST(date_trunc('week', batch_date - k) AS DATE) AS w, max(batch_date + 1) AS last_write FROM states, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE status = 'succeeded' GROUP BY 1),
held AS (SELECT w, w + CASE WHEN epoch(w) % 5 = 0 THEN 8 ELSE 12 END AS exported_at, CASE WHEN datediff('day', DATE '1990-01-01', w) % 3 = 0 THEN 'old' ELSE 'parquet-zstd' END AS format, datediff('day', DATE '1990-01-01', w) % 4 <> 0 AS has_file FROM weeks WHERE datediff('day', DATE '1990-01-01', w) % 2 = 0)
SELECT w AS start_week FROM weeks LEFT JOIN held USING (w) LEFT JOIN last USING (w), newest WHERE newest >= w + 9 AND (format IS NULL OR format <> 'parquet-zstd' OR NOT has_file OR last_write > exported_at)""")
def w11_due_weeks(spark, sf_dir):
    """Weeks of orders that an export still has to write: settled, and without a manifest, in another form, without a file, or written to since."""
    done = batches(spark, sf_dir).where("status <> 'running'")
    weeks = done.select(F.to_date(F.date_trunc("week", "batch_date")).alias("start_week")).distinct()
    n = F.datediff("start_week", F.lit(date(1990, 1, 1)))
    early = F.unix_date("start_week").cast("long") * 86400 % 5 == 0
    manifests = weeks.where(n % 2 == 0).select("start_week", F.when(n % 3 == 0, "old").otherwise("parquet-zstd").alias("format"), (n % 4 != 0).alias("has_file"), F.date_add("start_week", F.when(early, 8).otherwise(12)).cast("timestamp").alias("exported_at"))
    return writes.due_weeks(weeks, done, manifests)


# --- series and shapes -----------------------------------------------------------------------------------------------


@query(f"""WITH {LEGS}, turned AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id * 37 % 360 AS DOUBLE) END AS track FROM legs),
known AS (SELECT *, last_value(CASE WHEN track IS NOT NULL THEN t END IGNORE NULLS) OVER a AS ta, last_value(track IGNORE NULLS) OVER a AS va, first_value(CASE WHEN track IS NOT NULL THEN t END IGNORE NULLS) OVER b AS tb, first_value(track IGNORE NULLS) OVER b AS vb FROM turned
  WINDOW a AS (PARTITION BY icao24, leg ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY icao24, leg ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
raw AS (SELECT event_id, icao24, track, va + CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0.5 END * (fmod(fmod(vb - va + 180, 360) + 360, 360) - 180) AS x FROM known)
SELECT event_id, icao24, round(coalesce(track, fmod(fmod(x, 360) + 360, 360)), 3) AS track FROM raw""")
def f16_track_interpolated(spark, sf_dir):
    """Missing headings between known ones, the short way round."""
    rows = legs(spark, sf_dir).withColumn("track", F.when(F.col("seq") % 3 != 0, (F.col("seq") * 37 % 360).cast("double")))
    return fl.filled_linear(rows, "track", ["icao24", "leg"], order=["t", "seq"], circular=True).select(F.col("seq").alias("event_id"), "icao24", F.round("track", 3).alias("track"))


@query(f"""WITH {LENGTHS}, parts AS (SELECT s.*, m, greatest(1, CAST(floor(m / 5000.0) AS INT)) AS n FROM segs s JOIN lengths l USING (icao24, leg, k) WHERE s.part = s.part0)
SELECT p.icao24, start_t, CAST(sum(n) + count(DISTINCT part) AS INT) AS n_points, bool_and(m / n < 10000) AS near FROM parts p JOIN started USING (icao24, leg) GROUP BY p.icao24, start_t""")
def f17_densified(spark, sf_dir):
    """Paths with points about 5 km apart, never twice as far."""
    dense = raw_flights(spark, sf_dir).withColumn("path", S.densify(F.col("path"), 5_000.0))
    steps = F.transform(S.segments(F.col("path"), stitched=False), lambda s: geo.geodesic(s["lat0"], s["lon0"], s["lat1"], s["lon1"], geo.once))
    return dense.select("icao24", "start_t", S.num_instants(F.col("path")).alias("n_points"), (F.array_max(steps) < 10_000).alias("near"))


@query(f"""WITH RECURSIVE {VERTICES}, v AS (SELECT icao24, leg, part, t, alt_baro AS x, row_number() OVER p AS rn, count(*) OVER (PARTITION BY icao24, leg, part) AS n FROM vertices WINDOW p AS (PARTITION BY icao24, leg, part ORDER BY t, event_id)),
walk AS (SELECT icao24, leg, part, rn, t, x AS kept_x, true AS keeps FROM v WHERE rn = 1
  UNION ALL SELECT v.icao24, v.leg, v.part, v.rn, v.t, CASE WHEN abs(v.x - w.kept_x) >= 2000 THEN v.x ELSE w.kept_x END, v.rn = v.n OR abs(v.x - w.kept_x) >= 2000 FROM walk w JOIN v ON v.icao24 = w.icao24 AND v.leg = w.leg AND v.part = w.part AND v.rn = w.rn + 1)
SELECT w.icao24, start_t, w.t FROM walk w JOIN started USING (icao24, leg) WHERE keeps""")
def f18_series_thinned(spark, sf_dir):
    """Heights of each stretch thinned to steps of 2,000 ft: the first, the last, and what differs so much from the last kept."""
    heights = F.transform("path", lambda part: F.transform(part, lambda v: F.struct(v["t"].alias("t"), v["alt"].alias("v"))))
    thin = F.flatten(S.thin(heights, 2_000.0))
    return raw_flights(spark, sf_dir).select("icao24", "start_t", F.explode(F.transform(thin, lambda x: x["t"])).alias("t"))


@query(f"WITH {FLIGHT} SELECT icao24, start_t, CASE WHEN raw_point_count % 2 = 0 THEN -1 ELSE n_vertices END AS n_vertices FROM flights")
def f19_backfilled(spark, sf_dir):
    """A derived column that half of the rows lack is made for those, and left alone where it is there."""
    rows = raw_flights(spark, sf_dir).select("icao24", "start_t", "raw_point_count", "path", F.when(F.col("raw_point_count") % 2 == 0, -1).alias("n_vertices"))
    return enrich.backfilled(rows, "n_vertices", lambda lack: lack.withColumn("n_vertices", S.num_instants(F.col("path")))).select("icao24", "start_t", "n_vertices")


@query(f"""WITH {SPACES} SELECT id, round(abs(radians(max_lon - min_lon)) * (sin(radians(max_lat)) - sin(radians(min_lat))) * power(6378.137, 2), 1) AS area_km2, round((min_lon + max_lon) / 2, 6) AS lon, round((min_lat + max_lat) / 2, 6) AS lat FROM airspaces""")
def g06_areas_and_centres(spark, sf_dir):
    """Areas of boxes on the sphere, and their centres."""
    rows = lookups.airspace_edges(view(spark, sf_dir, "airspaces")).withColumn("c", geo.edges_centroid(F.col("edges")))
    return rows.select("id", F.round(geo.edges_area_km2(F.col("edges")), 1).alias("area_km2"), F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query(f"""WITH {TRACKS} SELECT event_id, list_extract(['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'], CAST(floor(((event_id * 7 % 360) + 11.25) / 22.5) AS INT) % 16 + 1) AS heading,
  CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || printf('%02d', CAST(abs(floor(lat)) AS INT)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || printf('%03d', CAST(abs(floor(lon)) AS INT)) AS tile FROM tracks""")
def x03_headings_and_tiles(spark, sf_dir):
    """Headings by their names, positions by the tile of terrain that they are over."""
    rows = view(spark, sf_dir, "tracks")
    return rows.select("event_id", geo.compass((F.col("event_id") * 7 % 360).cast("double")).alias("heading"), text.tile_name(F.col("lat"), F.col("lon")).alias("tile"))


# --- lookups and predicates ------------------------------------------------------------------------------------------


@query(f"""WITH {SPACES}, d AS (SELECT *, sqrt(power(greatest(0, min_lon - 2.3, 2.3 - max_lon) * cos(radians(52.6)) * 111320.0, 2) + power(greatest(0, min_lat - 52.6, 52.6 - max_lat) * 111320.0, 2)) AS m FROM airspaces)
SELECT id, type_code, round(m, 1) AS distance_m FROM d WHERE m <= 90000 ORDER BY id LIMIT 50""")
def r08_airspaces_near(spark, sf_dir):
    rows = lookups.airspaces_near(view(spark, sf_dir, "airspaces"), 52.6, 2.3, 90.0)
    return rows.select("id", "type_code", F.round("distance_m", 1).alias("distance_m"))


@query(f"WITH {AIRPORTS}, {SPACES}, a AS (SELECT * FROM airports WHERE ident = 'NATI' ORDER BY name LIMIT 1) SELECT a.id, a.name, s.id AS airspace_id, CASE s.type_code WHEN 13 THEN 'ATZ' ELSE 'CTR' END AS type FROM a JOIN airspaces s ON s.type_code IN (4, 13, 14) AND a.lon > min_lon AND a.lon < max_lon AND a.lat > min_lat AND a.lat < max_lat")
def r09_airport_by_code(spark, sf_dir):
    """An airport by its code, the first by name of several, with its aerodrome airspaces."""
    found = lookups.aerodrome_airspaces(lookups.airport(view(spark, sf_dir, "airports"), "nati"), view(spark, sf_dir, "airspaces"))
    return found.select("id", "name", F.explode("airspaces").alias("s")).select("id", "name", F.col("s.id").alias("airspace_id"), F.col("s.type").alias("type"))


FORM = {"mode": "all", "items": [
    {"kind": "callsign_prefix", "value": "baw"}, {"kind": "icao24", "value": []},
    {"mode": "any", "items": [{"kind": "duration_min", "value": {"min": 20}}, {"kind": "emitter_category", "value": ["A7"], "negate": True}, {"items": []}]},
    {"kind": "trajectory", "value": {"geometry": {"type": "Polygon", "coordinates": [[list(p) for p in geo.Polygon.of_box(*BOX).rings[0]]]}, "distance_nm": {"min": 30}}},
]}
IN_FORM = f"callsign LIKE 'BAW%' AND (end_t - start_t >= 1200 OR NOT (emitter_category = 'A7')) AND metres >= {30 * geo.NM_M}"


@query(f"WITH {FAR}, {FLIGHT.removeprefix(VERTICES + ', ').removeprefix(VERTICES + ',').strip()} SELECT f.icao24, f.start_t FROM flights f JOIN spanned USING (icao24, leg) WHERE {IN_FORM} AND {MEETS}")
def p27_filter_form(spark, sf_dir):
    """A form's tree: empty items vanish, a group of any, a negation, minutes and nautical miles."""
    return chosen(P.from_filter_tree(FORM))(spark, sf_dir)


first, last = P.days(date(2024, 1, 1), date(2024, 1, 1))
predicate("p28_calendar_day", P.Trajectory(time_from=first, time_to=last), f"end_t >= {first.timestamp()} AND start_t < {last.timestamp()}")


# --- the stream ------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {AIRBORNE}, counted AS (SELECT icao24, leg, CAST(count(*) AS INT) AS raw_point_count FROM legs GROUP BY icao24, leg) SELECT icao24, start_t, end_t, n_parts, dropped, raw_point_count FROM cleaned JOIN refused USING (icao24, leg) JOIN counted USING (icao24, leg)")
def t05_stream_into_table(spark, sf_dir):
    """Reports that land in files one after the other become the same flights as in one batch; a far later report lets silence close the last legs."""
    rows = points(spark, sf_dir).select("icao24", "t", "lat", "lon", "alt_baro", *[F.lit(None).cast("double").alias(c) for c in ("track", "gs", "vr", "ias")], "squawk", "callsign", "emitter_category", "new_leg")
    landed, half = folder(spark), T0 + 3_000.0
    for own in (rows.where(F.col("t") < half), rows.where(F.col("t") >= half)):
        own.coalesce(1).write.mode("append").parquet(landed)
    late = rows.limit(1).withColumn("icao24", F.lit("ffffff")).withColumn("t", F.lit(T0 + 864_000.0))
    for after in (0.0, 10.0):
        late.withColumn("t", F.col("t") + after).coalesce(1).write.mode("append").parquet(landed)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    table = folder(spark)
    name = "spark.sql.shuffle.partitions"  # a stream keeps its number for good; four batches need a task for each core
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(int(usual), max(8, spark.sparkContext.defaultParallelism))))
    try:
        stream.into_table(stream.flights_stream(source, "10 minutes"), table, folder(spark)).awaitTermination()
    finally:
        spark.conf.set(name, usual)
    return tables.read_flights(spark, table).select("icao24", "start_t", "end_t", F.size("path").alias("n_parts"), "dropped", "raw_point_count")
