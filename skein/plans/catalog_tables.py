"""Queries about the flights table of several weeks: pages, lookups, commits and the index of cells."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import flights as fl
from ..operators import lookups, profiles, rollups, tables, writes
from ..operators.asof import as_of
from ..session import cut, stored_path
from ..sources.synthetic import oracle, view
from . import predicates as P
from .catalog import BOX, FLIGHT, LENGTHS, SPACES, SQL, T0, TRACKS, VERTICES, built_flights, flights_path, points, query, raw_flights, sources
from .engine import Engine, Request, in_window

WEEK_S = 604_800.0
#: The tables' aircraft shared out over four weeks: those of a number k modulo 4 fly k weeks later.
WEEKLY_TRACKS = f"tracks AS (SELECT * REPLACE (t + CAST({WEEK_S} AS DOUBLE) * (CAST('0x' || icao24 AS BIGINT) % 4) AS t) FROM ({oracle('tracks')}))"
WEEKLY = FLIGHT.replace(TRACKS, WEEKLY_TRACKS)
WEEK_OF = "CAST(date_trunc('week', make_timestamp(CAST(round(start_t * 1000000) AS BIGINT))) AS DATE)"
PAGE = 100


def weekly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.pmod(F.conv("icao24", 16, 10).cast("long"), F.lit(4))
    return points(spark, sf_dir).withColumn("t", F.col("t") + F.lit(WEEK_S) * week)


def weekly_path(spark: SparkSession, sf_dir: str) -> str:
    """A table of four weeks, written week by week as daily batches would."""

    def write(path: str) -> None:
        built = fl.build_flights(fl.capped(fl.legs(weekly_points(spark, sf_dir), first_only=True)), clean=False, simplified=False)
        tables.upsert_flights(spark, path, built.withColumn("ingest_batch_date", F.to_date("start_ts")))

    return stored_path(spark, f"weeks of flights of {sf_dir}", write, sources(sf_dir))


def moment(seconds: float) -> datetime:
    return datetime.fromtimestamp(T0 + seconds, timezone.utc)


@query(f"""WITH RECURSIVE {WEEKLY}, ranked AS (SELECT icao24, start_t, CAST(round(start_t * 1000000) AS BIGINT) AS us, row_number() OVER (ORDER BY start_t DESC, icao24 DESC) AS rn FROM flights),
pages AS (SELECT 0 AS page, CAST(0 AS BIGINT) AS before, CAST(0 AS BIGINT) AS pos, max(us) + 1 AS upto FROM ranked
  UNION ALL SELECT * FROM (SELECT page + 1, pos, pos + least(n, {PAGE}), CASE WHEN n > {PAGE} THEN (SELECT us FROM ranked WHERE rn = pos + {PAGE}) + 1 ELSE upto - CAST({int(WEEK_S)}000000 AS BIGINT) + 1 END
    FROM (SELECT *, (SELECT count(*) FROM ranked WHERE rn > pos AND us >= upto - CAST({int(WEEK_S)}000000 AS BIGINT)) AS n FROM pages WHERE pos < (SELECT count(*) FROM ranked))))
SELECT page, icao24, start_t FROM ranked JOIN pages ON rn > before AND rn <= pos""")
def t01_page_walk(spark, sf_dir):
    """All flights, page after page and week after week, numbered at once."""
    engine = Engine.of_table(spark, weekly_path(spark, sf_dir))
    return engine.walk(Request(P.And(()), limit=PAGE, include_path=False)).select("page", "icao24", "start_t")


@query(f"""WITH {WEEKLY}, ends AS (SELECT min(start_t) AS a, max(start_t) AS b FROM flights GROUP BY {WEEK_OF})
SELECT icao24, start_t, n_vertices, {WEEK_OF} AS start_week FROM flights WHERE EXISTS (SELECT 1 FROM ends WHERE start_t = a OR start_t = b)""")
def t02_flight_lookup(spark, sf_dir):
    """The flights that start at each week's first and last instant, all of them, looked up by their ids."""
    engine = Engine.of_table(spark, weekly_path(spark, sf_dir))
    ends = F.broadcast(engine.flights.groupBy("start_week").agg(F.min("start_ts").alias("a"), F.max("start_ts").alias("b")))  # one for each week
    at_end = lambda rows: rows.join(ends, "start_week").where((F.col("start_ts") == F.col("a")) | (F.col("start_ts") == F.col("b")))
    ids = at_end(engine.flights).select(text.flight_id(F.col("icao24"), F.col("start_ts")).alias("flight_id"))
    return at_end(engine.flights_of(ids)).select("icao24", "start_t", F.size(F.flatten("path")).alias("n_vertices"), "start_week")


@query(f"WITH {WEEKLY} SELECT icao24, start_t FROM flights WHERE start_t >= {T0 + 2 * WEEK_S - 86400} AND start_t < {T0 + 2 * WEEK_S + 2000} AND end_t - start_t >= 300")
def t03_window_of_days(spark, sf_dir):
    """A window over the border of two weeks: the other folders are not read."""
    engine = Engine.of_table(spark, weekly_path(spark, sf_dir))
    window = in_window(moment(2 * WEEK_S - 86400), moment(2 * WEEK_S + 2000))
    return engine.select(P.Duration(min_s=300), window).select("icao24", "start_t")


@query(f"WITH {WEEKLY} SELECT {WEEK_OF} AS start_week, count(*) AS flights, CAST(sum(n_vertices) AS BIGINT) AS vertices FROM flights GROUP BY 1")
def t04_weeks(spark, sf_dir):
    rows = tables.read_flights(spark, weekly_path(spark, sf_dir))
    return rows.groupBy("start_week").agg(F.count(F.lit(1)).alias("flights"), F.sum(F.size(F.flatten("path"))).alias("vertices"))


CELL_OF = "CAST(floor(({lat} + 90) / 0.5) * 100000 + floor(({lon} + 180) / 0.5) AS BIGINT)"
FLIGHT_CELLS = f"""{LENGTHS}, stretches AS (SELECT s.*, greatest(1, CAST(ceil(m / 11300.0) AS INT)) AS parts FROM segs s JOIN lengths l USING (icao24, leg, k) WHERE s.part = s.part0),
sampled AS (SELECT icao24, leg, lon0 + (lon1 - lon0) * i / parts AS lon, lat0 + (lat1 - lat0) * i / parts AS lat FROM (SELECT *, unnest(range(0, parts + 1)) AS i FROM stretches)),
places AS (SELECT icao24, leg, lon, lat FROM sampled UNION ALL SELECT icao24, leg, lon, lat FROM vertices),
flight_cells AS (SELECT DISTINCT icao24, leg, {CELL_OF.format(lat='lat', lon='lon')} AS cell FROM places)"""
COVER = geo.cover(geo.Polygon.of_box(*BOX), fl.CELL)


@query(f"WITH {FLIGHT_CELLS} SELECT icao24, start_t, cell FROM flight_cells JOIN started USING (icao24, leg)")
def c01_flight_cells(spark, sf_dir):
    """The index: a row for each cell that a flight comes through."""
    rows, cells = raw_flights(spark, sf_dir), tables.read_cells(spark, flights_path(spark, sf_dir))
    return cells.join(rows.select(*tables.KEY, "start_week", "start_t"), [*tables.KEY, "start_week"]).select("icao24", "start_t", "cell")


@query(f"WITH {FLIGHT_CELLS} SELECT icao24, start_t FROM started s WHERE EXISTS (SELECT 1 FROM flight_cells c WHERE c.icao24 = s.icao24 AND c.leg = s.leg AND cell IN ({', '.join(map(str, COVER))}))")
def c02_flights_in_cells(spark, sf_dir):
    """Flights that the index gives for an area, before the exact test."""
    keys = tables.in_cells(tables.read_cells(spark, flights_path(spark, sf_dir)), COVER)
    return raw_flights(spark, sf_dir).join(lookups.small(keys), [*tables.KEY, "start_week"], "left_semi").select("icao24", "start_t")


def _changed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A table of its own for a query that writes: the four weeks' flights."""
    whole = tables.read_flights(spark, weekly_path(spark, sf_dir)).select("icao24", "start_ts", "start_t", "raw_point_count", "cells", "ingest_batch_date", "start_week")
    path = stored_path(spark, f"weeks to change of {sf_dir}", lambda p: None, sources(sf_dir))
    if tables.current(spark, path) is None:
        tables.upsert_flights(spark, path, whole)
    return path, whole


@query(f"""WITH {WEEKLY}, old AS (SELECT *, {WEEK_OF} AS start_week, CAST(make_timestamp(CAST(round(start_t * 1000000) AS BIGINT)) AS DATE) AS day FROM flights),
new AS (SELECT *, raw_point_count + 1000 AS n FROM old WHERE day = DATE '2024-01-08' AND start_t < {T0 + WEEK_S + 3000})
SELECT icao24, start_t, CAST(n AS INT) AS raw_point_count, start_week FROM new UNION ALL SELECT icao24, start_t, CAST(raw_point_count AS INT), start_week FROM old WHERE day <> DATE '2024-01-08'""")
def w07_batch_rewritten(spark, sf_dir):
    """A day's batch written again: its rows replace those with their keys, those it no longer has go, one commit of one week."""
    path, whole = _changed(spark, sf_dir)
    new = whole.where((F.col("ingest_batch_date") == F.lit(date(2024, 1, 8))) & (F.col("start_t") < T0 + WEEK_S + 3000))
    tables.upsert_flights(spark, path, new.withColumn("raw_point_count", F.col("raw_point_count") + 1000), date(2024, 1, 8))
    return tables.read_flights(spark, path).select("icao24", "start_t", "raw_point_count", "start_week")


@query(f"WITH {WEEKLY} SELECT icao24, start_t, {WEEK_OF} AS start_week FROM flights WHERE {WEEK_OF} >= DATE '2024-01-15'")
def w08_weeks_retained(spark, sf_dir):
    """Weeks that end before a day are dropped as folders; the others' files stay as they are."""
    whole = tables.read_flights(spark, weekly_path(spark, sf_dir)).select("icao24", "start_ts", "start_t", "cells", "start_week")
    path = stored_path(spark, f"weeks to drop of {sf_dir}", lambda p: tables.upsert_flights(spark, p, whole), sources(sf_dir))
    writes.drop_weeks(spark, path, date(2024, 1, 16))
    return tables.read_flights(spark, path).select("icao24", "start_t", "start_week")


# --- tables beside tables ------------------------------------------------------------------------------------------


@query(f"""WITH {FLIGHT}, heard AS (SELECT icao24, t, event_id, squawk FROM dedup WHERE squawk IS NOT NULL)
SELECT f.icao24, f.start_t, h.event_id, h.squawk, round(f.end_t - h.t, 3) AS seconds_before FROM flights f ASOF LEFT JOIN heard h ON h.icao24 = f.icao24 AND h.t <= f.end_t""")
def j08_code_at_the_end(spark, sf_dir):
    """The last code that an aircraft sent, in whatever leg, at or before each flight's end: flights and reports joined as of an instant."""
    heard = fl.deduplicated(points(spark, sf_dir)).where("squawk IS NOT NULL").select("icao24", "t", "seq", "squawk")
    ends = raw_flights(spark, sf_dir).select("icao24", "start_t", "end_t")
    out = as_of(ends, heard, ["icao24"], t="end_t", right_t="t", ties=["seq"])
    return out.select("icao24", "start_t", F.col("as_of.seq").alias("event_id"), "as_of.squawk", F.round(F.col("end_t") - F.col("as_of.t"), 3).alias("seconds_before"))


@query(f"""WITH {TRACKS}, turns AS (SELECT icao24, t, event_id, alt_baro FROM tracks WHERE event_id % 5 = 0), asked AS (SELECT icao24, t, event_id FROM tracks WHERE event_id % 5 <> 0),
met AS (SELECT a.event_id, b.event_id AS before_id, a.t - b.t AS age, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t DESC, b.event_id DESC) AS rk FROM asked a JOIN turns b ON b.icao24 = a.icao24 AND b.t <= a.t AND a.t - b.t <= 120)
SELECT a.event_id, m.before_id FROM asked a LEFT JOIN met m ON m.event_id = a.event_id AND m.rk = 1""")
def j09_fix_within_two_minutes(spark, sf_dir):
    """Reports and the last of every fifth report, which play another receiver's, at most two minutes before them."""
    rows = points(spark, sf_dir)
    other, asked = rows.where("seq % 5 = 0").select("icao24", "t", "seq"), rows.where("seq % 5 <> 0").select("icao24", "t", F.col("seq").alias("event_id"))
    return as_of(asked, other, ["icao24"], ties=["seq"], within=120.0, stretch=1000.0).select("event_id", F.col("as_of.seq").alias("before_id"))


def index_path(spark: SparkSession, sf_dir: str) -> str:
    index = lambda: lookups.token_index(view(spark, sf_dir, "airports"), view(spark, sf_dir, "airspaces"))
    return stored_path(spark, f"tokens of {sf_dir}", lambda path: lookups.store_index(index(), path), sources(sf_dir))


@query(SQL["r01_search"])
def r06_search_by_index(spark, sf_dir):
    """The same search by the stored index of words: a prefix is a range of the sorted tokens."""
    return lookups.search_index(spark.read.parquet(index_path(spark, sf_dir)), "nation_1", limit=20).select("id", "kind", "name")


@query(f"""WITH {VERTICES}, filled AS (SELECT *, last_value(squawk IGNORE NULLS) OVER (PARTITION BY icao24, leg, part ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS code FROM vertices),
turns AS (SELECT *, lag(code) OVER p AS before, lead(t) OVER p IS NULL AS ends FROM filled WINDOW p AS (PARTITION BY icao24, leg, part ORDER BY t, event_id)),
said AS (SELECT *, dense_rank() OVER (PARTITION BY icao24, leg ORDER BY part) AS place FROM turns WHERE code IS NOT NULL AND (ends OR before IS NULL OR before <> code))
SELECT s.icao24, start_t, CAST(place AS INT) AS place, t, code FROM said s JOIN started USING (icao24, leg)""")
def r07_series_output(spark, sf_dir):
    """Codes as a client gets them: stretches without any are left out, flights without any have none."""
    rows = profiles.series_output(raw_flights(spark, sf_dir).withColumn("start_ts", F.col("start_t")))
    out = rows.select("icao24", F.col("start_ts").alias("start_t"), F.posexplode("squawk_seq").alias("place", "part"))
    return out.select("icao24", "start_t", (F.col("place") + 1).alias("place"), F.inline("part")).withColumnRenamed("v", "code")


@query(f"WITH {FLIGHT} SELECT count(*) AS flights, CAST(0 AS BIGINT) AS dropped, CAST(sum(raw_point_count) AS BIGINT) AS reports, CAST(sum(n_vertices) AS BIGINT) AS vertices FROM flights")
def a06_observed_counts(spark, sf_dir):
    """What a build counts in the job that writes it, without a second look at the table."""
    rows, said = rollups.observed(built_flights(spark, sf_dir))
    cut(rows)
    got = said.get
    return spark.createDataFrame([(got["flights"], got["dropped"], got["reports"], got["vertices"])], "flights long, dropped long, reports long, vertices long")


@query(f"WITH {SPACES} SELECT id, CASE type_code WHEN 4 THEN 'CTR' WHEN 7 THEN 'TMA' WHEN 13 THEN 'ATZ' END AS type, CASE type_code % 7 WHEN 0 THEN 'A' WHEN 4 THEN 'E' WHEN 6 THEN 'G' END AS class FROM airspaces")
def x02_airspace_labels(spark, sf_dir):
    rows = view(spark, sf_dir, "airspaces")
    return rows.select("id", text.airspace_type(F.col("type_code")).alias("type"), text.airspace_class(F.col("type_code") % 7).alias("class"))
