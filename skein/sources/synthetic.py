"""Aircraft tables made from the star schema: the same SQL runs in Spark and, but for two expressions, elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACKS = """
SELECT event_id,
  lower(lpad(hex(user_id + 4194304), 6, '0')) AS icao24,
  CAST(1704067200 AS DOUBLE) + el AS t,
  48 + (user_id % 10) + CASE WHEN user_id % 5 = 0 THEN 0 ELSE el * CAST(0.0004 AS DOUBLE) END + noise
     + CASE WHEN k = 99 THEN 5 ELSE 0 END AS lat,
  (user_id % 20) - 5 + CASE WHEN user_id % 5 = 0 THEN 0 ELSE el * CAST(0.0006 AS DOUBLE) END + noise AS lon,
  CASE WHEN value < 12 THEN CAST(NULL AS DOUBLE) ELSE 1000 + 20 * value END AS alt_baro,
  CASE event_type WHEN 'error' THEN '7700' WHEN 'signup' THEN '1200' WHEN 'view' THEN NULL ELSE '7000' END AS squawk,
  CASE WHEN event_type = 'click' THEN NULL
       ELSE concat(CASE WHEN user_id % 3 = 0 THEN 'BAW' ELSE 'RYR' END, CAST(user_id AS VARCHAR(20))) END AS callsign,
  CASE WHEN user_id % 7 = 0 THEN 'A7' ELSE 'A3' END AS emitter_category,
  k = 0 AS new_leg
FROM (SELECT *, ({us} - 1704067200000000) / CAST(400000000 AS DOUBLE) AS el,
             (value - 245) / CAST(100000 AS DOUBLE) AS noise, CAST({js} AS INT) AS k FROM events) e
"""
AIRPORTS = """
SELECT concat('wp-', CAST(n_nationkey AS VARCHAR(10))) AS id, 'airport' AS kind, n_name AS name, upper(substr(n_name, 1, 4)) AS ident,
  CASE WHEN n_nationkey >= 20 THEN 7 WHEN n_nationkey % 9 = 8 THEN 8 ELSE 3 END AS type_code,
  CAST(48 + (n_nationkey % 10) AS DOUBLE) AS lat,
  (n_nationkey % 20) - 5 + CASE WHEN n_nationkey >= 20 THEN CAST(0.004 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lon
FROM nation
"""
AIRFRAMES = """
SELECT lower(lpad(hex(c_custkey + 4194304), 6, '0')) AS icao24,
  concat('G-', upper(substr(c_mktsegment, 1, 2)), CAST(c_custkey AS VARCHAR(20))) AS registration,
  CASE c_custkey % 3 WHEN 0 THEN 'B738' WHEN 1 THEN 'A320' ELSE 'C172' END AS icao_type,
  c_mktsegment AS model, 1990 + CAST(c_custkey % 30 AS INT) AS year
FROM customer WHERE c_custkey % 11 <> 0
"""
AIRSPACES = """
SELECT concat('as-', CAST(n_nationkey AS VARCHAR(10)), '-', CAST(b.type_code AS VARCHAR(10))) AS id, n_name AS name, b.type_code,
  CAST((n_nationkey % 20) - 5 - b.h AS DOUBLE) AS min_lon, CAST(48 + (n_nationkey % 10) - b.h AS DOUBLE) AS min_lat,
  CAST((n_nationkey % 20) - 5 + b.h AS DOUBLE) AS max_lon, CAST(48 + (n_nationkey % 10) + b.h AS DOUBLE) AS max_lat
FROM nation CROSS JOIN (VALUES (13, CAST(0.05 AS DOUBLE)), (4, CAST(0.2 AS DOUBLE)), (7, CAST(1 AS DOUBLE))) AS b(type_code, h)
"""
SOURCES = {"tracks": (TRACKS, "events"), "airports": (AIRPORTS, "nation"), "airframes": (AIRFRAMES, "customer"), "airspaces": (AIRSPACES, "nation")}
SPARK = {"us": "unix_micros(CAST(ts AS TIMESTAMP))", "js": "get_json_object(props,'$.k')"}
OTHER = {"us": "epoch_us(ts)", "js": "json_extract_string(props,'$.k')"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of tracks, airports, airframes, airspaces over the tables in ``sf_dir``."""
    text, source = SOURCES[name]
    for k, v in SPARK.items():
        text = text.replace(f"{{{k}}}", v)
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(text.replace(f"FROM {source}", "FROM {table}").replace("FROM events)", "FROM {table})"), table=table)


def oracle(name: str) -> str:
    """The same view as SQL text for the other engine."""
    text = SOURCES[name][0]
    for k, v in OTHER.items():
        text = text.replace(f"{{{k}}}", v)
    return text.strip()
