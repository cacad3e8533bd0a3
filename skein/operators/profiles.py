"""Tables below the flight row: segments with the values along them, height profiles, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.geo import NM_M, compass, geodesic, haversine, project


def segment_table(flights: DataFrame) -> DataFrame:
    """One row for each vertex pair: heights corrected at both ends, height above ground, and the values that hold at its start."""
    at = lambda name, t, start=False: S.step_at(F.col(name), t, before_first=start) if name in flights.columns else F.lit(None).cast("double")
    rows = flights.withColumn("s", F.explode(S.segments(F.col("path"), stitched=False)))
    more = lambda t: F.coalesce(at("alt_correction_ft", t, True), F.lit(0.0))
    alt0, alt1 = F.col("s.z0") + more(F.col("s.t0")), F.col("s.z1") + more(F.col("s.t1"))
    track = at("path_tracks", F.col("s.t0"))
    return rows.select(
        "icao24", "start_ts", F.col("s.t0").alias("t0"), F.col("s.t1").alias("t1"), F.col("s.lon0").alias("lon0"), F.col("s.lat0").alias("lat0"), F.col("s.lon1").alias("lon1"), F.col("s.lat1").alias("lat1"),
        alt0.alias("alt0"), alt1.alias("alt1"), ((alt0 + alt1) / 2).alias("alt_mid"), at("path_agl_ft", F.col("s.t0")).alias("agl0"), at("path_agl_ft", F.col("s.t1")).alias("agl1"),
        at("path_gs", F.col("s.t0")).alias("gs"), at("path_vr", F.col("s.t0")).alias("vr"), at("path_ias", F.col("s.t0")).alias("ias"), track.alias("track"), compass(track.cast("double")).alias("heading"), at("squawk_seq", F.col("s.t0")).alias("squawk"),
    )


def height_profile(flights: DataFrame) -> DataFrame:
    """One row for each vertex: corrected altitude and the ground below it (null where the height above it is unknown)."""
    rows = flights.withColumn("v", F.explode(F.flatten("path")))
    more = F.coalesce(S.step_at(F.col("alt_correction_ft"), F.col("v.t"), before_first=True), F.lit(0.0)) if "alt_correction_ft" in flights.columns else F.lit(0.0)
    alt = F.col("v.alt") + more
    agl = S.step_at(F.col("path_agl_ft"), F.col("v.t")) if "path_agl_ft" in flights.columns else F.lit(None).cast("double")
    return rows.select("icao24", "start_ts", F.col("v.t").alias("t"), alt.alias("alt"), (alt - agl).alias("ground"))


def cards(flights: DataFrame) -> DataFrame:
    """Route, track length and straight distance in nautical miles, duration, day, bounding box."""
    straight = haversine(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")) / NM_M
    name = lambda end: F.coalesce(F.col(f"{end}_airport.ident"), F.col(f"{end}_airport.name")) if f"{end}_airport" in flights.columns else F.lit(None).cast("string")
    return flights.select("icao24", "start_ts", name("start").alias("from"), name("end").alias("to"), (F.col("path_length_m") / NM_M).alias("track_nm"), straight.alias("straight_nm"), (F.col("end_t") - F.col("start_t")).alias("duration_s"), F.to_date("start_ts").alias("day"), S.box(F.col("path")).alias("bbox"))


def closest_approach(flights: DataFrame, lon: float, lat: float) -> DataFrame:
    """Where each flight came nearest to a position: distance, instant, altitude and height above ground there."""
    rows = flights.withColumn("s", F.explode(S.segments(F.col("path"), stitched=False)))
    u = project(lon, lat, F.col("s.lon0"), F.col("s.lat0"), F.col("s.lon1"), F.col("s.lat1"))
    mid = lambda c: F.col(f"s.{c}0") + (F.col(f"s.{c}1") - F.col(f"s.{c}0")) * u
    keep = ["path_agl_ft"] if "path_agl_ft" in flights.columns else []
    best = rows.select("icao24", "start_ts", F.struct(geodesic(mid("lat"), mid("lon"), lat, lon).alias("distance_m"), mid("t").alias("t"), mid("z").alias("alt")).alias("x"))
    best = best.groupBy("icao24", "start_ts").agg(F.min("x").alias("x")).select("icao24", "start_ts", "x.*")
    if keep:
        best = best.join(flights.select("icao24", "start_ts", *keep), ["icao24", "start_ts"]).withColumn("agl", S.linear_at(F.col("path_agl_ft"), F.col("t"))).drop(*keep)
    return best


SERIES = ("path_tracks", "path_gs", "path_vr", "path_ias", "alt_correction_ft", "path_agl_ft")


def series_output(flights: DataFrame) -> DataFrame:
    """What a client gets of a flight: coordinates and timestamps of each stretch, and series as lists of [t, value] of each stretch.

    A stretch without values is left out, a series without any is null, as is one the table does not have. Codes are texts,
    so their pairs are (t, v) structs.
    """
    filled = lambda c: F.filter(F.col(c), lambda part: F.size(part) > 0)
    pairs = lambda c: F.transform(filled(c), lambda part: F.transform(part, lambda x: F.array(x["t"], x["v"].cast("double"))))
    some = lambda v: F.when(F.size(v) > 0, v)
    coordinates = F.transform(filled("path"), lambda part: F.transform(part, lambda v: F.array(F.round(v["lon"], 6), F.round(v["lat"], 6), v["alt"])))
    timestamps = F.transform(filled("path"), lambda part: F.transform(part, lambda v: v["t"]))
    nothing = F.lit(None).cast("array<array<array<double>>>")
    return flights.select(
        "icao24", "start_ts", some(coordinates).alias("coordinates"), some(timestamps).alias("timestamps"), some(filled("squawk_seq")).alias("squawk_seq"),
        *[(some(pairs(c)) if c in flights.columns else nothing).alias(c) for c in SERIES],
    )
