"""Flights as CSV lines, GeoJSON, GPX and KML, one piece of text for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import FT_M
from ..functions.text import flight_id


def stamp(t: Column, millis: bool = True) -> Column:
    return F.date_format(F.timestamp_micros(F.round(t * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if millis else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def xml(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _airframe(flights: DataFrame, field: str) -> Column:
    """A field of the airframe that ``lookups.with_airframes`` adds; null without it."""
    known = "af" in flights.columns and field in flights.schema["af"].dataType.names
    return F.col(f"af.{field}") if known else F.lit(None).cast("string")


def _flight_columns(flights: DataFrame, *fields: str) -> list[Column]:
    """What the exports say of a flight: its id, aircraft, airframe ``fields``, type and bounds, by their names."""
    return [
        flight_id(F.col("icao24"), F.col("start_ts")).alias("flight_id"), F.col("icao24"), F.col("callsign"), *[_airframe(flights, f).alias(f) for f in fields],
        F.col("icao_type"), stamp(F.col("start_t")).alias("start_ts"), stamp(F.col("end_t")).alias("end_ts"),
    ]


CSV_COLUMNS = ["flight_id", "icao24", "callsign", "registration", "model", "icao_type", "start_ts", "end_ts", "seq", "point_idx", "timestamp_utc", "longitude", "latitude", "altitude_ft"]


def csv_lines(flights: DataFrame) -> DataFrame:
    """One row for each vertex (CSV_COLUMNS): the flight with its airframe, the stretch and place, instant, position to 6 places, altitude."""
    rows = flights.select(*_flight_columns(flights, "registration", "model"), F.posexplode("path").alias("seq", "__p"))
    rows = rows.select("*", F.posexplode("__p").alias("point_idx", "__v"))
    places = {c: F.format_string("%.6f", f"__v.{v}") for c, v in (("longitude", "lon"), ("latitude", "lat"))}
    return rows.withColumns({"timestamp_utc": stamp(F.col("__v.t")), **places, "altitude_ft": F.col("__v.alt")}).select(*CSV_COLUMNS)


def geojson_features(flights: DataFrame) -> DataFrame:
    """One MultiLineString feature for each flight with a path; as lines of a text file they are newline GeoJSON."""
    line = F.transform("path", lambda part: F.transform(part, lambda v: F.array(F.round(v["lon"], 6), F.round(v["lat"], 6), v["alt"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*_flight_columns(flights, "registration", "model", "operator")).alias("properties"),
        F.struct(F.lit("MultiLineString").alias("type"), line.alias("coordinates")).alias("geometry"),
    )
    return flights.where(F.size("path") > 0).select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def gpx_tracks(flights: DataFrame) -> DataFrame:
    """One <trk> for each flight, one <trkseg> for each stretch, heights in metres."""
    point = lambda v: F.concat(F.lit('<trkpt lat="'), F.format_string("%.6f", v["lat"]), F.lit('" lon="'), F.format_string("%.6f", v["lon"]), F.lit('"><ele>'), F.format_string("%.1f", v["alt"] * FT_M), F.lit("</ele><time>"), stamp(v["t"]), F.lit("</time></trkpt>"))
    parts = F.array_join(F.transform("path", lambda part: F.concat(F.lit("<trkseg>"), F.array_join(F.transform(part, point), ""), F.lit("</trkseg>"))), "")
    return flights.where(F.size("path") > 0).select(F.concat(F.lit("<trk><name>"), xml(F.coalesce("callsign", "icao24")), F.lit("</name>"), parts, F.lit("</trk>")).alias("value"))


GPX = ('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="skein" xmlns="http://www.topografix.com/GPX/1/1">', "</gpx>")
KML = ('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>', "</Document></kml>")


def kml_placemarks(flights: DataFrame, timed: bool = True) -> DataFrame:
    """One <Placemark> for each flight, with what is known of it: tracks with instants, or plain lines."""
    said = [("ICAO24", F.col("icao24")), ("Reg", _airframe(flights, "registration")), ("Model", _airframe(flights, "model")), ("Operator", _airframe(flights, "operator")), ("Start", stamp(F.col("start_t"))), ("End", stamp(F.col("end_t")))]
    about = F.concat_ws("\n", *[F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{n}: "), c)) for n, c in said])
    about = F.concat(F.lit("<description><![CDATA["), F.replace(about, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]></description>"))
    place = lambda v, sep: F.concat_ws(sep, F.format_string("%.6f", v["lon"]), F.format_string("%.6f", v["lat"]), F.format_string("%.1f", v["alt"] * FT_M))
    if timed:
        track = lambda part: F.concat(F.lit("<gx:Track><altitudeMode>absolute</altitudeMode>"), F.array_join(F.transform(part, lambda v: F.concat(F.lit("<when>"), stamp(v["t"]), F.lit("</when>"))), ""), F.array_join(F.transform(part, lambda v: F.concat(F.lit("<gx:coord>"), place(v, " "), F.lit("</gx:coord>"))), ""), F.lit("</gx:Track>"))
        shape = F.concat(F.lit("<gx:MultiTrack>"), F.array_join(F.transform("path", track), ""), F.lit("</gx:MultiTrack>"))
    else:
        line = lambda part: F.concat(F.lit("<LineString><altitudeMode>absolute</altitudeMode><coordinates>"), F.array_join(F.transform(part, lambda v: place(v, ",")), " "), F.lit("</coordinates></LineString>"))
        shape = F.concat(F.lit("<MultiGeometry>"), F.array_join(F.transform("path", line), ""), F.lit("</MultiGeometry>"))
    return flights.where(F.size("path") > 0).select(F.concat(F.lit("<Placemark><name>"), xml(F.coalesce("callsign", "icao24")), F.lit("</name>"), about, shape, F.lit("</Placemark>")).alias("value"))


def whole_document(rows: DataFrame, frame: tuple[str, str]) -> DataFrame:
    """The rows' texts between a head and a tail, in one text: for result pages, whose size a limit bounds."""
    return rows.agg(F.concat(F.lit(frame[0]), F.array_join(F.array_sort(F.collect_list("value")), ""), F.lit(frame[1])).alias("value"))
