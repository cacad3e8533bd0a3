"""Trace files, one JSON object for each aircraft, to point rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

#: A trace's own fields; entries stay text until each field is read.
HEADER = "icao string, t string, timestamp string, trace array<array<string>>, _corrupt_record string"


def read_traces(spark: SparkSession, path: str, batch_date: str) -> DataFrame:
    """Raw trace documents (name, body) of landed archive members; gzip members are read as they are."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(path)
    return text.select(F.input_file_name().alias("name"), F.col("value").alias("body"), F.to_date(F.lit(batch_date)).alias("batch_date"))


def parsed(raw: DataFrame) -> DataFrame:
    """raw plus ``doc`` (null fields where they are missing) and ``bad``: why a whole trace is refused, else null."""
    doc = F.from_json("body", HEADER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.withColumn("doc", doc)
    return rows.withColumn(
        "bad",
        F.when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(), F.when(F.get_json_object("body", "$.trace").isNotNull(), "trace is not a list").otherwise("not a trace"))
        .when(F.coalesce(F.trim("doc.icao"), F.lit("")) == "", "no icao")
        .when(F.expr("try_cast(doc.timestamp AS DOUBLE)").isNull(), "bad timestamp")
        .when(F.col("doc.trace").isNull(), "trace is not a list"),
    )


def rejects(raw: DataFrame) -> DataFrame:
    return parsed(raw).where("bad IS NOT NULL").select("name", "batch_date", "bad")


def points(raw: DataFrame) -> DataFrame:
    """One row for each usable entry of each good trace, with its ``trace`` (document) and its place ``seq`` in it.

    Entries with fewer than three fields, or without a numeric offset, latitude and longitude, are left out. A text
    altitude ("ground") is null, as a missing one is. Flag bit 2 marks the start of a leg; unreadable flags are 0.
    """
    entry = parsed(raw).where("bad IS NULL").select("doc.icao", "doc.t", F.expr("try_cast(doc.timestamp AS DOUBLE)").alias("base"), "batch_date", F.col("name").alias("trace"), F.posexplode("doc.trace").alias("seq", "e"))
    number = lambda k: F.expr(f"try_cast(try_element_at(e, {k + 1}) AS DOUBLE)")
    field = lambda name: blank_to_null(F.get_json_object(F.try_element_at("e", F.lit(9)), f"$.{name}"))
    rows = entry.where(F.size("e") >= 3).select(
        F.lower(F.trim("icao")).alias("icao24"), blank_to_null(F.col("t")).alias("icao_type"), (F.col("base") + number(0)).alias("t"), number(1).alias("lat"), number(2).alias("lon"), number(3).alias("alt_baro"), number(5).alias("track"), number(4).alias("gs"), number(7).alias("vr"), number(12).alias("ias"),
        field("squawk").alias("squawk"), field("flight").alias("callsign"), field("category").alias("emitter_category"), (F.coalesce(F.expr("try_cast(try_element_at(e, 7) AS INT)"), F.lit(0)).bitwiseAND(2) != 0).alias("new_leg"), "trace", "seq", "batch_date",
    )
    return rows.where("t IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
