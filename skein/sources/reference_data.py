"""Airframe list and aeronautical features to dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, tokens

AIRFRAME_COLUMNS = ["icao24", "registration", "icao_type", "flags", "model", "year", "operator"]
# Bits of the airframe flags, and unit codes of heights and frequencies.
MILITARY, LADD = 1 << 0, 1 << 3
FEET_UNIT, METRE_UNIT, KHZ_UNIT = 1, 0, 1


def flags(bits: Column) -> Column:
    """A string of 0 and 1, lowest bit first, as a number."""
    return F.coalesce(F.when(bits.rlike("^[01]+$"), F.conv(F.reverse(bits), 2, 10).cast("smallint")), F.lit(0).cast("smallint"))


def read_airframes(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated lines: icao24, registration, type, flag bits, model, year, operator; a backslash escapes, blanks are null."""
    fields = F.transform(F.split("value", r"(?<!\\);"), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    raw = spark.read.text(path).select(fields.alias("f")).select(*[F.get("f", k).alias(c) for k, c in enumerate(AIRFRAME_COLUMNS)])
    text = {c: blank_to_null(F.col(c)) for c in AIRFRAME_COLUMNS}
    rows = raw.where((F.length(F.trim("icao24")) == 6) & F.col("flags").isNotNull())
    return rows.select(F.lower(text["icao24"]).alias("icao24"), text["registration"].alias("registration"), text["icao_type"].alias("icao_type"), flags(F.trim("flags")).alias("flags"), text["model"].alias("model"), F.expr("try_cast(trim(year) AS SMALLINT)").alias("year"), text["operator"].alias("operator"))


def has_flag(column: Column, bit: int) -> Column:
    return column.bitwiseAND(bit) != 0


def elevation_ft(value: Column, unit: Column) -> Column:
    return F.bround(F.when(unit == METRE_UNIT, value * 3.28084).otherwise(value)).cast("int")


def frequency_mhz(value: Column, unit: Column) -> Column:
    return F.when(unit == KHZ_UNIT, value / 1000).otherwise(value)


FEATURE = """properties struct<_id:string, name:string, icaoCode:string, iataCode:string, identifier:string, type:int, country:string, icaoClass:int, compulsory:boolean,
  elevation:struct<value:double,unit:int>, frequency:struct<value:string,unit:int>,
  upperLimit:struct<value:double,unit:int,referenceDatum:int>, lowerLimit:struct<value:double,unit:int,referenceDatum:int>>,
  geometry struct<type:string, coordinates:string>"""


def read_features(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Newline-separated GeoJSON features of files named like ``glob``."""
    return spark.read.schema(FEATURE).option("pathGlobFilter", glob).json(path).where("properties._id IS NOT NULL AND geometry.coordinates IS NOT NULL")


def _waypoints(features: DataFrame, kind: str, ident: Column, **more: Column) -> DataFrame:
    p = F.col("properties")
    at = F.from_json("geometry.coordinates", "array<double>")
    columns = {"iata_code": F.lit(None).cast("string"), "frequency_mhz": F.lit(None).cast("double"), "compulsory": F.lit(None).cast("boolean"), **more}
    rows = features.select(
        p["_id"].alias("id"), F.lit(kind).alias("kind"), p["name"].alias("name"), F.upper(blank_to_null(ident)).alias("ident"), p["type"].alias("type_code"), p["country"].alias("country"), at[0].alias("lon"), at[1].alias("lat"),
        elevation_ft(p["elevation"]["value"], p["elevation"]["unit"]).alias("elevation_ft"), *[v.alias(k) for k, v in columns.items()],
    )
    return rows.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("tokens", tokens(F.col("name"), F.col("ident"), F.col("iata_code")))


def airports(features: DataFrame) -> DataFrame:
    return _waypoints(features, "airport", F.col("properties.icaoCode"), iata_code=F.upper(blank_to_null(F.col("properties.iataCode"))))


def navaids(features: DataFrame) -> DataFrame:
    return _waypoints(features, "navaid", F.col("properties.identifier"), frequency_mhz=frequency_mhz(F.expr("try_cast(properties.frequency.value AS DOUBLE)"), F.col("properties.frequency.unit")))


def reporting_points(features: DataFrame) -> DataFrame:
    return _waypoints(features, "reporting_point", F.lit(None).cast("string"), compulsory=F.col("properties.compulsory"))


def airspaces(features: DataFrame) -> DataFrame:
    """Airspaces with raw limit codes; ``rings`` are polygons of rings of points, a single polygon lifted to one."""
    p = F.col("properties")
    one, many = F.from_json("geometry.coordinates", "array<array<array<double>>>"), F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("geometry.type") == "MultiPolygon", many).when(F.col("geometry.type") == "Polygon", F.array(one))
    limit = lambda side: [p[side]["value"].alias(f"{side[:5]}_value"), p[side]["unit"].alias(f"{side[:5]}_unit"), p[side]["referenceDatum"].alias(f"{side[:5]}_ref")]
    rows = features.select(p["_id"].alias("id"), p["name"].alias("name"), p["type"].alias("type_code"), p["icaoClass"].alias("icao_class"), p["country"].alias("country"), *limit("lowerLimit"), *limit("upperLimit"), rings.alias("rings"))
    return rows.where("rings IS NOT NULL").withColumn("tokens", tokens(F.col("name")))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Dimension rows by key, those of ``new`` in place of those of ``old``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns).dropDuplicates([key]))
