"""Pressure and terrain fields as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pressure_cube(raw: DataFrame) -> DataFrame:
    """(t, lat, lon, pressure) in Pa or hPa -> (t, lat, lon, hpa), with the longitude seam padded on both sides.

    The table counts as Pa when its largest value is over 2000. The column at the largest longitude is repeated 360
    degrees lower, the one at the smallest 360 degrees higher, so that every position lies between two columns.
    """
    edge = raw.agg(F.max("pressure").alias("top"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    rows = raw.crossJoin(F.broadcast(edge)).select("t", "lat", "lon", F.when(F.col("top") > 2000, F.col("pressure") / 100).otherwise(F.col("pressure")).alias("hpa"), "west", "east")
    west = rows.where("lon = west").withColumn("lon", F.col("lon") + 360)
    east = rows.where("lon = east").withColumn("lon", F.col("lon") - 360)
    return rows.unionByName(west).unionByName(east).select("t", "lat", "lon", "hpa")


def terrain_tiles(raw: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """(tile_lat, tile_lon, row, col, elevation_m) -> the same with elev_ft, whole feet of 16 bits; no data is 0."""
    feet = F.bround(F.when(F.col("elevation_m") == nodata, 0.0).otherwise(F.col("elevation_m") * 3.28084))
    return raw.select("tile_lat", "tile_lon", "row", "col", F.least(F.lit(32767), F.greatest(F.lit(-32768), F.coalesce(feet, F.lit(0)))).cast("smallint").alias("elev_ft"))
