"""Counts over flights and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def models_by_type(airframes: DataFrame) -> DataFrame:
    """The most common model of each aircraft type; the first in order among equals."""
    counted = airframes.where("icao_type IS NOT NULL AND model IS NOT NULL").groupBy("icao_type", "model").count()
    best = counted.groupBy("icao_type").agg(F.min(F.struct((-F.col("count")).alias("n"), "model")).alias("best"))
    return best.select("icao_type", F.col("best.model").alias("model"))


def type_stats(flights: DataFrame, airframes: DataFrame, day=None) -> DataFrame:
    """(day, icao_type, model, flight_count), for one day or all."""
    rows = flights.where("icao_type IS NOT NULL").withColumn("day", F.to_date("start_ts"))
    rows = rows if day is None else rows.where(F.col("day") == F.lit(day))
    return rows.groupBy("day", "icao_type").agg(F.count(F.lit(1)).alias("flight_count")).join(models_by_type(airframes), "icao_type", "left").select("day", "icao_type", "model", "flight_count")


def type_counts(stats: DataFrame, first, last) -> DataFrame:
    """Types of a range of days (both included) by number of flights, with the model that most days name."""
    rows = stats.where(F.col("day").between(F.lit(first), F.lit(last)))
    return rows.groupBy("icao_type").agg(F.sum("flight_count").alias("flight_count"), F.mode("model", True).alias("model")).orderBy(F.desc("flight_count"), "icao_type")


def data_range(flights: DataFrame) -> DataFrame:
    return flights.agg(F.to_date(F.min("start_ts")).alias("min_date"), F.to_date(F.max("end_ts")).alias("max_date"))


def bounds(flights: DataFrame) -> DataFrame:
    return flights.agg(F.min("start_ts").alias("first_start"), F.max("start_ts").alias("last_start"))


def latest_success(batches: DataFrame) -> DataFrame:
    return batches.agg(F.max(F.when(F.col("status") == "succeeded", F.col("batch_date"))).alias("batch_date"))


def batch_counts(points: DataFrame, flights: DataFrame) -> DataFrame:
    """Aircraft and reports read, flights written, reports left out."""
    read = points.agg(F.count_distinct("icao24").alias("aircraft"), F.count(F.lit(1)).alias("reports"))
    return read.crossJoin(flights.agg(F.count(F.lit(1)).alias("flights"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")))  # one row each


def observed(flights: DataFrame) -> tuple[DataFrame, Observation]:
    """flights, and the counts of them that the job which writes them makes on its way: flights, dropped reports, raw reports, vertices."""
    said = Observation()
    vertices = F.aggregate(F.transform("path", F.size), F.lit(0), lambda a, n: a + n)
    counts = {"flights": F.count(F.lit(1)), "dropped": F.sum("dropped"), "reports": F.sum("raw_point_count"), "vertices": F.sum(vertices)}
    return flights.observe(said, *[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in counts.items()]), said


def observed_traces(raw: DataFrame) -> tuple[DataFrame, Observation]:
    """Parsed trace documents, and what reading them counts: traces and refused ones."""
    said = Observation()
    return raw.observe(said, F.count(F.lit(1)).alias("traces"), F.count("bad").alias("refused")), said
