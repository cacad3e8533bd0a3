"""The daily build: staged and new reports to flights, staging for the next day, statistics, states."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, flights, rollups, writes


def cutoff(day: date) -> float:
    """The last moment of a day, in seconds."""
    return datetime.combine(day, time.max, timezone.utc).timestamp()


def split(staged: DataFrame, new: DataFrame) -> DataFrame:
    return flights.capped(flights.legs(flights.merge_reports(staged, new)))


def build_day(staged: DataFrame, new: DataFrame, day: date, cube: DataFrame | None = None, dem: DataFrame | None = None, airports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(flights, points to stage): flights of the day with what the given tables add, and the legs that may go on."""
    rows = split(staged, new)
    built = flights.build_flights(rows).withColumn("ingest_batch_date", F.lit(day))
    if cube is not None:
        built = enrich.with_pressure(built, cube)
        built = flights.measured(built)
    if dem is not None:
        built = enrich.with_agl(built, dem)
    if airports is not None:
        built = enrich.with_airports(built, airports)
    carried = flights.open_legs(rows, cutoff(day)).drop("leg", "part").withColumn("batch_date", F.lit(day))
    return built, carried


def run_day(spark: SparkSession, root: str, day: date, read_points: Callable[[date], DataFrame], airframes: DataFrame | None = None, **tables: DataFrame) -> None:
    """Build one day into the tables under ``root`` and record its state."""
    writes.record_batch(spark, f"{root}/batches", day, "running")
    try:
        new = read_points(day)
        staged_path = f"{root}/staging"
        staged = spark.read.schema(new.schema).parquet(staged_path).where(F.col("batch_date") == F.lit(day - timedelta(days=1))) if writes.exists(spark, staged_path) else new.limit(0)
        built, carried = build_day(staged, new, day, **tables)
        fresh = f"{root}/built/batch_date={day}"
        built, counts = rollups.observed(built)
        built.write.mode("overwrite").parquet(fresh)  # read twice below: not computed twice; counted on its way
        done = spark.read.parquet(fresh)
        writes.upsert_flights(spark, f"{root}/flights", done, day)
        writes.write_staging(carried, staged_path)
        if airframes is not None:
            stats = rollups.type_stats(done, airframes)
            stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/icao_type_stats")
        writes.record_batch(spark, f"{root}/batches", day, "succeeded", counts.get["flights"])
    except Exception:
        writes.record_batch(spark, f"{root}/batches", day, "errored")
        raise


def pending_days(landed: DataFrame, batches: DataFrame, today: date, lookback: int) -> DataFrame:
    """Landed days to build: after the latest success and within the lookback, and not yet done.

    A failed day before the latest success is left alone.
    """
    states = writes.batch_states(batches)
    done = states.where("status = 'succeeded'").select("batch_date")
    latest = done.agg(F.max("batch_date").alias("latest"))  # one row
    rows = landed.crossJoin(F.broadcast(latest)).where(F.col("batch_date") > F.greatest(F.coalesce("latest", F.lit(date(1970, 1, 1))), F.lit(today - timedelta(days=lookback))))
    return rows.join(done, "batch_date", "left_anti").select("batch_date").orderBy("batch_date")


def reprocess(days: Iterable[date], landed: set[date], build: Callable[[date], None]) -> dict[date, str]:
    """Build days, oldest first; days without input are reported and skipped."""
    said: dict[date, str] = {}
    for day in sorted(set(days)):
        if day not in landed:
            said[day] = "no input"
            continue
        build(day)
        said[day] = "built"
    return said


def day_range(first: date, last: date) -> list[date]:
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]
