"""Staging, batches, retention and weekly exports, on plain Parquet; the flights table itself is in ``tables``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import drop, drop_weeks, exists, merged, upsert_flights  # noqa: F401

#: Days after a week's end from which a batch no longer writes into it.
SETTLED_DAYS = 3


def latest_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def write_staging(points: DataFrame, path: str) -> None:
    """Open legs of a day in place of what was staged for that day."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_date").parquet(path)


def record_batch(spark: SparkSession, path: str, batch_date, status: str, flight_count: int | None = None) -> None:
    row = spark.range(1).select(F.to_date(F.lit(str(batch_date))).alias("batch_date"), F.lit(status).alias("status"), F.lit(flight_count).cast("long").alias("flight_count"), F.current_timestamp().alias("finished_at"))
    row.write.mode("append").parquet(path)


def batch_states(batches: DataFrame) -> DataFrame:
    """The last state of each batch."""
    return latest_by_key(batches, ["batch_date"], "finished_at")


def retained(rows: DataFrame, column: str, months: int | None, today: Column | None = None) -> DataFrame:
    """Rows inside the retention window; no window, all rows."""
    if months is None:
        return rows
    return rows.where(F.col(column) >= F.add_months(today if today is not None else F.current_date(), -months))


def week_manifest(flights: DataFrame, derived: tuple[str, ...] = ("min_alt", "max_alt", "min_qnh_alt", "max_qnh_alt")) -> DataFrame:
    """(start_week, row_count, content_hash) over the stored columns; the hash does not depend on order."""
    stored = [c for c in flights.columns if c not in derived and c != "start_week"]
    return flights.groupBy("start_week").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.xxhash64(*stored).cast("decimal(38,0)")).cast("string").alias("content_hash"))


def export_week(flights: DataFrame, week, path: str) -> None:
    flights.where(F.col("start_week") == F.lit(week)).drop("start_week").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/start_week={week}")


def due_weeks(flights: DataFrame, batches: DataFrame, manifests: DataFrame, fmt: str = "parquet-zstd") -> DataFrame:
    """Weeks to export: settled, and without a manifest, in another format, without a file, or written to since.

    A week is settled when the latest succeeded batch is SETTLED_DAYS after its end. ``manifests`` has start_week,
    format, has_file, exported_at.
    """
    done = batches.where("status = 'succeeded'")
    newest = done.agg(F.max("batch_date").alias("newest"))
    weeks = flights.select("start_week").distinct()
    settled = weeks.crossJoin(F.broadcast(newest)).where(F.col("newest") >= F.date_add("start_week", 7 + SETTLED_DAYS - 1))  # one row
    touches = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SETTLED_DAYS)), lambda k: F.to_date(F.date_trunc("week", F.date_sub("batch_date", k))))))
    last = done.select("finished_at", touches.alias("start_week")).groupBy("start_week").agg(F.max("finished_at").alias("last_write"))
    joined = settled.join(manifests, "start_week", "left").join(last, "start_week", "left")
    due = F.col("format").isNull() | (F.col("format") != fmt) | ~F.coalesce("has_file", F.lit(False)) | (F.col("last_write") > F.col("exported_at"))
    return joined.where(due).select("start_week")
