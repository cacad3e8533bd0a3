"""The flights table on plain Parquet: a folder for each week, versions of it, an index of grid cells, and one pointer to what holds.

A commit writes new versions of the weeks that it touches, beside the old ones, and the cells of their flights; the last
step puts a new pointer file in place of the old one. Readers go by the pointer, so they see all of a commit or nothing.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

KEY = ["icao24", "start_ts"]
#: Beside the weeks, hidden from plain readers of the folder.
POINTER, CELLS = "_current", "_cells"
WEEK, VERSION = "start_week", "version"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return bool(fs.exists(at))


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds."""
    fs, at = _path(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it is not there."""
    fs, at = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: the table's ``schema``, and ``weeks``, each with its version; None before the first commit."""
    fs, at = _path(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        body = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(body)


def swap(spark: SparkSession, path: str, state: dict) -> None:
    """Put a new pointer in place of the old one: written beside it, then renamed over it."""
    beside = f"{path}/{POINTER}.{uuid.uuid4().hex}"
    fs, at = _path(spark, beside)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    whole = fs.makeQualified(at)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(whole, fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")), over)


def _read(spark: SparkSession, path: str, state: dict | None, schema: T.StructType | None) -> DataFrame:
    if state is None:
        raise ValueError(f"no flights table at {path}")
    schema = schema or T.StructType.fromJson(state["schema"])
    chosen = [f"{path}/{WEEK}={w}/{VERSION}={v}" for w, v in sorted(state["weeks"].items())]
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*chosen).select(*schema.names)


def read_flights(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """The flights that the pointer (or ``state``) names; conditions on start_week leave out folders, others reach the files."""
    return _read(spark, path, state or current(spark, path), None)


def read_cells(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """(cell, icao24, start_ts, start_week): a row for each cell that a flight comes through, sorted by cell within a week."""
    state = state or current(spark, path)
    whole = T.StructType.fromJson(state["schema"]) if state else None
    schema = whole and T.StructType([T.StructField("cell", T.LongType()), *(whole[c] for c in (*KEY, WEEK))])
    return _read(spark, f"{path}/{CELLS}", state, schema)


def flight_cells(flights: DataFrame) -> DataFrame:
    return flights.select(F.explode("cells").alias("cell"), *KEY, WEEK)


def _write(rows: DataFrame, path: str, version: str, order: list[str]) -> None:
    """Append ``rows`` as a version of their weeks; a week is dealt to tasks by ranges of ``order``, which files follow."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, WEEK, *order).sortWithinPartitions(WEEK, *order)
    ranged.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(WEEK, VERSION).parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows``, written once, with their places in ``order``, from 1: tasks order ranges of them, and a range goes on from the sizes of those before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number of a row is its task's in the upper 31 bits, its place there in the lower 33
    ranged = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")  # a row for each range
    place = (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias(name)
    return ranged.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").select(*rows.columns, place)


def _replace(spark: SparkSession, path: str, state: dict, rows: DataFrame, touched: list[str], keep_old: bool) -> None:
    """Commit ``rows`` as all there is of the ``touched`` weeks."""
    number = state.get("commit", 0) + 1
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    _write(rows, path, version, ["start_ts", "icao24"])
    here = [w for w in touched if exists(spark, f"{path}/{WEEK}={w}/{VERSION}={version}")]
    names = T.StructType.fromJson(state["schema"]).names
    if "cells" in names and here:
        fresh = _read(spark, path, {**state, "weeks": dict.fromkeys(here, version)}, None)
        _write(flight_cells(fresh), f"{path}/{CELLS}", version, ["cell"])
    weeks = {w: v for w, v in state["weeks"].items() if w not in touched} | dict.fromkeys(here, version)
    swap(spark, path, {**state, "commit": number, "weeks": weeks})
    if not keep_old:
        vacuum(spark, path)


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove versions that the pointer does not name: those that commits replaced, and what failed ones left."""
    state = current(spark, path)
    for base in (path, f"{path}/{CELLS}"):
        for week in (f for f in folders(spark, base) if f.startswith(f"{WEEK}=")):
            versions = folders(spark, f"{base}/{week}")
            held = f"{VERSION}={state['weeks'].get(week.split('=', 1)[1])}"
            for v in versions:
                if v != held:
                    drop(spark, f"{base}/{week}/{v}")
            if held not in versions:
                drop(spark, f"{base}/{week}")


def merged(old: DataFrame, new: DataFrame, batch_date=None, key: list[str] = KEY) -> DataFrame:
    """Flights after an upsert by key: new rows replace old ones in every column.

    With ``batch_date``, old rows of that batch that are not written again are stale and go.
    """
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    if batch_date is not None:
        kept = kept.where(~F.coalesce(F.col("ingest_batch_date") == F.lit(batch_date), F.lit(False)))
    return kept.select(*new.columns).unionByName(new)


def upsert_flights(spark: SparkSession, path: str, new: DataFrame, batch_date=None, keep_old: bool = False) -> None:
    """Merge flights (start_ts, icao24, start_week, ...) into the table at ``path``, in one commit of the weeks that they or stale rows touch.

    Until the pointer is swapped, readers have the table as it was, whatever fails. ``keep_old`` leaves replaced versions
    to readers that still go by them; ``vacuum`` removes those. One commit runs at a time. Where flights have ``cells``,
    the index of cells is part of the commit. ``new`` is computed once and written aside: its weeks, its keys, the bounds
    of its ranges and its rows are read from there.
    """
    state, new = current(spark, path), cut(new)
    if state is None:
        state, old = {"schema": new.schema.jsonValue(), "weeks": {}}, None
        weeks = new.select(WEEK).distinct()
    else:
        old = _read(spark, path, state, None)
        new = new.select(*old.columns)
        weeks = new.select(WEEK).distinct()
        if batch_date is not None:
            weeks = weeks.unionByName(old.where(F.col("ingest_batch_date") == F.lit(batch_date)).select(WEEK)).distinct()
    touched = [str(r[0]) for r in weeks.collect()]  # weeks of one batch: a handful
    if not touched:
        return
    if old is not None:
        part = old.where(F.col(WEEK).isin(*[date.fromisoformat(w) for w in touched]))
        new = merged(part, new, batch_date)
    _replace(spark, path, state, new, touched, keep_old)


def drop_weeks(spark: SparkSession, path: str, before: date) -> list[str]:
    """Take the weeks that end at or before a day out of the table, whole folders of it; those weeks."""
    state = current(spark, path)
    gone = [w for w in (state or {"weeks": {}})["weeks"] if (before - date.fromisoformat(w)).days >= 7]
    if gone:
        swap(spark, path, {**state, "commit": state["commit"] + 1, "weeks": {w: v for w, v in state["weeks"].items() if w not in gone}})
        vacuum(spark, path)
    return sorted(gone)


def in_cells(cells: DataFrame, cover, keep: Column | None = None) -> DataFrame:
    """Keys of the flights that come through any cell of ``cover``: the index semi-joined with the cells, which are literals of a bounded number.

    The range of the cells reaches the files, which are sorted by cell; ``keep`` is a condition on key and week.
    """
    spark = cells.sparkSession
    rows = cells if keep is None else cells.where(keep)
    wanted = spark.createDataFrame([(int(c),) for c in cover], "cell long")
    near = rows.where(F.col("cell").between(F.lit(min(cover)), F.lit(max(cover)))) if cover else rows.where(F.lit(False))
    return near.join(F.broadcast(wanted), "cell", "left_semi").select(*KEY, WEEK).distinct()
