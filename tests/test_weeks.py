"""The table of weeks: commits, pruning, the index of cells, retention."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.functions import geo
from skein.operators import tables
from skein.plans import catalog, catalog_tables
from skein.plans import predicates as P
from skein.plans.engine import Engine, Request, in_window

SF = "/root/testdata/sf0.001"
MONDAY = date(2025, 3, 31)
SCHEMA = "icao24 string, start_ts timestamp, n int, ingest_batch_date date, cells array<bigint>, start_week date"


def rows(spark, *given):
    """(icao24, days after MONDAY, n, batch day, cells)"""
    at = lambda d: datetime.combine(MONDAY, datetime.min.time()) + timedelta(days=d)
    return spark.createDataFrame([(i, at(d), n, MONDAY + timedelta(days=b), c, MONDAY + timedelta(days=d - d % 7)) for i, d, n, b, c in given], SCHEMA)


def content(spark, path):
    return {(r.icao24, r.n) for r in tables.read_flights(spark, path).collect()}


def index(spark, path):
    return {(r.icao24, r.cell) for r in tables.read_cells(spark, path).collect()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "flights")
    tables.upsert_flights(spark, path, rows(spark, ("a", 0, 1, 0, [7, 8]), ("b", 1, 1, 0, [8]), ("c", 8, 1, 8, [9])))
    return path


def test_commit_replaces_whole_weeks(spark, table):
    before = tables.current(spark, table)
    tables.upsert_flights(spark, table, rows(spark, ("a", 0, 2, 0, [5]), ("d", 2, 2, 0, [])), MONDAY)
    assert content(spark, table) == {("a", 2), ("d", 2), ("c", 1)} and index(spark, table) == {("a", 5), ("c", 9)}
    after = tables.current(spark, table)
    assert after["commit"] == before["commit"] + 1 and after["weeks"]["2025-04-07"] == before["weeks"]["2025-04-07"]  # an untouched week keeps its files
    # plain readers of the folder see the same, as replaced versions are gone
    assert {(r.icao24, r.n) for r in spark.read.parquet(table).collect()} == content(spark, table)


@pytest.mark.parametrize("step", ["_write of flights", "_write of cells", "swap"])
def test_a_failing_commit_leaves_the_old_table(spark, table, monkeypatch, step):
    """Whatever step fails, readers have the table as it was, and the next commit goes through."""
    was, cells = content(spark, table), index(spark, table)
    plain, calls = getattr(tables, step.split()[0]), []

    def failing(*given):
        calls.append(given)
        if len(calls) == 2 or step != "_write of cells":
            if step.startswith("_write"):
                plain(*given)  # the files are there, but nothing names them
            raise OSError("lost")
        return plain(*given)

    with monkeypatch.context() as m:
        m.setattr(tables, step.split()[0], failing)
        with pytest.raises(OSError):
            tables.upsert_flights(spark, table, rows(spark, ("a", 0, 9, 0, [1]), ("e", 15, 9, 15, [2])), MONDAY)
    assert content(spark, table) == was and index(spark, table) == cells
    tables.upsert_flights(spark, table, rows(spark, ("a", 0, 3, 0, [1])), MONDAY)
    assert content(spark, table) == {("a", 3), ("c", 1)} and index(spark, table) == {("a", 1), ("c", 9)}
    left = [f for base, _, files in os.walk(table) for f in files if f.endswith(".parquet")]
    assert len(left) == 4 and not os.path.exists(f"{table}/start_week=2025-04-14")  # what failed is swept up


def test_a_reader_keeps_its_version(spark, table):
    seen = tables.read_flights(spark, table)
    tables.upsert_flights(spark, table, rows(spark, ("a", 0, 2, 0, [7])), keep_old=True)
    assert {(r.icao24, r.n) for r in seen.collect()} == {("a", 1), ("b", 1), ("c", 1)}
    assert content(spark, table) == {("a", 2), ("b", 1), ("c", 1)}
    tables.vacuum(spark, table)
    assert len(tables.folders(spark, f"{table}/start_week=2025-03-31")) == 1 and content(spark, table) == {("a", 2), ("b", 1), ("c", 1)}


def test_empty_batches_and_emptied_weeks(spark, table):
    was = tables.current(spark, table)
    tables.upsert_flights(spark, table, rows(spark, ("a", 0, 1, 0, [])).limit(0))
    assert tables.current(spark, table) == was
    tables.upsert_flights(spark, table, rows(spark, ("f", 1, 4, 8, [3])), MONDAY + timedelta(days=8))  # c was that batch's
    assert content(spark, table) == {("a", 1), ("b", 1), ("f", 4)} and set(tables.current(spark, table)["weeks"]) == {"2025-03-31"}
    with pytest.raises(ValueError):
        tables.read_flights(spark, f"{table}/elsewhere")


def test_weeks_are_dropped_as_folders(spark, table):
    assert tables.drop_weeks(spark, table, MONDAY + timedelta(days=6)) == []
    assert tables.drop_weeks(spark, table, MONDAY + timedelta(days=7)) == ["2025-03-31"]
    assert content(spark, table) == {("c", 1)} and index(spark, table) == {("c", 9)}
    assert not os.path.exists(f"{table}/start_week=2025-03-31") and not os.path.exists(f"{table}/_cells/start_week=2025-03-31")
    assert tables.drop_weeks(spark, f"{table}/elsewhere", MONDAY) == []


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def weekly(spark):
    return Engine.of_table(spark, catalog_tables.weekly_path(spark, SF))


def test_windows_read_only_their_weeks(spark, weekly):
    window = in_window(catalog_tables.moment(catalog_tables.WEEK_S), catalog_tables.moment(catalog_tables.WEEK_S + 60))
    said = plan(weekly.select(P.And(()), window))
    assert "PartitionFilters: [isnotnull(start_week" in said and "start_week" in said.split("PartitionFilters:")[1].split("]")[0]
    scanned = weekly.select(P.And(()), window)
    scanned.collect()
    scan = [n for n in str(scanned._jdf.queryExecution().executedPlan().toString()).splitlines() if "FileScan" in n]
    assert scan and all("PartitionFilters: [isnotnull(start_week" in n for n in scan)
    one = weekly.flight(f"{weekly.flights.first()['icao24']}:2024-01-08T00:00:00Z")
    assert "PartitionFilters: [isnotnull(start_week" in plan(one)


def test_areas_go_through_the_index(spark):
    engine = Engine.of_table(spark, catalog.flights_path(spark, SF))
    match = P.Trajectory(geo.Polygon.of_box(*catalog.BOX))
    chosen = engine.select(match)
    said = plan(chosen)
    assert "LeftSemi" in said and "_cells" in said and "arrays_overlap" not in said
    plainly = Engine(engine.flights).select(match)
    key = lambda df: {(r.icao24, r.start_ts) for r in df.collect()}
    assert key(chosen) == key(plainly) and key(chosen)
    box = lambda *b: P.Trajectory(geo.Polygon.of_box(*b))
    for tree in (box(-2, 50, 4, 56) & box(0, 50, 8, 60), box(-2, 50, 0, 52) | box(5, 50, 8, 60), ~box(-2, 50, 4, 56), box(-2, 50, 4, 56) | P.CallsignPrefix("BAW"), box(170, -80, 171, -79)):
        assert key(engine.select(tree)) == key(Engine(engine.flights).select(tree))
    assert P.cell_covers(~match) == [] and P.cell_covers(match | P.CallsignPrefix("B")) == [] and len(P.cell_covers(match & match)) == 2


def test_pages_over_weeks(spark, weekly):
    for limit in (1, 4, 10_000):
        pages = list(weekly.pages(Request(P.And(()), limit=limit, include_path=False)))
        seen = [(r.start_ts, r.icao24) for p in pages for r in p.rows]
        assert seen == sorted(seen, reverse=True) and len(seen) == len(set(seen)) == weekly.flights.count()
        assert all(len(p.rows) <= limit for p in pages) and pages[-1].cursor is None


def test_walk_is_page_after_page_without_a_job_for_each(spark, weekly):
    first, last = weekly.bounds()
    some = weekly.flights.orderBy("start_ts").limit(40).select("icao24", "start_ts", "start_t", "start_week")
    # a dense week, 16 days of nothing, and a few more flights
    late = some.limit(9).withColumn("start_ts", F.col("start_ts") + F.expr("INTERVAL 23 DAYS")).withColumn("start_week", F.date_add("start_week", 21))
    for engine, more in ((weekly, {}), (Engine(some.unionByName(late).cache()), {}), (weekly, {"start_from": first + (last - first) / 3, "end_date": last}), (weekly, {"window_days": 1})):
        for limit in (1, 3, 4, 10_000):
            if limit == 1 and engine is weekly:
                continue
            asked = Request(P.And(()), limit=limit, include_path=False, **more)
            want = {(k, r.icao24, r.start_ts) for k, page in enumerate(engine.pages(asked), 1) for r in page.rows}
            got = engine.walk(asked).select("page", "icao24", "start_ts").collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_flights_of_ids(spark, weekly):
    from skein.functions import text

    ids = weekly.flights.select(text.flight_id(F.col("icao24"), F.col("start_ts")).alias("flight_id")).orderBy("flight_id").limit(5)
    want = {(r.icao24, r.start_ts) for i in ids.collect() for r in weekly.flight(i.flight_id).collect()}
    assert {(r.icao24, r.start_ts) for r in weekly.flights_of(ids).collect()} == want and len(want) >= 5


def test_flights_that_start_at_one_instant_are_all_looked_up(spark, tmp_path):
    from skein.plans import catalog

    for name in ("nation", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # users four apart fly in the same week; the second copies start at the same instants
    top = 4 * (events.agg(F.max("user_id")).first()[0] + 1)
    events.unionByName(events.withColumn("user_id", F.col("user_id") + top).withColumn("event_id", F.col("event_id") + 10**9)).write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.QUERIES["t02_flight_lookup"](spark, str(tmp_path)).groupBy("start_week", "start_t").count().collect()
    assert found and all(r["count"] % 2 == 0 for r in found)


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    from skein.session import stored

    source = str(tmp_path / "in.parquet")
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(source)

    for n in (3, 3, 5):
        if n != 3 or not made:
            spark.range(n).write.mode("overwrite").parquet(source)
        assert stored(spark, f"rows of {source}", build, [source]).count() == n
    assert len(made) == 2
