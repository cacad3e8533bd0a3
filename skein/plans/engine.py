"""Pages of flights that satisfy a predicate, newest first, and the lookups around them."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import flight_id, parse_flight_id
from ..operators import lookups, rollups, tables
from ..session import cut
from .predicates import Predicate, cell_covers, from_dict, utc, uses_airframes

# Limits of a request.
MAX_WINDOW_DAYS, MAX_LIMIT = 7, 10_000
#: Keys that the index of cells gives are broadcast up to this many (some 40 bytes each); beyond that they are shuffled.
CANDIDATES = 500_000


@dataclass(frozen=True)
class Request:
    match: Predicate
    end_date: datetime | None = None
    start_from: datetime | None = None
    window_days: int = 7
    limit: int = 200
    cursor: str | None = None
    include_path: bool = True

    def __post_init__(self):
        if not 1 <= self.window_days <= MAX_WINDOW_DAYS:
            raise ValueError(f"window_days is from 1 to {MAX_WINDOW_DAYS}")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit is from 1 to {MAX_LIMIT}")
        if self.start_from is not None and self.end_date is not None and not utc(self.start_from) < utc(self.end_date):
            raise ValueError("start_from must be before end_date")


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    cursor: str | None


def token(start_ts: datetime, icao24: str) -> str:
    """A cursor after the flight (start, icao24), to the microsecond."""
    start = start_ts if start_ts.tzinfo else start_ts.replace(tzinfo=timezone.utc)
    return base64.urlsafe_b64encode(json.dumps([start.astimezone(timezone.utc).isoformat(), icao24]).encode()).decode()


def read_token(cursor: str) -> tuple[datetime, str]:
    try:
        start, icao24 = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return utc(start), icao24
    except Exception as error:
        raise ValueError("not a cursor") from error


def _micros(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def before(start_ts: datetime, icao24: str) -> Column:
    at = F.lit(utc(start_ts))
    return (F.col("start_ts") < at) | ((F.col("start_ts") == at) & (F.col("icao24") < icao24))


def in_window(low: datetime, high: datetime) -> Column:
    """start_ts in [low, high), with the weeks that can hold it, so that other partitions are not read."""
    monday = (utc(low) - timedelta(days=utc(low).weekday())).date()
    return (F.col("start_ts") >= F.lit(utc(low))) & (F.col("start_ts") < F.lit(utc(high))) & (F.col("start_week") >= F.lit(monday)) & (F.col("start_week") <= F.lit(utc(high).date()))


HEAVY = ("path", "squawk_seq", "path_tracks", "path_gs", "path_vr", "path_ias", "path_agl_ft", "alt_correction_ft", "cells")


class Engine:
    """Queries over a flights table and its dimensions; with the index of ``cells``, areas are looked up there first."""

    def __init__(self, flights: DataFrame, airframes: DataFrame | None = None, waypoints: DataFrame | None = None, airspaces: DataFrame | None = None, stats: DataFrame | None = None, cells: DataFrame | None = None):
        self.flights, self.airframes, self.waypoints, self.airspaces, self.stats, self.cells = flights, airframes, waypoints, airspaces, stats, cells

    def _near(self, rows: DataFrame, match: Predicate, keep: Column | None) -> tuple[DataFrame, DataFrame]:
        """rows that the index allows, and the columns that are left to the exact tests: without ``cells`` once those are used."""
        covers = cell_covers(match) if self.cells is not None else []
        for cover in covers:
            keys = tables.in_cells(self.cells, cover, keep)
            rows = rows.join(lookups.small(keys, CANDIDATES), [*tables.KEY, tables.WEEK], "left_semi")
        return rows, rows.drop("cells") if covers else rows

    def select(self, match: Predicate | dict, keep: Column | None = None) -> DataFrame:
        """All flights that match; the plan's filters reach the scan before any join."""
        match = from_dict(match) if isinstance(match, dict) else match
        rows = self.flights if keep is None else self.flights.where(keep)
        if uses_airframes(match):
            if self.airframes is None:
                raise ValueError("this predicate needs airframes")
            rows = lookups.with_airframes(rows, self.airframes)
            rows, left = self._near(rows, match, keep)
            return rows.where(match.column(left))
        rows, left = self._near(rows, match, keep)
        rows = rows.where(match.column(left))
        return lookups.with_airframes(rows, self.airframes) if self.airframes is not None else rows

    @classmethod
    def of_table(cls, spark, path: str, **dimensions: DataFrame) -> Engine:
        """An engine over the table at ``path`` and its index of cells, as one commit left them."""
        state = tables.current(spark, path)
        return cls(tables.read_flights(spark, path, state), cells=tables.read_cells(spark, path, state), **dimensions)

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        first, last = rollups.bounds(self.flights).first()
        return utc(first), utc(last)

    def top(self, request: Request, keep: Column) -> DataFrame:
        rows = self.select(request.match, keep)
        if not request.include_path:
            rows = rows.drop(*HEAVY)
        return rows.withColumn("flight_id", flight_id(F.col("icao24"), F.col("start_ts"))).orderBy(F.desc("start_ts"), F.desc("icao24")).limit(request.limit + 1)

    def page(self, request: Request) -> Page:
        """The newest matching flights before the cursor, in one window of days.

        A full page has a cursor after its last flight. An exhausted window has one at its floor, until start_from or
        the first flight is reached. Pages are results: their size is the request's limit.
        """
        first, last = self.bounds()
        if last is None:
            return Page([], None)
        end, keep = utc(request.end_date) or last + timedelta(microseconds=1), None
        if request.cursor:
            at, icao24 = read_token(request.cursor)
            end = min(end, at + timedelta(microseconds=1))
            keep = before(at, icao24)
        low = end - timedelta(days=request.window_days)
        low = max(low, utc(request.start_from)) if request.start_from else low
        window = in_window(low, end)
        rows = self.top(request, window if keep is None else window & keep).collect()
        if len(rows) > request.limit:
            rows = rows[: request.limit]
            return Page(rows, token(rows[-1]["start_ts"], rows[-1]["icao24"]))
        floor = max(first, utc(request.start_from)) if request.start_from else first
        return Page(rows, token(low, "") if low > floor else None)

    def pages(self, request: Request) -> Iterator[Page]:
        """Page after page until the windows are through."""
        while True:
            page = self.page(request)
            yield page
            if page.cursor is None:
                return
            request = Request(request.match, request.end_date, request.start_from, request.window_days, request.limit, page.cursor, request.include_path)

    def walk(self, request: Request) -> DataFrame:
        """All rows of ``pages``, each with its ``page`` (from 1), without a job for each page.

        Flights are numbered once, newest first, over ranges that tasks order by themselves. From wherever a window begins,
        pages are full up to the first place whose next ``limit`` + 1 flights do not lie in one window of days; so only
        windows that run out are looked up one by one, as many as the span of time has, and the pages of the run between are counted.
        """
        first, last = self.bounds()
        rows = self.select(request.match)
        rows = rows.drop(*HEAVY) if not request.include_path else rows
        if last is None:
            return rows.withColumn("page", F.lit(None).cast("int")).where(F.lit(False))
        floor = max(first, utc(request.start_from)) if request.start_from else first
        end = utc(request.end_date) or last + timedelta(microseconds=1)
        # pages begin at the end date, and windows at start_from
        rows = rows.where(F.col("start_ts") < F.lit(end))
        rows = rows.where(F.col("start_ts") >= F.lit(utc(request.start_from))) if request.start_from else rows
        rows = tables.numbered(rows.withColumn("flight_id", flight_id(F.col("icao24"), F.col("start_ts"))), [F.desc("start_ts"), F.desc("icao24")], "__n")
        n, span, moment = request.limit, request.window_days * 86_400_000_000, F.unix_micros("start_ts")
        # __n, from 1, is also how many flights are through once this one is; thin: the next page after it is not full
        ahead = rows.select((F.col("__n") - (n + 1)).alias("__n"), moment.alias("ahead"))
        places = rows.select("__n", moment.alias("us")).join(ahead, "__n", "left")
        places = cut(places.select("__n", "us", (F.col("ahead").isNull() | (F.col("ahead") < F.col("us") + 1 - span)).alias("thin")))
        runs, page, done, upto = [], 1, 0, _micros(end)
        while True:
            # the page after ``done`` flights, in the window that ends at ``upto``
            low = max(upto - span, _micros(utc(request.start_from))) if request.start_from else upto - span
            seen = places.where((F.col("__n") > done) & (F.col("__n") <= done + n + 1) & (F.col("us") >= low)).count()
            runs.append((page, done, min(seen, n)))
            if seen > n:
                done += n
                # full pages follow up to the first thin place of this run
                thin = places.where("thin").where((F.col("__n") >= done) & ((F.col("__n") - done) % n == 0)).agg(F.min("__n")).first()[0]
                full = (thin - done) // n
                runs.append((page + 1, done, full * n))
                page, done = page + 1 + full, thin
                upto = places.where(F.col("__n") == done).first()["us"] + 1
                continue
            if low <= _micros(floor):
                break
            page, done, upto = page + 1, done + seen, low + 1
        spans = rows.sparkSession.createDataFrame([r for r in runs if r[2]], "__page long, __done long, __size long")
        inside = (F.col("__n") > F.col("__done")) & (F.col("__n") <= F.col("__done") + F.col("__size"))
        out = rows.join(F.broadcast(spans), inside)
        return out.withColumn("page", (F.col("__page") + F.floor((F.col("__n") - F.col("__done") - 1) / n)).cast("int")).drop("__n", "__page", "__done", "__size")

    def flights_of(self, ids: DataFrame) -> DataFrame:
        """The flights of many ids (``flight_id``), in one join on week, aircraft and second."""
        at = F.to_timestamp(F.substring("flight_id", 8, 19), "yyyy-MM-dd'T'HH:mm:ss")
        asked = ids.select(F.lower(F.substring("flight_id", 1, 6)).alias("__icao"), at.alias("__at")).distinct()
        asked = asked.withColumn("__week", F.to_date(F.date_trunc("week", "__at")))
        same = (F.col("start_week") == F.col("__week")) & (F.col("icao24") == F.col("__icao")) & (F.date_trunc("second", "start_ts") == F.col("__at"))
        return self.flights.join(lookups.small(asked, CANDIDATES), same, "left_semi")

    def flight(self, value: str) -> DataFrame:
        """The flight of an id: the range of its second prunes weeks and row groups."""
        icao24, start = parse_flight_id(value)
        return self.flights.where((F.col("icao24") == icao24) & in_window(start, start + timedelta(seconds=1)))

    def data_range(self) -> DataFrame:
        return rollups.data_range(self.flights)

    def icao_types(self, first, last) -> DataFrame:
        if self.stats is None:
            raise ValueError("no type statistics")
        return rollups.type_counts(self.stats, first, last)

    def search_waypoints(self, query: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
        return lookups.search(self.waypoints, self.airspaces, query, kinds, limit)

    def waypoint(self, id_: str) -> DataFrame:
        return self.waypoints.where(F.col("id") == id_)

    def airport(self, code: str) -> DataFrame:
        return lookups.aerodrome_airspaces(lookups.airport(self.waypoints, code), self.airspaces)

    def airspaces_near(self, lat: float, lon: float, km: float) -> DataFrame:
        return lookups.airspaces_near(self.airspaces, lat, lon, km)
