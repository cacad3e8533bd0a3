"""Flights from a stream of reports: each aircraft's open leg is a list of reports in state; a closed leg is a row, built by many at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import simplify
from ..operators.flights import AIR_GAP_S, FASTEST_MPS, GROUND_GAP_S, LONGEST_FLIGHT_S, LONGEST_GAP_S, OPEN_AIR_S, OPEN_GROUND_S, SLOWEST_MPS, built, measured
from ..operators.flights import REPORT as POINT

#: Late reports are taken for so long; a batch table settles after the same time.
LATENESS = "3 days"
COLUMNS = ["t", "lat", "lon", "alt_baro", "track", "gs", "vr", "ias", "squawk", "callsign", "emitter_category", "new_leg"]
REPORT = T.StructType([T.StructField(c, T.StringType() if c in ("squawk", "callsign", "emitter_category") else T.BooleanType() if c == "new_leg" else T.DoubleType()) for c in COLUMNS])
#: What the next report is judged by without reading the list: the leg's start, its last report, and the timer that is set.
LAST = T.StructType([T.StructField("start", T.DoubleType()), *[REPORT[c] for c in ("t", "lat", "lon", "alt_baro")], T.StructField("timer", T.LongType())])
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A closed leg: its airborne reports are still to be built into a path.
OUTPUT = T.StructType([T.StructField("icao24", T.StringType()), T.StructField("raw_point_count", T.IntegerType()), T.StructField("callsign", T.StringType()), T.StructField("emitter_category", T.StringType()), T.StructField("points", T.ArrayType(T.StructType([REPORT[c] for c in POINT])))])


def _parts(a: dict, b: dict) -> bool:
    """Whether report b begins a new leg after a: the pair rule of the batch builder."""
    gap = b["t"] - a["t"]
    missing = [pd.isna(x["alt_baro"]) for x in (a, b)]
    if all(missing) and gap > GROUND_GAP_S:
        return True
    if not any(missing) and gap > AIR_GAP_S:
        far = float(simplify.distances(np.array([a["lat"]]), np.array([a["lon"]]), np.array([b["lat"]]), np.array([b["lon"]]))[0])
        return bool(gap > LONGEST_GAP_S or far > FASTEST_MPS * gap or (gap > GROUND_GAP_S and far < SLOWEST_MPS * gap))
    return bool(b["new_leg"])


def _common(points: list[dict], column: str) -> str | None:
    seen = [p[column] for p in points if p[column] is not None and not pd.isna(p[column])]
    return max(dict.fromkeys(seen), key=seen.count, default=None)


def _row(icao24: str, points: list[dict]) -> dict | None:
    airborne = [{c: p[c] for c in POINT} for p in points if p["alt_baro"] is not None]
    if len(airborne) < 2:
        return None
    return {"icao24": icao24, "raw_point_count": len(points), "callsign": _common(points, "callsign"), "emitter_category": _common(points, "emitter_category"), "points": airborne}


def _split(points: list[dict]) -> list[list[dict]]:
    out = [points[:1]]
    for b in points[1:]:
        if b["t"] == out[-1][-1]["t"]:
            continue
        if b["t"] - out[-1][0]["t"] > LONGEST_FLIGHT_S or _parts(out[-1][-1], b):
            out.append([b])
        else:
            out[-1].append(b)
    return out


def _records(frame: pd.DataFrame) -> list[dict]:
    """A frame's reports; what is missing is None."""
    columns = [[None if x is None or x != x else x for x in frame[c].tolist()] for c in COLUMNS]
    return [dict(zip(COLUMNS, row, strict=True)) for row in zip(*columns, strict=True)]


class OpenLegs(StatefulProcessor):
    """The open leg of each aircraft.

    New reports are appended to the list; it is read when its leg is closed, or when a report comes that is earlier than
    the last one, and has to be put in its place. A timer closes the leg that no report has gone on with.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reports = handle.getListState("reports", REPORT)
        self.last = handle.getValueState("last", LAST)

    def _held(self) -> list[dict]:
        return [dict(zip(COLUMNS, row, strict=True)) for row in self.reports.get()]

    def _keep(self, leg: list[dict], whole: bool) -> None:
        rows = [tuple(p[c] for c in COLUMNS) for p in leg]
        if whole:
            self.reports.put(rows)
        elif rows:
            self.reports.appendList(rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = sorted((r for frame in rows for r in _records(frame)), key=lambda p: p["t"])
        state = self.last.get()
        last = dict(zip(LAST.names, state, strict=True)) if state is not None else None
        closed: list[list[dict]] = []
        if last is not None and new[0]["t"] < last["t"]:
            closed = _split(sorted(self._held() + new, key=lambda p: p["t"]))
            leg, whole = closed.pop(), True
            start, before = leg[0]["t"], leg[-1]
        else:
            leg, whole = [], last is None  # ``leg``: what comes after what is held, or, once that is closed, all of the open leg
            start, before = (last["start"], last) if last is not None else (None, None)
            for p in new:
                if before is not None and p["t"] == before["t"]:
                    continue
                if before is not None and (p["t"] - start > LONGEST_FLIGHT_S or _parts(before, p)):
                    closed.append(leg if whole else self._held() + leg)
                    leg, whole, start = [], True, None
                leg.append(p)
                start, before = p["t"] if start is None else start, p
        self._keep(leg, whole)
        wait = OPEN_GROUND_S if before["alt_baro"] is None else OPEN_AIR_S
        timer = max(int((before["t"] + wait) * 1000), timerValues.getCurrentWatermarkInMs() + 1)
        if last is None or last["timer"] != timer:
            if last is not None:
                self.handle.deleteTimer(last["timer"])
            self.handle.registerTimer(timer)
        self.last.update((start, *[before[c] for c in LAST.names[1:-1]], timer))
        yield from self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        self.reports.clear()
        self.last.clear()
        yield from self._rows(key, [held] if held else [])

    def _rows(self, key, legs: list[list[dict]]) -> Iterator[pd.DataFrame]:
        rows = [r for leg in legs if (r := _row(key[0], leg)) is not None]
        if rows:
            yield pd.DataFrame(rows, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def deduplicated(reports: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The stream with event time ``ts`` and each aircraft's repeated instants left out."""
    stamped = reports.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long")))
    return stamped.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["icao24", "ts"])


def flights_stream(reports: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Flights as their legs close: by a later report that begins a new leg, or by silence.

    State is one leg's reports for each aircraft, a record each, so a day at most (longer legs are cut); a micro-batch
    writes its new reports only. Output has the batch builder's columns. The session's state store is set to the one
    that lists and timers need.
    """
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = deduplicated(reports, lateness).select("icao24", "ts", *[F.col(c).cast(REPORT[c].dataType).alias(c) for c in COLUMNS])
    closed = rows.groupBy("icao24").transformWithStateInPandas(OpenLegs(), OUTPUT, "append", "eventTime")
    return measured(built(closed).where(F.size("path") > 0))


def into_table(flights: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Upsert each micro-batch into the flights table by (icao24, start_ts); replays write the same rows again."""
    from ..operators.writes import upsert_flights

    def write(batch: DataFrame, _: int) -> None:
        upsert_flights(batch.sparkSession, path, batch)  # computes the batch once; an empty one has no weeks to commit

    return flights.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
