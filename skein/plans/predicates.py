"""The query vocabulary: a tree of predicates, each of which becomes one Column over the flights table."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import series as S
from ..functions.text import norm, norm_value
from ..operators.flights import CELL
from ..operators.lookups import in_cells

# Limits of a query.
MAX_CELLS, MAX_AREA_KM2 = 1_000, 75_000.0
FL_FT = 100.0


def utc(moment: datetime | str | None) -> datetime | None:
    """A moment in UTC; one without a zone is UTC."""
    if moment is None:
        return None
    moment = datetime.fromisoformat(moment.replace("Z", "+00:00")) if isinstance(moment, str) else moment
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def _epoch(moment: datetime | None) -> float | None:
    return None if moment is None else moment.timestamp()


def _ranged(c: Column, low: float | None, high: float | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (c >= low)
    if high is not None:
        out = out & (c <= high)
    return out


class Predicate:
    def column(self, flights: DataFrame) -> Column:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class IcaoType(Predicate):
    values: tuple[str, ...]

    def column(self, flights):
        return norm(F.col("icao_type")).isin(*map(norm_value, self.values))


@dataclass(frozen=True)
class EmitterCategory(Predicate):
    values: tuple[str, ...]

    def column(self, flights):
        return norm(F.col("emitter_category")).isin(*map(norm_value, self.values))


@dataclass(frozen=True)
class CallsignPrefix(Predicate):
    prefix: str

    def column(self, flights):
        return norm(F.col("callsign")).startswith(norm_value(self.prefix))


@dataclass(frozen=True)
class RegistrationPrefix(Predicate):
    """Over flights joined with their airframes."""

    prefix: str

    def column(self, flights):
        return norm(F.col("af.registration")).startswith(norm_value(self.prefix))


@dataclass(frozen=True)
class Icao24(Predicate):
    values: tuple[str, ...]

    def column(self, flights):
        return F.col("icao24").isin(*[v.strip().lower() for v in self.values])


@dataclass(frozen=True)
class Duration(Predicate):
    min_s: float | None = None
    max_s: float | None = None

    def column(self, flights):
        return _ranged(F.col("end_t") - F.col("start_t"), self.min_s, self.max_s)


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...] = ()

    def column(self, flights):
        return reduce(lambda a, b: a & b, [p.column(flights) for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...] = ()

    def column(self, flights):
        return reduce(lambda a, b: a | b, [p.column(flights) for p in self.parts], F.lit(False))


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self, flights):
        return ~self.part.column(flights)


@dataclass(frozen=True)
class EndpointWithin(Predicate):
    """Start, end, both or either inside an area (a circle in plain degrees), within time bounds [from, to)."""

    geometry: geo.Geometry | None = None
    mode: str = "either"
    start_from: datetime | None = None
    start_to: datetime | None = None
    end_from: datetime | None = None
    end_to: datetime | None = None

    def __post_init__(self):
        if self.mode not in ("start", "end", "both", "either"):
            raise ValueError(f"unknown mode {self.mode!r}")

    def _end(self, side: str) -> Column | None:
        parts = []
        if self.geometry is not None:
            lon, lat = F.col(f"{side}_lon"), F.col(f"{side}_lat")
            g = self.geometry
            parts.append(geo.planar_degrees(lon, lat, g.lon, g.lat) <= g.radius_m / geo.DEGREE_M if isinstance(g, geo.Circle) else g.contains(lon, lat))
        low, high = (self.start_from, self.start_to) if side == "start" else (self.end_from, self.end_to)
        if low is not None:
            parts.append(F.col(f"{side}_ts") >= F.lit(utc(low)))
        if high is not None:
            parts.append(F.col(f"{side}_ts") < F.lit(utc(high)))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def column(self, flights):
        sides = {"start": ["start"], "end": ["end"]}.get(self.mode, ["start", "end"])
        groups = [g for s in sides if (g := self._end(s)) is not None]
        if not groups:
            return F.lit(True)
        return reduce((lambda a, b: a | b) if self.mode == "either" else (lambda a, b: a & b), groups)


@dataclass(frozen=True)
class Range:
    min: float | None = None
    max: float | None = None

    def __bool__(self):
        return self.min is not None or self.max is not None


@dataclass(frozen=True)
class Trajectory(Predicate):
    """What a flight did: where, when, how high, squawking which code, for how long and how far; all at once.

    ``mode`` is "intersects" (some instant satisfies all) or "within" (the whole path, or all of the time inside).
    Altitude is in feet over mean sea level ("ft") or flight levels ("fl"). dwell (s) and distance (m) measure the
    stitched path that satisfies the rest.
    """

    geometry: geo.Geometry | geo.Lines | None = None
    mode: str = "intersects"
    time_from: datetime | None = None
    time_to: datetime | None = None
    altitude: Range = field(default_factory=Range)
    unit: str = "ft"
    agl_ft: Range = field(default_factory=Range)
    squawk_codes: tuple[str, ...] = ()
    dwell_s: Range = field(default_factory=Range)
    distance_m: Range = field(default_factory=Range)
    max_cells: int = MAX_CELLS
    cell: float = CELL

    def __post_init__(self):
        if self.mode not in ("intersects", "within") or self.unit not in ("ft", "fl"):
            raise ValueError("mode is intersects or within, unit ft or fl")
        if self.geometry is None and not (self.time_from or self.time_to or self.altitude or self.agl_ft or self.squawk_codes or self.dwell_s or self.distance_m):
            raise ValueError("at least one constraint is needed")
        if self.geometry is not None and not isinstance(self.geometry, geo.Lines) and len(geo.cover(self.geometry, self.cell)) > self.max_cells:
            raise ValueError(f"the area covers over {self.max_cells} cells ({len(geo.cover(self.geometry, self.cell))}); take a smaller one")

    def _corrected(self, flights: DataFrame) -> Column:
        """The path in the altitude that the bounds are about."""
        if self.unit == "fl" or "alt_correction_ft" not in flights.columns or not self.altitude:
            return F.col("path")
        series = F.col("alt_correction_ft")
        more = lambda v: F.coalesce(S.step_at(series, v["t"], before_first=True), F.lit(0.0))
        return F.transform("path", lambda part: F.transform(part, lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"), (v["alt"] + more(v)).alias("alt"), v["t"].alias("t"))))

    def _bounds(self) -> tuple[float | None, float | None]:
        scale = FL_FT if self.unit == "fl" else 1.0
        return tuple(None if v is None else v * scale for v in (self.altitude.min, self.altitude.max))

    def _pieces(self, flights: DataFrame, stitched: bool, measure: bool, coded: bool = True) -> Column:
        """The path cut to area, window and band, and to the spans of height above ground and squawk codes.

        For the measures of a "within" predicate, altitude and height above ground do not cut.
        """
        low, high = self._bounds() if not (measure and self.mode == "within") else (None, None)
        shape = self.geometry if not isinstance(self.geometry, geo.Lines) else None
        pieces = S.clip(self._corrected(flights), shape, _epoch(utc(self.time_from)), _epoch(utc(self.time_to)), low, high, stitched)
        if self.agl_ft and not (measure and self.mode == "within"):
            pieces = S.clip_to_spans(pieces, S.linear_spans(F.col("path_agl_ft"), self.agl_ft.min, self.agl_ft.max))
        if self.squawk_codes and coded:
            pieces = S.clip_to_spans(pieces, S.spans(F.col("squawk_seq"), lambda v: v.isin(*self.squawk_codes), stitched=stitched))
        return pieces

    def column(self, flights):
        low, high = self._bounds()
        out, path = [], F.col("path")
        if self.time_from is not None:
            out.append(F.col("end_ts") >= F.lit(utc(self.time_from)))
        if self.time_to is not None:
            out.append(F.col("start_ts") < F.lit(utc(self.time_to)))
        least, most = (F.col("min_alt"), F.col("max_alt")) if self.unit == "fl" else (F.col("min_qnh_alt"), F.col("max_qnh_alt"))
        if self.altitude:
            if self.mode == "within":
                out += [least >= low] if low is not None else []
                out += [most <= high] if high is not None else []
            else:
                out += [most >= low] if low is not None else []
                out += [least <= high] if high is not None else []
        if self.squawk_codes and self.geometry is None:
            out.append(F.arrays_overlap(F.col("squawk_codes"), F.array(*map(F.lit, self.squawk_codes))))
        if self.geometry is not None:
            out += self._where(flights)
        if self.agl_ft:
            out.append(self._height(flights))
        if self.squawk_codes and self.geometry is not None:
            # a code may hold for some time inside, or be first heard at an instant inside, as that of a stretch's last report
            inside = self._pieces(flights, False, False, coded=False)
            heard = F.filter(F.flatten("squawk_seq"), lambda x: x["v"].isin(*self.squawk_codes))
            at_once = F.exists(heard, lambda x: F.exists(inside, lambda p: (p["t0"] <= x["t"] + 1e-6) & (x["t"] <= p["t1"] + 1e-6)))
            out.append(at_once | F.exists(self._pieces(flights, False, False), lambda p: p["t1"] > p["t0"]))
        out += self._measures(flights)
        return reduce(lambda a, b: a & b, out, F.lit(True))

    def _where(self, flights: DataFrame) -> list[Column]:
        g, path = self.geometry, F.col("path")
        x0, y0, x1, y1 = g.box()
        out = [(F.col("min_lon") <= x1) & (F.col("max_lon") >= x0) & (F.col("min_lat") <= y1) & (F.col("max_lat") >= y0)]
        if not isinstance(g, geo.Lines) and "cells" in flights.columns:
            out.append(in_cells(flights, geo.cover(g, self.cell)))
        if self.mode == "within":
            if isinstance(g, geo.Lines):
                return [F.lit(False)]
            out.append(S.stays_within(path, g))
            if self.time_from is not None or self.time_to is not None or self.altitude:
                low, high = self._bounds()
                out.append(F.size(S.clip(self._corrected(flights), geo.Polygon.of_box(x0, y0, x1, y1), _epoch(utc(self.time_from)), _epoch(utc(self.time_to)), low, high, False)) > 0)
        elif (self.time_from is None and self.time_to is None and not self.altitude) or isinstance(g, geo.Lines):
            out.append(S.meets(path, g))
        else:
            low, high = self._bounds()
            out.append(F.size(S.clip(self._corrected(flights), g, _epoch(utc(self.time_from)), _epoch(utc(self.time_to)), low, high, False)) > 0)
        return out

    def _height(self, flights: DataFrame) -> Column:
        agl, r = F.col("path_agl_ft"), self.agl_ft
        known = agl.isNotNull() & (F.size(F.flatten(agl)) > 0)
        if self.geometry is None:
            low, high = S.min_value(agl), S.max_value(agl)
            if self.mode == "within":
                return known & _ranged(low, r.min, None) & _ranged(high, None, r.max)
            if r.min is not None and r.max is not None:
                return known & ((F.size(S.linear_spans(agl, r.min, r.max)) > 0) | F.exists(F.flatten(agl), lambda x: (x["v"] >= r.min) & (x["v"] <= r.max)))
            return known & _ranged(high, r.min, None) & _ranged(low, None, r.max)
        spans = S.times(S.clip(self._corrected(flights), self.geometry, _epoch(utc(self.time_from)), _epoch(utc(self.time_to)), *self._bounds(), False))
        if self.mode == "intersects":
            return known & (F.size(S.overlap(S.linear_spans(agl, r.min, r.max), spans)) > 0)
        # all of the time inside: what lies outside the range has no instant in the spans
        outside = [S.linear_spans(agl, None, r.min)] if r.min is not None else []
        outside += [S.linear_spans(agl, r.max, None)] if r.max is not None else []
        strictly = [F.size(F.filter(S.overlap(x, spans), lambda s: s["b"] - s["a"] > 1e-6)) == 0 for x in outside]
        return known & (F.size(S.overlap(S.linear_spans(agl, None, None), spans)) > 0) & reduce(lambda a, b: a & b, strictly, F.lit(True))

    def _measures(self, flights: DataFrame) -> list[Column]:
        if not self.dwell_s and not self.distance_m:
            return []
        cuts = self.geometry is not None or self.time_from is not None or self.time_to is not None or bool(self.squawk_codes) or (self.mode == "intersects" and (bool(self.altitude) or bool(self.agl_ft)))
        whole = F.col("end_t") - F.col("start_t")
        if not cuts:
            return [c for r, v in ((self.dwell_s, whole), (self.distance_m, F.col("path_length_m"))) if r for c in [_ranged(v, r.min, r.max)]]
        pieces = self._pieces(flights, True, True)
        out = []
        if self.dwell_s.min is not None:  # cheap, and needed whatever cuts
            out.append(whole >= self.dwell_s.min)
        if self.dwell_s:
            out.append(_ranged(S.duration_s(pieces), self.dwell_s.min, self.dwell_s.max))
        if self.distance_m:
            out.append(_ranged(S.length_m(pieces), self.distance_m.min, self.distance_m.max))
        return out


def days(first: date, last: date) -> tuple[datetime, datetime]:
    """The moments [from, to) of calendar days, both included, in UTC."""
    if last < first:
        raise ValueError("the last day is before the first")
    start = datetime(first.year, first.month, first.day, tzinfo=timezone.utc)
    return start, datetime(last.year, last.month, last.day, tzinfo=timezone.utc) + timedelta(days=1)


def _range(x: dict | None, scale: float = 1.0) -> Range:
    x = x or {}
    value = lambda k: None if x.get(k) is None else float(x[k]) * scale
    return Range(value("min"), value("max"))


def from_dict(node: dict[str, Any]) -> Predicate:
    """A predicate from its JSON form: one key names the kind."""
    if len(node) != 1:
        raise ValueError("a predicate has exactly one key")
    (kind, x), = node.items()
    many = {"icao_type": IcaoType, "emitter_category": EmitterCategory, "icao24": Icao24}
    if kind in many:
        values = tuple(v for v in x if str(v).strip())
        if not values:
            raise ValueError(f"{kind} needs a value")
        return many[kind](values)
    if kind in ("callsign_prefix", "registration_prefix"):
        if not norm_value(x):
            raise ValueError(f"{kind} needs a value")
        return (CallsignPrefix if kind == "callsign_prefix" else RegistrationPrefix)(x)
    if kind == "duration":
        return Duration(x.get("min_s"), x.get("max_s"))
    if kind in ("and", "or"):
        return (And if kind == "and" else Or)(tuple(map(from_dict, x)))
    if kind == "not":
        return Not(from_dict(x))
    if kind not in ("endpoint_within", "trajectory_intersects", "trajectory_within") or not isinstance(x, dict):
        raise ValueError(f"not a predicate: {kind!r}")
    shape = geo.from_geojson(x["geometry"]) if x.get("geometry") else None
    if kind == "endpoint_within":
        return EndpointWithin(shape, x.get("mode", "either"), *[utc(x.get(k)) for k in ("start_from", "start_to", "end_from", "end_to")])
    alt, agl = x.get("altitude") or {}, x.get("agl_ft")
    return Trajectory(shape, kind.removeprefix("trajectory_"), utc(x.get("time_from")), utc(x.get("time_to")), _range(alt), alt.get("unit", "ft"), _range(agl), tuple(x.get("squawk_codes") or ()), _range(x.get("dwell_s")), _range(x.get("distance_m")))


def from_filter_tree(node: dict[str, Any]) -> Predicate | None:
    """A predicate from a form's filter tree: groups of mode all or any, items that may be negated.

    Empty items and groups vanish, a group of one is that one; nautical miles become metres, minutes seconds.
    """
    if "items" in node:
        parts = tuple(p for p in map(from_filter_tree, node["items"]) if p is not None)
        out = None if not parts else parts[0] if len(parts) == 1 else (And if node.get("mode", "all") == "all" else Or)(parts)
    else:
        out = _item(node)
    return Not(out) if out is not None and node.get("negate") else out


def _item(node: dict[str, Any]) -> Predicate | None:
    kind, x = node["kind"], node.get("value")
    if x in (None, "", [], {}):
        return None
    if kind == "trajectory":
        x = dict(x)
        if "distance_nm" in x:
            x["distance_m"] = {k: v * geo.NM_M for k, v in x.pop("distance_nm").items() if v is not None}
        if "dwell_min" in x:
            x["dwell_s"] = {k: v * 60 for k, v in x.pop("dwell_min").items() if v is not None}
        return from_dict({f"trajectory_{x.pop('mode', 'intersects')}": x})
    if kind == "duration_min":
        return Duration(*[None if x.get(k) is None else x[k] * 60 for k in ("min", "max")])
    return from_dict({kind: x})


def strict(node: dict[str, Any]) -> list[str]:
    """What a form would refuse before asking: empty values, bounds the wrong way round, areas that are too large."""
    said = []
    for kind, x in node.items():
        if kind in ("and", "or"):
            said += [m for n in x for m in strict(n)]
        elif kind == "not":
            said += strict(x)
        elif x in (None, "", []):
            said.append(f"{kind}: empty")
        elif isinstance(x, dict):
            for name in ("altitude", "agl_ft", "dwell_s", "distance_m"):
                r = x.get(name) or {}
                if r.get("min") is not None and r.get("max") is not None and r["min"] > r["max"]:
                    said.append(f"{kind}: {name} has its least over its most")
            if x.get("geometry") and not isinstance(shape := geo.from_geojson(x["geometry"]), geo.Lines) and shape.area_km2() > MAX_AREA_KM2:
                said.append(f"{kind}: the area is over {MAX_AREA_KM2:.0f} km2")
    return said


def cell_covers(p: Predicate) -> list[frozenset[int]]:
    """Covers of grid cells each of which every matching flight comes through; none where the predicate has no such area."""
    if isinstance(p, Trajectory):
        return [frozenset(geo.cover(p.geometry, p.cell))] if p.geometry is not None and not isinstance(p.geometry, geo.Lines) else []
    if isinstance(p, And):
        return [c for part in p.parts for c in cell_covers(part)]
    if isinstance(p, Or) and p.parts and all(parts := [cell_covers(part) for part in p.parts]):
        return [frozenset().union(*[covers[0] for covers in parts])]
    return []


def uses_airframes(p: Predicate) -> bool:
    if isinstance(p, RegistrationPrefix):
        return True
    parts = p.parts if isinstance(p, (And, Or)) else (p.part,) if isinstance(p, Not) else ()
    return any(map(uses_airframes, parts))
