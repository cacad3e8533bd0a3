"""Geometry on lon/lat degrees as Column expressions; distances in metres."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere and ellipsoid, and unit factors.
EARTH_RADIUS_M = 6_371_000.0
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
DEGREE_M = 111_320.0
NM_M = 1_852.0
FT_M = 0.3048


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the argument of the arcsine is kept in [0, 1]."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def once(values: list[Column], make) -> Column:
    """``make`` of the values, each computed once: inside a higher-order function an expression is computed wherever it is written."""
    held = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.get(F.transform(F.array(held), lambda x: make(*[x[f"v{k}"] for k in range(len(values))])), F.lit(0))


def geodesic(lat1, lon1, lat2, lon2, once=lambda values, make: make(*values)) -> Column:
    """Distance on the WGS-84 ellipsoid: great circle with the Andoyer-Lambert flattening term (within 10 m in 1000 km).

    Inside a higher-order function it takes the function ``once``, else the height ``h`` alone is computed about ten times.
    """
    return once([reduced(lat1), reduced(lat2)], lambda b1, b2: geodesic_of_reduced(b1, lon1, b2, lon2, once))


def reduced(lat) -> Column:
    """The reduced latitude, in radians: along a path it is computed once for a vertex, not for each of its two segments."""
    return F.atan(F.lit(1 - WGS84_F) * F.tan(F.radians(_c(lat))))


def geodesic_of_reduced(b1, lon1, b2, lon2, once=lambda values, make: make(*values)) -> Column:
    """``geodesic`` from reduced latitudes."""
    lon1, lon2 = _c(lon1), _c(lon2)

    def measured(p, q, h, sigma):
        x = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q), F.lit(2.0)) / (1 - h)
        y = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q), F.lit(2.0)) / h
        return F.when((h <= 0) | (h >= 1), WGS84_A * sigma).otherwise(F.lit(WGS84_A) * (sigma - F.lit(WGS84_F / 2) * (x + y)))

    def between(p, q):
        half = F.radians(lon2 - lon1) / 2
        h = F.pow(F.sin(q), F.lit(2.0)) + (F.pow(F.cos(q), F.lit(2.0)) - F.pow(F.sin(p), F.lit(2.0))) * F.pow(F.sin(half), F.lit(2.0))
        h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))
        return once([h], lambda h: once([2 * F.asin(F.sqrt(h))], lambda sigma: measured(p, q, h, sigma)))

    return once([(b1 + b2) / 2, (b2 - b1) / 2], between)


def compass(heading) -> Column:
    """One of 16 points for a heading in degrees."""
    # The compass points clockwise from north.
    points = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
    return F.element_at(F.array(*map(F.lit, points)), (F.pmod(F.round(_c(heading) / 22.5).cast("int"), F.lit(16)) + 1).cast("int"))


def planar_degrees(lon1, lat1, lon2, lat2) -> Column:
    return F.hypot(_c(lon2) - _c(lon1), _c(lat2) - _c(lat1))


@dataclass(frozen=True)
class Circle:
    lon: float
    lat: float
    radius_m: float

    def __post_init__(self):
        if not self.radius_m > 0:
            raise ValueError("the radius must be positive")

    def box(self) -> tuple[float, float, float, float]:
        dlat = math.degrees(self.radius_m / EARTH_RADIUS_M)
        dlon = dlat / max(1e-6, math.cos(math.radians(self.lat)))
        return self.lon - dlon, self.lat - dlat, self.lon + dlon, self.lat + dlat

    def contains(self, lon, lat) -> Column:
        return geodesic(self.lat, self.lon, lat, lon) <= self.radius_m

    def area_km2(self) -> float:
        return math.pi * self.radius_m**2 / 1e6


@dataclass(frozen=True)
class Polygon:
    """One or more polygons, each of an outer ring and holes; rings are closed sequences of (lon, lat)."""

    rings: tuple[tuple[tuple[float, float], ...], ...]
    edges: tuple[tuple[float, float, float, float], ...] = field(init=False, repr=False)

    def __post_init__(self):
        closed = [tuple(tuple(map(float, p)) for p in (r if tuple(r[0]) == tuple(r[-1]) else (*r, r[0]))) for r in self.rings]
        object.__setattr__(self, "rings", tuple(closed))
        object.__setattr__(self, "edges", tuple((*a, *b) for r in closed for a, b in zip(r, r[1:], strict=False)))

    @classmethod
    def of_box(cls, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Polygon:
        return cls((((min_lon, min_lat), (max_lon, min_lat), (max_lon, max_lat), (min_lon, max_lat), (min_lon, min_lat)),))

    def box(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*((x, y) for r in self.rings for x, y in r), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def column(self) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for e in self.edges])

    def contains(self, lon, lat) -> Column:
        return strictly_in_edges(self.column(), lon, lat)

    def area_km2(self) -> float:
        return abs(sum(_ring_area(r) for r in self.rings[:1])) / 1e6 - sum(abs(_ring_area(r)) for r in self.rings[1:]) / 1e6


def _ring_area(ring: Sequence[tuple[float, float]]) -> float:
    """Spherical ring area in square metres."""
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        total += math.radians(x2 - x1) * (2 + math.sin(math.radians(y1)) + math.sin(math.radians(y2)))
    return total * WGS84_A**2 / 2


Geometry = Circle | Polygon


def from_geojson(shape: dict) -> Geometry | Lines:
    """Polygon, MultiPolygon and Circle areas; points and lines as ``Lines``; a collection of areas as one polygon."""
    kind, at = shape["type"], shape.get("coordinates")
    if kind == "Circle":
        return Circle(float(at[0]), float(at[1]), float(shape["radius"]))
    if kind == "Polygon":
        return Polygon(tuple(map(tuple, at)))
    if kind == "MultiPolygon":
        return Polygon(tuple(tuple(map(tuple, r)) for p in at for r in p))
    if kind == "Point":
        return Lines((((*at[:2], *at[:2])),))
    if kind == "MultiPoint":
        return Lines(tuple((*p[:2], *p[:2]) for p in at))
    if kind == "LineString":
        return Lines(tuple((*a[:2], *b[:2]) for a, b in zip(at, at[1:], strict=False)))
    if kind == "MultiLineString":
        return Lines(tuple((*a[:2], *b[:2]) for part in at for a, b in zip(part, part[1:], strict=False)))
    if kind == "GeometryCollection":
        parts = [from_geojson(g) for g in shape["geometries"]]
        if all(isinstance(p, Polygon) for p in parts):
            return Polygon(tuple(r for p in parts for r in p.rings))
        if all(isinstance(p, Lines) for p in parts):
            return Lines(tuple(e for p in parts for e in p.edges))
        raise ValueError("a collection may hold either areas or points and lines")
    raise ValueError(f"unknown geometry {kind}")


@dataclass(frozen=True)
class Lines:
    """Points (edges of no length) and lines: a path can meet them but not stay inside."""

    edges: tuple[tuple[float, float, float, float], ...]

    def box(self) -> tuple[float, float, float, float]:
        xs, ys = [e[k] for e in self.edges for k in (0, 2)], [e[k] for e in self.edges for k in (1, 3)]
        return min(xs), min(ys), max(xs), max(ys)

    column = Polygon.column


def in_edges(edges: Column, lon, lat) -> Column:
    """Even-odd ray casting over an array of edges (x1, y1, x2, y2); holes and several polygons come out right."""
    lon, lat = _c(lon), _c(lat)
    crossed = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, crossed)) % 2 == 1


def strictly_in_edges(edges: Column, lon, lat) -> Column:
    """The same without the border: ray casting alone takes in points on left and lower edges, but not those on the others."""
    lon, lat = _c(lon), _c(lat)
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    on = lambda e: between(lon, e["x1"], e["x2"]) & between(lat, e["y1"], e["y2"]) & ((e["x2"] - e["x1"]) * (lat - e["y1"]) == (e["y2"] - e["y1"]) * (lon - e["x1"]))
    return in_edges(edges, lon, lat) & ~F.exists(edges, on)


def edges_of_rings(rings: Column) -> Column:
    """Edges of a nested-array geometry column: polygons of rings of points [lon, lat]."""
    ring_edges = lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return F.flatten(F.transform(F.flatten(rings), ring_edges))


def edge_distance(edges: Column, lon, lat) -> Column:
    """Metres from a point to the nearest edge, in a local projection around the point."""
    lon, lat = _c(lon), _c(lat)
    k = F.cos(F.radians(lat)) * F.lit(DEGREE_M)

    def one(e):
        ax, ay, bx, by = (e["x1"] - lon) * k, (e["y1"] - lat) * DEGREE_M, (e["x2"] - lon) * k, (e["y2"] - lat) * DEGREE_M
        dx, dy = bx - ax, by - ay
        u = F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / (dx * dx + dy * dy))))
        return F.hypot(ax + u * dx, ay + u * dy)

    return F.array_min(F.transform(edges, one))


def within_metres(edges: Column, lon, lat, metres) -> Column:
    """Inside the area, or at most ``metres`` from its border."""
    return in_edges(edges, lon, lat) | (edge_distance(edges, lon, lat) <= _c(metres))


def edges_area_km2(edges: Column) -> Column:
    """Spherical area of an array of ring edges (outer rings one way round, holes the other)."""
    part = lambda e: F.radians(e["x2"] - e["x1"]) * (2 + F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"])))
    total = F.aggregate(F.transform(edges, part), F.lit(0.0), lambda a, x: a + x)
    return F.abs(total) * F.lit(WGS84_A**2 / 2 / 1e6)


def edges_centroid(edges: Column) -> Column:
    """Shoelace centroid (lon, lat) of an array of ring edges."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    add = lambda f: F.aggregate(F.transform(edges, f), F.lit(0.0), lambda a, x: a + x)
    area = add(cross)
    return F.struct((add(lambda e: (e["x1"] + e["x2"]) * cross(e)) / (3 * area)).alias("lon"), (add(lambda e: (e["y1"] + e["y2"]) * cross(e)) / (3 * area)).alias("lat"))


def flat_area_km2(edges: Column) -> Column:
    """Shoelace area with one cosine of latitude, as a map client shows it."""
    total = F.aggregate(F.transform(edges, lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]), F.lit(0.0), lambda a, x: a + x)
    lat = F.aggregate(F.transform(edges, lambda e: e["y1"]), F.lit(0.0), lambda a, x: a + x) / F.size(edges)
    return F.abs(total) / 2 * F.cos(F.radians(lat)) * F.lit((DEGREE_M / 1000) ** 2)


def project(lon, lat, lon0, lat0, lon1, lat1) -> Column:
    """The part u in [0, 1] of a segment that is nearest to a point."""
    lon, lat, lon0, lat0, lon1, lat1 = map(_c, (lon, lat, lon0, lat0, lon1, lat1))
    k = F.cos(F.radians(lat0))
    dx, dy = (lon1 - lon0) * k, lat1 - lat0
    u = ((lon - lon0) * k * dx + (lat - lat0) * dy) / (dx * dx + dy * dy)
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), u)))


def cell(lon, lat, size: float) -> Column:
    """A grid cell number of ``size`` degrees; neighbouring cells differ by 1 and by 100000."""
    return (F.floor((_c(lat) + 90) / size) * 100_000 + F.floor((_c(lon) + 180) / size)).cast("long")


def box_cells(min_lon, min_lat, max_lon, max_lat, size: float) -> Column:
    """All cells that a box touches."""
    rows = F.sequence(F.floor((_c(min_lat) + 90) / size).cast("long"), F.floor((_c(max_lat) + 90) / size).cast("long"))
    columns = F.sequence(F.floor((_c(min_lon) + 180) / size).cast("long"), F.floor((_c(max_lon) + 180) / size).cast("long"))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: r * 100_000 + c)))


def cover(shape: Geometry, size: float) -> list[int]:
    """Cells of a literal shape: those its box touches, for a circle only those near enough."""
    x0, y0, x1, y1 = shape.box()
    out = []
    for r in range(math.floor((y0 + 90) / size), math.floor((y1 + 90) / size) + 1):
        for c in range(math.floor((x0 + 180) / size), math.floor((x1 + 180) / size) + 1):
            if isinstance(shape, Circle):
                near_lat = min(max(shape.lat, r * size - 90), (r + 1) * size - 90)
                near_lon = min(max(shape.lon, c * size - 180), (c + 1) * size - 180)
                dy, dx = math.radians(near_lat - shape.lat), math.radians(near_lon - shape.lon)
                a = math.sin(dy / 2) ** 2 + math.cos(math.radians(shape.lat)) * math.cos(math.radians(near_lat)) * math.sin(dx / 2) ** 2
                if 2 * EARTH_RADIUS_M * math.asin(math.sqrt(a)) > shape.radius_m * 1.01:
                    continue
            out.append(r * 100_000 + c)
    return out
