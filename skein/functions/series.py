"""Paths and series held in one row: segments, clipping to windows, bands and areas, and lookups by time.

A path is ARRAY<ARRAY<STRUCT<lon, lat, alt, t>>>, one inner array for each stretch of coverage; a series is
ARRAY<ARRAY<STRUCT<t, v>>>. A clip is an array of pieces (t0, lon0, lat0, t1, lon1, lat1), a span an array of (a, b).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import Circle, Geometry, Lines, _c, geodesic, geodesic_of_reduced, in_edges, once, reduced


def _pairs(values: Column, make) -> Column:
    def pairs(held):
        n = F.greatest(F.size(held) - 1, F.lit(0))
        return F.zip_with(F.slice(held, 1, n), F.slice(held, 2, n), make)

    return once([values], pairs)  # the array is named four times, and computed once


def _segment(a: Column, b: Column) -> Column:
    return F.struct(*[x[c].alias(f"{n}{k}") for k, x in ((0, a), (1, b)) for c, n in (("lon", "lon"), ("lat", "lat"), ("alt", "z"), ("t", "t"))])


def segments(path: Column, stitched: bool = True) -> Column:
    """Vertex pairs in order; stitched paths also have the pairs across coverage gaps."""
    return _pairs(F.flatten(path), _segment) if stitched else F.flatten(F.transform(path, lambda part: _pairs(part, _segment)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def path_length_m(path: Column) -> Column:
    """Geodesic length of the stitched path, without height."""
    places = F.transform(F.flatten(path), lambda v: F.struct(reduced(v["lat"]).alias("b"), v["lon"].alias("lon")))
    return total(_pairs(places, lambda p, q: geodesic_of_reduced(p["b"], p["lon"], q["b"], q["lon"], once)))


def start_value(path: Column) -> Column:
    return F.try_element_at(F.flatten(path), F.lit(1))


def end_value(path: Column) -> Column:
    return F.try_element_at(F.flatten(path), F.lit(-1))


def num_instants(path: Column) -> Column:
    return F.size(F.flatten(path))


def values(series: Column) -> Column:
    return F.transform(F.flatten(series), lambda x: x["v"])


def min_value(series: Column) -> Column:
    return F.array_min(values(series))


def max_value(series: Column) -> Column:
    return F.array_max(values(series))


def step_at(series: Column, t, before_first: bool = False) -> Column:
    """The value that holds at an instant: the latest at or before it; before the first, null or that first value."""
    flat = F.flatten(series)
    past = F.filter(flat, lambda x: x["t"] <= _c(t))
    value = F.when(F.size(past) > 0, F.try_element_at(past, F.lit(-1))["v"])
    return F.coalesce(value, F.when(F.size(flat) > 0, F.try_element_at(flat, F.lit(1))["v"])) if before_first else value


def linear_at(series: Column, t) -> Column:
    """The value between its neighbours in time; after the last that last one, before the first null."""
    t, flat = _c(t), F.flatten(series)
    past, next_ = F.filter(flat, lambda x: x["t"] <= t), F.filter(flat, lambda x: x["t"] > t)
    a, b = F.when(F.size(past) > 0, F.try_element_at(past, F.lit(-1))), F.when(F.size(next_) > 0, F.try_element_at(next_, F.lit(1)))
    return F.when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"]))


def _interval(a, b) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _linear_range(v0: Column, v1: Column, low: float | None, high: float | None) -> tuple[Column, Column]:
    """Parts [a, b] of a segment on which a linear value lies in [low, high]."""
    a, b = F.lit(0.0), F.lit(1.0)
    rise = v1 - v0
    for bound, above in ((low, True), (high, False)):
        if bound is None:
            continue
        cut = (F.lit(float(bound)) - v0) / rise
        holds = v0 >= bound if above else v0 <= bound
        goes_in = rise > 0 if above else rise < 0
        a = F.greatest(a, F.when(rise == 0, F.when(holds, 0.0).otherwise(2.0)).when(goes_in, cut).otherwise(0.0))
        b = F.least(b, F.when(rise == 0, 1.0).when(goes_in, 1.0).otherwise(cut))
    return a, b


def _area_intervals(shape: Geometry, s: Column) -> Column:
    """Parts of a segment inside a shape, in order."""
    dx, dy = s["lon1"] - s["lon0"], s["lat1"] - s["lat0"]
    if isinstance(shape, Circle):  # distance to the centre is a quadratic in the part, in a local projection
        kx, ky = F.lit(_metres_per_degree(shape.lat)[0]), F.lit(_metres_per_degree(shape.lat)[1])
        px, py = (s["lon0"] - shape.lon) * kx, (s["lat0"] - shape.lat) * ky
        vx, vy = dx * kx, dy * ky
        qa, qb, qc = vx * vx + vy * vy, 2 * (px * vx + py * vy), px * px + py * py - F.lit(shape.radius_m**2)
        root = F.sqrt(F.greatest(F.lit(0.0), qb * qb - 4 * qa * qc))
        a = F.when(qa == 0, F.when(qc <= 0, 0.0).otherwise(2.0)).when(qb * qb < 4 * qa * qc, 2.0).otherwise((-qb - root) / (2 * qa))
        b = F.when(qa == 0, 1.0).otherwise((-qb + root) / (2 * qa))
        return F.array(_interval(F.greatest(F.lit(0.0), a), F.least(F.lit(1.0), b)))
    edges = shape.column()

    def crossing(e):
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        down = dx * ey - dy * ex
        u = ((e["x1"] - s["lon0"]) * ey - (e["y1"] - s["lat0"]) * ex) / down
        w = ((e["x1"] - s["lon0"]) * dy - (e["y1"] - s["lat0"]) * dx) / down
        return F.when((down != 0) & (u > 0) & (u < 1) & (w >= 0) & (w <= 1), u)

    cuts = F.array_sort(F.concat(F.array(F.lit(0.0)), F.filter(F.transform(edges, crossing), lambda u: u.isNotNull()), F.array(F.lit(1.0))))
    middle = lambda x: once([s["lon0"] + dx * (x["a"] + x["b"]) / 2, s["lat0"] + dy * (x["a"] + x["b"]) / 2], lambda lon, lat: in_edges(edges, lon, lat))
    return F.filter(_pairs(cuts, _interval), lambda x: (x["b"] > x["a"]) & middle(x))


def _metres_per_degree(lat: float) -> tuple[float, float]:
    """East and north, on the ellipsoid."""
    import math

    from .geo import WGS84_A, WGS84_F

    e2, sin = WGS84_F * (2 - WGS84_F), math.sin(math.radians(lat))
    n = WGS84_A / math.sqrt(1 - e2 * sin * sin)
    m = WGS84_A * (1 - e2) / (1 - e2 * sin * sin) ** 1.5
    return math.radians(1) * n * math.cos(math.radians(lat)), math.radians(1) * m


def _piece(s: Column, x: Column) -> Column:
    at = lambda c, u: s[f"{c}0"] + (s[f"{c}1"] - s[f"{c}0"]) * u
    return F.struct(*[at(c, x[u]).alias(f"{c}{k}") for k, u in ((0, "a"), (1, "b")) for c in ("t", "lon", "lat", "z")])


def clip(path: Column, shape: Geometry | None = None, t_from: float | None = None, t_to: float | None = None, low: float | None = None, high: float | None = None, stitched: bool = True) -> Column:
    """Pieces of the path inside a shape, a time window [t_from, t_to) and an altitude band, all at once."""

    def pieces(s):
        a, b = F.lit(0.0), F.lit(1.0)
        for x, y in (_linear_range(s["t0"], s["t1"], t_from, t_to), _linear_range(s["z0"], s["z1"], low, high)):
            a, b = F.greatest(a, x), F.least(b, y)
        inside = F.array(_interval(F.lit(0.0), F.lit(1.0))) if shape is None else _area_intervals(shape, s)
        inside = F.filter(F.transform(inside, lambda x: _interval(F.greatest(a, x["a"]), F.least(b, x["b"]))), lambda x: x["b"] > x["a"])
        return F.transform(inside, lambda x: _piece(s, x))

    return F.flatten(F.transform(segments(path, stitched), pieces))


def clip_to_spans(pieces: Column, spans: Column) -> Column:
    """Pieces cut to an array of time spans (a, b)."""

    def one(p, spans):
        part = lambda t: (t - p["t0"]) / (p["t1"] - p["t0"])
        cut = F.transform(spans, lambda x: _interval(F.greatest(F.lit(0.0), part(x["a"])), F.least(F.lit(1.0), part(x["b"]))))
        s = F.struct(*[p[f"{c}{k}"].alias(f"{c}{k}") for k in (0, 1) for c in ("t", "lon", "lat", "z")])
        return F.transform(F.filter(cut, lambda x: x["b"] > x["a"]), lambda x: _piece(s, x))

    # the spans are computed once, not for each piece
    return once([spans], lambda held: F.flatten(F.transform(F.filter(pieces, lambda p: p["t1"] > p["t0"]), lambda p: one(p, held))))


def spans(series: Column, test, end: Column | None = None, stitched: bool = True) -> Column:
    """Time spans in which a stepwise series satisfies ``test``; the last value lasts until ``end``.

    Stitched, a value also lasts across a coverage gap, up to the next stretch's first one; else no stretch knows of the one before.
    """
    flat, run = F.flatten(series), lambda x, y: F.struct(x["t"].alias("a"), y["t"].alias("b"), x["v"].alias("v"))
    runs = _pairs(flat, run) if stitched else F.flatten(F.transform(series, lambda part: _pairs(part, run)))
    if end is not None:
        last = F.try_element_at(flat, F.lit(-1))
        tail = F.when(F.size(flat) > 0, F.array(F.struct(last["t"].alias("a"), F.greatest(last["t"], end).alias("b"), last["v"].alias("v"))))
        runs = F.concat(runs, F.coalesce(tail, F.slice(runs, 1, 0)))
    return F.transform(F.filter(runs, lambda r: test(r["v"])), lambda r: _interval(r["a"], r["b"]))


def linear_spans(series: Column, low: float | None, high: float | None) -> Column:
    """Time spans in which a linearly interpolated series lies in [low, high]."""

    def one(s):
        a, b = _linear_range(s["v0"], s["v1"], low, high)
        at = lambda u: s["t0"] + (s["t1"] - s["t0"]) * u
        return _interval(at(a), at(b))

    pairs = F.flatten(F.transform(series, lambda part: _pairs(part, lambda x, y: F.struct(x["t"].alias("t0"), x["v"].cast("double").alias("v0"), y["t"].alias("t1"), y["v"].cast("double").alias("v1")))))
    return F.filter(F.transform(pairs, one), lambda x: x["b"] > x["a"])


def overlap(a: Column, b: Column) -> Column:
    """Intersection of two arrays of spans; each array is computed once, not for each span of the other."""
    both = lambda x, y: _interval(F.greatest(x["a"], y["a"]), F.least(x["b"], y["b"]))
    shared = lambda x, b: F.filter(F.transform(b, lambda y: both(x, y)), lambda s: s["b"] > s["a"])
    return once([a, b], lambda a, b: F.flatten(F.transform(a, lambda x: shared(x, b))))


def times(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: _interval(p["t0"], p["t1"]))


def duration_s(pieces: Column) -> Column:
    return total(F.transform(pieces, lambda p: p["t1"] - p["t0"]))


def length_m(pieces: Column) -> Column:
    return total(F.transform(pieces, lambda p: geodesic(p["lat0"], p["lon0"], p["lat1"], p["lon1"], once)))


def meets(path: Column, shape: Geometry | Lines) -> Column:
    """The path, within its stretches of coverage, ever touches the shape; its border counts."""
    segs = segments(path, stitched=False)
    if isinstance(shape, Circle):
        return F.exists(F.flatten(F.transform(segs, lambda s: _area_intervals(shape, s))), lambda x: x["b"] >= x["a"])
    edges = shape.column()

    def touches(s):
        side = lambda ax, ay, bx, by, x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)

        def crosses(e):
            d1, d2 = (side(e["x1"], e["y1"], e["x2"], e["y2"], s[f"lon{k}"], s[f"lat{k}"]) for k in (0, 1))
            d3, d4 = (side(s["lon0"], s["lat0"], s["lon1"], s["lat1"], e[f"x{k}"], e[f"y{k}"]) for k in (1, 2))
            boxes = (F.least(s["lon0"], s["lon1"]) <= F.greatest(e["x1"], e["x2"])) & (F.greatest(s["lon0"], s["lon1"]) >= F.least(e["x1"], e["x2"])) & (F.least(s["lat0"], s["lat1"]) <= F.greatest(e["y1"], e["y2"])) & (F.greatest(s["lat0"], s["lat1"]) >= F.least(e["y1"], e["y2"]))
            return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)

        inside = F.lit(False) if isinstance(shape, Lines) else in_edges(edges, s["lon0"], s["lat0"])
        return inside | F.exists(edges, crosses)

    return F.exists(segs, touches)


def stays_within(path: Column, shape: Geometry) -> Column:
    """The whole path is inside the shape."""
    if isinstance(shape, Circle):
        return F.forall(F.flatten(path), lambda v: geodesic(shape.lat, shape.lon, v["lat"], v["lon"], once) < shape.radius_m)
    edges = shape.column()
    segs = segments(path, stitched=False)
    leaves = lambda s: total(F.transform(_area_intervals(shape, s), lambda x: x["b"] - x["a"])) < 1 - 1e-9
    moved = F.filter(segs, lambda s: (s["lon0"] != s["lon1"]) | (s["lat0"] != s["lat1"]))
    return F.forall(F.flatten(path), lambda v: in_edges(edges, v["lon"], v["lat"])) & ~F.exists(moved, leaves)


def box(path: Column) -> Column:
    """Bounding box and ranges of a path."""
    flat = F.flatten(path)
    take = lambda f, c: f(F.transform(flat, lambda v: v[c]))
    return F.struct(take(F.array_min, "lon").alias("min_lon"), take(F.array_min, "lat").alias("min_lat"), take(F.array_max, "lon").alias("max_lon"), take(F.array_max, "lat").alias("max_lat"))


def thin(series: Column, step: float) -> Column:
    """First and last values, and of those between the ones that differ from the last kept by ``step`` or more."""

    def one(part):
        n = F.size(part)
        empty = F.slice(part, 1, 0)
        keep = lambda kept, x: F.when((F.size(kept) == 0) | (F.abs(x["v"] - F.try_element_at(kept, F.lit(-1))["v"]) >= step), F.concat(kept, F.array(x))).otherwise(kept)
        inner = F.aggregate(F.slice(part, 1, F.greatest(n - 1, F.lit(0))), empty, keep)
        return F.when(n > 0, F.concat(inner, F.slice(part, n, 1))).otherwise(empty)

    return F.transform(series, one)


def cells_of(path: Column, size: float, reach_m: float = 11_300.0) -> Column:
    """Distinct grid cells along the path: sampled at most ``reach_m`` apart, in every stretch of coverage.

    A segment with both ends in one cell stays in it; only the others are sampled. A vertex's cell is computed once.
    """
    from .geo import cell

    def one(s):
        p, q = s["p"], s["q"]
        n = F.greatest(F.lit(1), F.ceil(geodesic(p["lat"], p["lon"], q["lat"], q["lon"], once) / reach_m).cast("int"))
        return once([n], lambda n: F.transform(F.sequence(F.lit(0), n), lambda k: cell(p["lon"] + (q["lon"] - p["lon"]) * k / n, p["lat"] + (q["lat"] - p["lat"]) * k / n, size)))

    def of_parts(parts):
        ends = F.array_distinct(F.transform(F.flatten(parts), lambda v: v["cell"]))
        pairs = F.flatten(F.transform(parts, lambda part: _pairs(part, lambda p, q: F.struct(p.alias("p"), q.alias("q")))))
        crossing = F.filter(pairs, lambda s: s["p"]["cell"] != s["q"]["cell"])
        return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(crossing, one)), ends)))

    placed = F.transform(path, lambda part: F.transform(part, lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"), cell(v["lon"], v["lat"], size).alias("cell"))))
    return once([placed], of_parts)


def densify(path: Column, reach_m: float = 90.0) -> Column:
    """The path with points between its vertices, at most about ``reach_m`` apart."""

    def one(p, q):
        n = F.greatest(F.lit(1), F.floor(geodesic_of_reduced(p["b"], p["lon"], q["b"], q["lon"], once) / reach_m).cast("int"))
        point = lambda k, n: F.struct(*[(p[c] + (q[c] - p[c]) * k / n).alias(c) for c in ("lon", "lat", "alt", "t")])
        # one segment has thousands of points: their number is computed once, not for each coordinate of each of them
        return once([n], lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: point(k, n)))

    held = lambda part: F.transform(part, lambda v: F.struct(*[v[c].alias(c) for c in ("lon", "lat", "alt", "t")], reduced(v["lat"]).alias("b")))
    return F.transform(path, lambda part: F.concat(F.slice(part, 1, 1), F.flatten(_pairs(held(part), one))))
