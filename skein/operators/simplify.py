"""The one Python function family: outlier removal and time-ratio simplification of legs, many at once in flat arrays.

Rows hold lists of points. Their points stand one after the other in one array for each field; a leg, and each stretch of
coverage in it, is a range of places. Every step works on all ranges at once: a level of the simplification looks at the
interior points of all segments that are still open, and splits those with a point that is too far off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Tolerances and plausibility limits.
PATH_M, ALTITUDE_FT, TRACK_DEG, SPEED_KT, RATE_FPM, IAS_KT = 50.0, 100.0, 5.0, 5.0, 100.0, 5.0
MAX_SPEED_MPS, MAX_CLIMB_FTPS, GAP_S = 500.0, 300.0, 60.0
RADIUS = 6_371_000.0
#: Points of whole rows that are worked on at once; a longer row stands alone.
SHARE_POINTS = 500_000


def shares(batch: pa.RecordBatch, column: str, limit: int = SHARE_POINTS) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` items in the lists of ``column``."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def distances(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Great-circle metres between arrays of positions."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


def _reachable(t, lat, lon, alt, a, b) -> np.ndarray:
    """Whether each report of places ``b`` can follow that of places ``a``, by speed and climb rate."""
    gap = t[b] - t[a]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (gap <= 0) | ((distances(lat[a], lon[a], lat[b], lon[b]) / gap <= MAX_SPEED_MPS) & ~(np.abs(alt[b] - alt[a]) / gap > MAX_CLIMB_FTPS))


def plausible(t, lat, lon, alt, first: np.ndarray | None = None) -> np.ndarray:
    """Which reports to keep: each is judged against the last one kept of its leg; legs begin at places ``first``.

    Between reports that are fine as they stand, judging against the neighbour is the same; only from an outlier on
    until the next report that fits does the last one kept differ. So the legs are walked through at their outliers only.
    """
    n = len(t)
    keep = np.ones(n, dtype=bool)
    begins = np.zeros(n + 1, dtype=bool)
    begins[n] = True
    begins[np.zeros(1, np.int64) if first is None else first] = True
    places = np.arange(1, n)
    bad = np.flatnonzero(~_reachable(t, lat, lon, alt, places - 1, places) & ~begins[1:n])
    done = 0
    for last in bad:
        if last < done:  # seen while an earlier outlier was walked over
            continue
        j = int(last) + 1
        while not begins[j] and not _reachable(t, lat, lon, alt, np.array([last]), np.array([j]))[0]:
            keep[j] = False
            j += 1
        done = j
    return keep


def _range_of(n: int, first: np.ndarray) -> np.ndarray:
    """The first place of the range that each place is in."""
    out = np.zeros(n, dtype=np.int64)
    out[first] = first
    return np.maximum.accumulate(out) if n else out


def _known_before(known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The nearest known place at or before each place within its range; -1 without one."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1)) if len(known) else np.zeros(0, np.int64)
    return np.where(at >= _range_of(len(known), first), at, -1)


def interpolated(t: np.ndarray, value: np.ndarray, first: np.ndarray | None = None, circular: bool = False) -> np.ndarray:
    """Missing values between known ones of their range, linear in time; the edges stay missing."""
    n, known = len(value), ~np.isnan(value)
    first = np.zeros(1, np.int64) if first is None else first
    before = _known_before(known, first)
    ends = np.append(first[1:], n)[::-1]
    after = n - 1 - _known_before(known[::-1], n - ends)[::-1] if n else before
    gaps = np.flatnonzero(~known & (before >= 0) & (after < n))
    out, a, b = value.copy(), before[gaps], after[gaps]
    span = t[b] - t[a]
    part = np.where(span > 0, (t[gaps] - t[a]) / np.where(span > 0, span, 1), 0.5)
    rise = value[b] - value[a]
    if circular:
        rise = (rise + 180) % 360 - 180
    out[gaps] = value[a] + part * rise
    if circular:
        out[gaps] %= 360
    return out


Deviation = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _part(t, a, b, k) -> np.ndarray:
    span = t[b] - t[a]
    return np.where(span > 0, (t[k] - t[a]) / np.where(span > 0, span, 1), 0.5)


def path_deviation(t, lat, lon) -> Deviation:
    """Metres of places k, between a and b, from where a steady great-circle flight from a to b would be."""
    p, q = np.radians(lat), np.radians(lon)
    unit = np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)

    def off(a, b, k):
        u = _part(t, a, b, k)[:, None]
        angle = np.arccos(np.clip((unit[a] * unit[b]).sum(1), -1, 1))[:, None]
        still = angle < 1e-12
        at = (np.sin((1 - u) * angle) * unit[a] + np.sin(u * angle) * unit[b]) / np.where(still, 1, np.sin(angle))
        return 2 * RADIUS * np.arcsin(np.clip(np.linalg.norm(unit[k] - np.where(still, unit[a], at), axis=1) / 2, 0, 1))

    return off


def value_deviation(t, value, circular: bool = False) -> Deviation:
    """Difference of each value from the straight line; missing values, and lines with a missing end, deviate by nothing."""

    def off(a, b, k):
        rise = value[b] - value[a]
        if circular:
            rise = (rise + 180) % 360 - 180
        out = np.abs(value[k] - (value[a] + _part(t, a, b, k) * rise))
        if circular:
            out %= 360
            out = np.minimum(out, 360 - out)
        return np.nan_to_num(out)

    return off


def ratio_deviation(t, value, tolerance) -> Deviation:
    """As value_deviation, in units of each place's own tolerance."""
    plain = value_deviation(t, value)
    return lambda a, b, k: plain(a, b, k) / tolerance[k]


def time_ratio(kept: np.ndarray, first: np.ndarray, tolerance: float, deviation: Deviation) -> None:
    """Mark in ``kept``, level by level, the place that is furthest off its segment (the earliest of equals), while it is by more than the tolerance.

    Segments lie between neighbouring kept places of a range; ranges begin at ``first``, and their ends are kept.
    """
    at = np.flatnonzero(kept)
    begins = np.zeros(len(kept) + 1, dtype=bool)
    begins[first] = True
    a, b = at[:-1], at[1:]
    within = ~begins[b] & (b - a > 1)
    a, b = a[within], b[within]
    while len(a):
        size = b - a - 1
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(a)), size)
        k = np.arange(len(owner)) - start[owner] + a[owner] + 1
        off = deviation(a[owner], b[owner], k)
        most = np.maximum.reduceat(off, start)
        furthest = np.minimum.reduceat(np.where(off == most[owner], k, len(kept)), start)
        split = most > tolerance
        a, b, furthest = a[split], b[split], furthest[split]
        kept[furthest] = True
        a, b = np.concatenate([a, furthest]), np.concatenate([furthest, b])
        a, b = a[b - a > 1], b[b - a > 1]


def _ends(first: np.ndarray, n: int) -> np.ndarray:
    """The first and the last place of each range."""
    kept = np.zeros(n, dtype=bool)
    if n:
        kept[first], kept[np.append(first[1:], n) - 1] = True, True
    return kept


def kept_vertices(t, lat, lon, alt, code, first: np.ndarray) -> np.ndarray:
    """Which points to keep: the ends of stretches, changes of the code, and what positions and then heights need."""
    kept = _ends(first, len(t))
    kept[1:] |= code[1:] != code[:-1]
    time_ratio(kept, first, PATH_M, path_deviation(t, lat, lon))
    time_ratio(kept, first, ALTITUDE_FT, value_deviation(t, alt))
    return kept


def _lists(mask: np.ndarray, part_first: np.ndarray, leg_parts: np.ndarray, fields: dict[str, pa.Array], missing: pa.Array | None = None) -> pa.ListArray:
    """Lists (one for each leg) of lists (one for each stretch) of structs of the marked places; ``leg_parts`` are offsets of legs among the stretches."""
    before = np.concatenate([[0], np.cumsum(mask)])
    inner = pa.array(np.append(before[part_first], before[-1]), pa.int32())
    items = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(leg_parts, pa.int32()), pa.ListArray.from_arrays(inner, items), mask=missing)


def build_all(points: pa.ListArray, clean: bool = True, simplify: bool = True) -> dict[str, pa.Array]:
    """Vertices and series of many legs (lists of airborne points in order of time): columns of as many rows.

    A leg without two points in one stretch of coverage has empty lists.
    """
    flat = points.flatten()
    number = lambda c: np.array(flat.field(c).cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    t, lat, lon, alt, track, gs, vr, ias = map(number, ("t", "lat", "lon", "alt_baro", "track", "gs", "vr", "ias"))
    coded = flat.field("squawk").cast(pa.string()).dictionary_encode()
    code, names = np.array(coded.indices.fill_null(-1), dtype=np.int64), coded.dictionary
    sizes = np.asarray(pc.fill_null(pc.list_value_length(points), 0), dtype=np.int64)
    rows = len(sizes)
    leg = np.repeat(np.arange(rows), sizes)
    keep = plausible(t, lat, lon, alt, np.flatnonzero(np.diff(leg, prepend=-1))) if clean else np.ones(len(t), bool)
    dropped = np.bincount(leg[~keep], minlength=rows)
    t, lat, lon, alt, track, gs, vr, ias, code, leg = (x[keep] for x in (t, lat, lon, alt, track, gs, vr, ias, code, leg))
    # stretches of coverage with two points or more
    new = np.ones(len(t), dtype=bool)
    new[1:] = (leg[1:] != leg[:-1]) | (np.diff(t) > GAP_S)
    part = np.cumsum(new) - 1
    long = (np.bincount(part) >= 2)[part] if len(part) else new
    t, lat, lon, alt, track, gs, vr, ias, code, leg, part = (x[long] for x in (t, lat, lon, alt, track, gs, vr, ias, code, leg, part))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    height, heading = interpolated(t, alt, first), interpolated(t, track, first, circular=True)
    filled = _known_before(code >= 0, first)
    code = np.where(filled >= 0, code[filled], -1)
    at = np.flatnonzero(kept_vertices(t, lat, lon, height, code, first)) if simplify else np.arange(len(t))
    t, lat, lon, height, heading, gs, vr, ias, code, leg, part = (x[at] for x in (t, lat, lon, height, heading, gs, vr, ias, code, leg, part))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    legs = np.concatenate([[0], np.cumsum(np.bincount(leg[first], minlength=rows))])
    whole = np.ones(len(t), dtype=bool)
    out: dict[str, pa.Array] = {"dropped": pa.array(dropped, pa.int32())}
    out["path"] = _lists(whole, first, legs, {"lon": pa.array(lon), "lat": pa.array(lat), "alt": pa.array(np.nan_to_num(height)), "t": pa.array(t)})
    # a code at each change, and the last one once more at the end
    runs = np.ones(len(t), dtype=bool)
    runs[1:] = (code[1:] != code[:-1]) | (part[1:] != part[:-1])
    runs = (runs | _ends(first, len(t))) & (code >= 0)
    out["squawk_seq"] = _lists(runs, first, legs, {"t": pa.array(t[runs]), "v": names.take(pa.array(code[runs]))})
    for name, value, tolerance, circular in (("path_tracks", heading, TRACK_DEG, True), ("path_gs", gs, SPEED_KT, False), ("path_vr", vr, RATE_FPM, False), ("path_ias", ias, IAS_KT, False)):
        mine = _ends(first, len(t))
        time_ratio(mine, first, tolerance, value_deviation(t, value, circular))
        mine &= ~np.isnan(value)
        said = value[mine] % 360 if circular else value[mine]
        out[name] = _lists(mine, first, legs, {"t": pa.array(t[mine]), "v": pa.array(np.rint(said).astype(np.int32))})
    return out


def thinned(series: pa.ListArray, tolerance: Callable[[np.ndarray], np.ndarray]) -> pa.ListArray:
    """Lists of lists of (t, v), each inner list with the values that the time-ratio rule keeps; ``tolerance`` gives it for each value."""
    inner = series.flatten()
    items, sizes = inner.flatten(), np.asarray(pc.fill_null(pc.list_value_length(inner), 0), dtype=np.int64)
    t, v = (np.array(items.field(c), dtype=np.float64) for c in ("t", "v"))
    ends = np.cumsum(sizes)
    first = (ends - sizes)[sizes > 0]
    kept = _ends(first, len(t))
    time_ratio(kept, first, 1.0, ratio_deviation(t, v, tolerance(v)))
    rows = np.asarray(pc.fill_null(pc.list_value_length(series), 0), dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), rows)[sizes > 0]  # inner lists without values go
    legs = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))])
    return _lists(kept, first, legs, {"t": pa.array(t[kept]), "v": pa.array(v[kept])}, series.is_null())


POINT = pa.struct([*((c, pa.float64()) for c in ("t", "lat", "lon", "alt_baro", "track", "gs", "vr", "ias")), ("squawk", pa.string())])


def build(points: list[dict], clean: bool = True, simplify: bool = True) -> dict:
    """The same for one leg, as plain values."""
    rows = [{f.name: p[f.name] for f in POINT} for p in points]
    return {c: v[0].as_py() for c, v in build_all(pa.array([rows], pa.list_(POINT)), clean, simplify).items()}
