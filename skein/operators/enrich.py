"""What other tables add to flights: pressure, terrain, airports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import series as S
from ..functions.geo import haversine
from ..session import cut
from . import simplify

# Hectopascals to feet around the standard pressure, and the airport rules.
STANDARD_HPA, FT_PER_HPA, THIN_FT = 1013.25, 27.3, 30.0
AIRPORT_M, AIRPORT_AGL_FT = 5_000.0, 1_000.0
HELIPORT_TYPES, CLOSED_TYPE, ROTORCRAFT = (4, 7), 8, "A7"
#: Degrees of latitude and longitude that airport candidates are looked up in: over AIRPORT_M up to 60 degrees north.
AIRPORT_CELL = 0.1
TILE_PIXELS = 1200
#: Values of a grid's blocks that are broadcast at most (8 bytes each).
BROADCAST_VALUES = 4_000_000
MIN_CLEARANCE_FT, CLEARANCE_PART = 50.0, 0.015


def vertices(flights: DataFrame, key: list[str]) -> DataFrame:
    """One row for each vertex: the key, its stretch ``part``, its place ``k``, lon, lat, alt, t."""
    return flights.select(*key, F.posexplode("path").alias("part", "__p")).select(*key, "part", F.posexplode("__p").alias("k", "__v")).select(*key, "part", "k", "__v.*")


def regrouped(rows: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """(t, v) series by stretch from vertex rows: the inverse of ``vertices`` for one value."""
    parts = rows.groupBy(*key, "part").agg(F.array_sort(F.collect_list(F.struct("t", value.alias("v")))).alias("__s"))
    whole = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "__s"))).alias("__w"))
    return whole.select(*key, F.transform("__w", lambda w: w["__s"]).alias(name))


AXES = ("t", "lat", "lon")
#: Steps of a pressure block along t, lat and lon, and pixels of a terrain block along a side; a block's upper edges are the next block's lower ones.
PRESSURE_BLOCK, TERRAIN_BLOCK = (4, 16, 16), 120


def cube_axes(cube: DataFrame) -> DataFrame:
    """One row with the sorted values of each axis of a grid: a few thousand of each at most."""
    return cube.agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}_axis") for c in AXES])


def _blocks_of(at: Column, size: int, n: Column) -> Column:
    """Blocks that hold a place of an axis of ``n`` values: its own, and as an upper edge the one before."""
    own = F.floor(at / size).cast("int")
    edge = (at % size == 0) & (at > 0)
    last = (at == n - 1) & (n > 1)  # the last value is only an edge
    return F.when(edge & last, F.array(own - 1)).when(edge, F.array(own - 1, own)).otherwise(F.array(own))


def _side(block: Column, size: int, n: Column) -> Column:
    """How many places of an axis of ``n`` values a block holds."""
    return F.least(F.lit(size + 1), n - block * size)


def _packed(samples: DataFrame, key: list[str], whole: Column) -> DataFrame:
    """(key, block_places, block_values) from (key, place, value): values in order of place; places only where some of the ``whole`` are missing."""
    rows = samples.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"), F.first(whole).alias("whole"))
    places = F.when(F.size("s") != F.col("whole"), F.transform("s", lambda x: x["place"]))
    return rows.select(*key, places.alias("block_places"), F.transform("s", lambda x: x["value"]).alias("block_values"))


def _value(place: Column) -> Column:
    """The value of a block's place; null where it is missing."""
    at = F.when(F.col("block_places").isNull(), place).otherwise((F.array_position("block_places", place) - 1).cast("int"))
    return F.get("block_values", at)


def _met(rows: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """rows with their block, by a left join; few blocks are brought to the rows, else all rows of a block would wait for one task."""
    n = blocks.agg(F.sum(F.size("block_values"))).first()[0] or 0
    return rows.join(F.broadcast(blocks) if n <= BROADCAST_VALUES else blocks, key, "left")


def pressure_blocks(cube: DataFrame, axes: DataFrame | None = None, size: tuple[int, int, int] = PRESSURE_BLOCK) -> DataFrame:
    """(block_t, block_lat, block_lon, block_places, block_values): a row for each block of a grid, with its samples as one array.

    Blocks overlap by one step, so all eight corners around a position are in one row. Written once, it serves many builds.
    """
    axes = cube_axes(cube) if axes is None else axes
    out = cube.select(*AXES, "hpa")
    for c in AXES:  # an axis is short: its values and their places are broadcast
        places = axes.select(F.posexplode(f"{c}_axis").alias(f"{c}_at", c), F.size(f"{c}_axis").alias(f"{c}_n"))
        out = out.join(F.broadcast(places), c)
    for c, s in zip(AXES, size, strict=True):
        out = out.withColumn(f"block_{c}", F.explode(_blocks_of(F.col(f"{c}_at"), s, F.col(f"{c}_n"))))
    sides = [_side(F.col(f"block_{c}"), s, F.col(f"{c}_n")) for c, s in zip(AXES, size, strict=True)]
    t, y, x = (F.col(f"{c}_at") - F.col(f"block_{c}") * s for c, s in zip(AXES, size, strict=True))
    samples = out.select(*[f"block_{c}" for c in AXES], ((t * sides[1] + y) * sides[2] + x).cast("int").alias("place"), F.col("hpa").alias("value"), (sides[0] * sides[1] * sides[2]).alias("__whole"))
    return _packed(samples, [f"block_{c}" for c in AXES], F.col("__whole"))


def _low(axis: Column, value: Column) -> Column:
    """Place of the last axis value at or below ``value``, but never the last of all; on an even axis it is computed, else searched."""
    n = F.size(axis)
    top = F.greatest(n - 2, F.lit(0))
    first, last = F.get(axis, F.lit(0)), F.get(axis, n - 1)
    guess = F.greatest(F.lit(0), F.least(top, F.floor((value - first) / (last - first) * (n - 1)).cast("int")))
    fits = (F.get(axis, guess) <= value) & (value <= F.get(axis, guess + 1))
    return F.when(n < 2, 0).when(fits, guess).otherwise(F.greatest(F.lit(0), F.least(top, F.size(F.filter(axis, lambda x: x <= value)) - 1)))


def pressure_at(rows: DataFrame, cube: DataFrame, row_key: list[str] | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """rows (t, lat, lon, ...) with ``hpa``, tri-linear in time (clamped), latitude (clamped) and longitude (modulo 360).

    A row meets the one block that holds its eight corners by an equi-join on the block's places, and reads them there.
    A missing sample counts for nothing; with none of the eight, hpa is null. ``row_key`` is not needed any more.
    """
    axes = cut(cube_axes(cube))
    blocks = cut(pressure_blocks(cube, axes)) if blocks is None else blocks
    out = rows.crossJoin(F.broadcast(axes))  # one row
    lon = F.pmod("lon", F.lit(360.0))
    clamped = lambda c: F.greatest(F.get(f"{c}_axis", F.lit(0)), F.least(F.get(f"{c}_axis", F.size(f"{c}_axis") - 1), F.col(c).cast("double")))
    out = out.withColumns({"__t": clamped("t"), "__lat": clamped("lat"), "__lon": lon})
    out = out.withColumns({f"__{c}0": _low(F.col(f"{c}_axis"), F.col(f"__{c}")) for c in AXES})
    low = {c: F.get(f"{c}_axis", F.col(f"__{c}0")) for c in AXES}
    high = {c: F.get(f"{c}_axis", F.col(f"__{c}0") + 1) for c in AXES}
    out = out.withColumns({f"__{c}w": F.coalesce((F.col(f"__{c}") - low[c]) / (high[c] - low[c]), F.lit(0.0)) for c in AXES} | {f"__{c}n": F.size(f"{c}_axis") for c in AXES})
    inside = F.col("__lonw").between(0, 1)  # a longitude beyond the cube's has no value
    size = dict(zip(AXES, PRESSURE_BLOCK, strict=True))
    out = out.withColumns({f"block_{c}": F.floor(F.col(f"__{c}0") / size[c]).cast("int") for c in AXES}).drop(*[f"{c}_axis" for c in AXES])
    met = _met(out, blocks, [f"block_{c}" for c in AXES])
    side = {c: _side(F.col(f"block_{c}"), size[c], F.col(f"__{c}n")) for c in AXES}
    sums, found = F.lit(0.0), F.lit(False)
    for corner in range(8):
        step = {c: corner >> k & 1 for k, c in enumerate(AXES)}
        t, y, x = (F.col(f"__{c}0") - F.col(f"block_{c}") * size[c] + step[c] for c in AXES)
        weight = F.lit(1.0)
        for c in AXES:
            weight = weight * (F.col(f"__{c}w") if step[c] else 1 - F.col(f"__{c}w"))
        value = F.when(weight != 0, _value((t * side["lat"] + y) * side["lon"] + x))
        sums, found = sums + F.coalesce(weight * value, F.lit(0.0)), found | value.isNotNull()
    return met.withColumn("hpa", F.when(inside & found, sums)).select(*rows.columns, "hpa")


def correction_ft(hpa: Column) -> Column:
    return F.coalesce(F.nanvl((hpa - STANDARD_HPA) * FT_PER_HPA, F.lit(0.0)), F.lit(0.0))


def with_pressure(flights: DataFrame, cube: DataFrame, key: list[str] | None = None) -> DataFrame:
    """flights with alt_correction_ft: the step series to add to pressure altitudes, thinned to steps of 30 ft."""
    key = key or ["icao24", "start_ts"]
    rows = pressure_at(vertices(flights, key), cube)
    found = regrouped(rows, key, F.round(correction_ft(F.col("hpa")), 4), "__c")
    return flights.join(found, key, "left").withColumn("alt_correction_ft", S.thin(F.col("__c"), THIN_FT)).drop("__c")


def terrain_blocks(dem: DataFrame, pixels: int = TILE_PIXELS, size: int = TERRAIN_BLOCK) -> DataFrame:
    """(tile_lat, tile_lon, block_row, block_col, block_places, block_values): a row for each block of a tile, with its pixels as one array.

    Blocks overlap by one pixel, so the four pixels around a position are in one row. Written once, it serves many builds.
    """
    n = F.lit(pixels)
    out = dem.withColumn("block_row", F.explode(_blocks_of(F.col("row"), size, n))).withColumn("block_col", F.explode(_blocks_of(F.col("col"), size, n)))
    high, wide = _side(F.col("block_row"), size, n), _side(F.col("block_col"), size, n)
    key = ["tile_lat", "tile_lon", "block_row", "block_col"]
    place = (F.col("row") - F.col("block_row") * size) * wide + F.col("col") - F.col("block_col") * size
    return _packed(out.select(*key, place.cast("int").alias("place"), F.col("elev_ft").alias("value"), (high * wide).alias("__whole")), key, F.col("__whole"))


def terrain_at(rows: DataFrame, dem: DataFrame, row_key: list[str] | None = None, pixels: int = TILE_PIXELS, blocks: DataFrame | None = None) -> DataFrame:
    """rows (lat, lon, ...) with ``terrain_ft``: bilinear over four pixel centres, clamped within the tile; no tile, 0 ft.

    A row meets the one block that holds its four pixels by an equi-join, and reads them there. ``row_key`` is not needed
    any more.
    """
    blocks = cut(terrain_blocks(dem, pixels)) if blocks is None else blocks
    y, x = F.floor("lat"), F.floor("lon")
    top = F.lit(pixels - 1.0)
    at = {"row": (F.lit(1.0) - (F.col("lat") - y)) * pixels - 0.5, "col": (F.col("lon") - x) * pixels - 0.5}
    out = rows.withColumns({"tile_lat": y.cast("int"), "tile_lon": x.cast("int")} | {f"__{c}": F.greatest(F.lit(0.0), F.least(top, v)) for c, v in at.items()})
    out = out.withColumns({f"__{c}0": F.greatest(F.lit(0), F.least(F.lit(pixels - 2), F.floor(f"__{c}").cast("int"))) for c in at})
    out = out.withColumns({f"block_{c}": F.floor(F.col(f"__{c}0") / TERRAIN_BLOCK).cast("int") for c in at})
    met = _met(out, blocks, ["tile_lat", "tile_lon", "block_row", "block_col"])
    wide = _side(F.col("block_col"), TERRAIN_BLOCK, F.lit(pixels))
    total = F.lit(0.0)
    for a in (0, 1):
        for b in (0, 1):
            wr, wc = F.col("__row") - F.col("__row0"), F.col("__col") - F.col("__col0")
            place = (F.col("__row0") - F.col("block_row") * TERRAIN_BLOCK + a) * wide + F.col("__col0") - F.col("block_col") * TERRAIN_BLOCK + b
            total = total + F.coalesce((wr if a else 1 - wr) * (wc if b else 1 - wc) * _value(place.cast("int")), F.lit(0.0))
    return met.withColumn("terrain_ft", total).select(*rows.columns, "terrain_ft")


def with_agl(flights: DataFrame, dem: DataFrame, key: list[str] | None = None, reach_m: float = 90.0, pixels: int = TILE_PIXELS, thin: bool = True) -> DataFrame:
    """flights with path_agl_ft: height above terrain along the densified path, thinned (or not) by time-ratio simplification."""
    key = key or ["icao24", "start_ts"]
    dense = flights.withColumn("path", S.densify(F.col("path"), reach_m))
    more = F.coalesce(S.step_at(F.col("alt_correction_ft"), F.col("t"), before_first=True), F.lit(0.0)) if "alt_correction_ft" in flights.columns else F.lit(0.0)
    carried = vertices(dense, key) if "alt_correction_ft" not in flights.columns else dense.select(*key, "alt_correction_ft", F.posexplode("path").alias("part", "__p")).select(*key, "alt_correction_ft", "part", F.posexplode("__p").alias("k", "__v")).select(*key, "alt_correction_ft", "part", "k", "__v.*")
    rows = terrain_at(carried.withColumn("__high", F.col("alt") + more).drop("alt_correction_ft"), dem, pixels=pixels)
    found = regrouped(rows, key, F.round(F.col("__high") - F.col("terrain_ft"), 4), "__agl")
    return flights.join(thinned_agl(found, key) if thin else found.withColumnRenamed("__agl", "path_agl_ft"), key, "left")


def thinned_agl(found: DataFrame, key: list[str]) -> DataFrame:
    """Each stretch's heights (``__agl``) by the time-ratio rule, with a tolerance that grows with the height."""
    schema = T.StructType([*[found.schema[k] for k in key], T.StructField("path_agl_ft", found.schema["__agl"].dataType)])
    tolerance = lambda v: np.maximum(MIN_CLEARANCE_FT, CLEARANCE_PART * np.abs(v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), simplify.thinned(batch.column("__agl"), tolerance)], names=schema.names)

    return found.select(*key, "__agl").mapInArrow(run, schema)


def nearest_airport(points: DataFrame, airports: DataFrame, metres: float = AIRPORT_M) -> DataFrame:
    """points (key, lat, lon, emitter_category, agl) with airport_id and airport_m: the best open airport within reach.

    Rotorcraft take heliports before fixed-wing airports, all others fixed-wing ones only; closed ones are never taken,
    and points known to be over 1000 ft above ground have none. Both sides meet in grid cells, the airports in the cells
    around theirs too; columns of cells widen with latitude, so that no neighbour is missed up to 85 degrees.
    """
    stretch = lambda lat: F.greatest(F.lit(1.0), F.floor(1 / F.cos(F.radians(F.least(F.lit(85.0), F.abs(F.floor(lat) + 1))))) + 1)
    key = lambda lon, lat: F.struct(F.floor(lat / AIRPORT_CELL).alias("r"), F.floor(lon / AIRPORT_CELL).alias("c"))
    wide = F.sequence((-stretch(F.col("lat"))).cast("int"), stretch(F.col("lat")).cast("int"))
    around = F.flatten(F.transform(wide, lambda dc: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda dr: F.struct((F.floor(F.col("lat") / AIRPORT_CELL) + dr).alias("r"), (F.floor(F.col("lon") / AIRPORT_CELL) + dc).alias("c")))))
    side = airports.where(F.coalesce(F.col("type_code") != CLOSED_TYPE, F.lit(True))).select(F.col("id").alias("airport_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.coalesce(F.col("type_code").isin(*HELIPORT_TYPES), F.lit(False)).alias("a_heli"), F.explode(around).alias("cell"))
    low = points.where(F.col("agl").isNull() | (F.col("agl") <= AIRPORT_AGL_FT)).withColumn("cell", key(F.col("lon"), F.col("lat")))
    far = haversine(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"))
    helicopter = F.coalesce(F.col("emitter_category") == ROTORCRAFT, F.lit(False))
    pairs = low.join(side, "cell").withColumn("airport_m", far).where((F.col("airport_m") <= metres) & (helicopter | ~F.col("a_heli")))
    best = pairs.groupBy("key").agg(F.min(F.struct((~F.col("a_heli")).alias("fixed"), F.col("airport_m").alias("m"), F.col("airport_id").alias("id"))).alias("best"))
    return points.join(best, "key", "left").withColumn("airport_id", F.col("best.id")).withColumn("airport_m", F.col("best.m")).drop("best")


def with_airports(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """flights with start_airport_ident and end_airport_ident: ids of the airports at their ends."""
    out = flights
    agl = lambda t: S.step_at(F.col("path_agl_ft"), t, before_first=True) if "path_agl_ft" in flights.columns else F.lit(None).cast("double")
    for end in ("start", "end"):
        rows = flights.select(F.struct("icao24", "start_t").alias("key"), F.col(f"{end}_lat").alias("lat"), F.col(f"{end}_lon").alias("lon"), "emitter_category", agl(F.col(f"{end}_t")).alias("agl"))
        found = nearest_airport(rows, airports).select(F.col("key.icao24").alias("icao24"), F.col("key.start_t").alias("start_t"), F.col("airport_id").alias(f"{end}_airport_ident"))
        out = out.join(found, ["icao24", "start_t"], "left")
    return out


def backfilled(flights: DataFrame, column: str, compute) -> DataFrame:
    """flights in which ``compute`` (flights -> flights with ``column``) fills the rows where it is null."""
    have, lack = flights.where(F.col(column).isNotNull()), flights.where(F.col(column).isNull()).drop(column)
    return have.unionByName(compute(lack).select(*flights.columns))
