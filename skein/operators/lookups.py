"""Joins with dimensions, and searches of waypoints and airspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text

#: Degrees of the grid that points and airspaces meet in.
AREA_CELL = 0.5
#: A dimension is broadcast up to this many rows; beyond that it is shuffled.
BROADCAST_ROWS = 1_000_000


def small(dimension: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``dimension`` marked for broadcast behind a count of its rows."""
    return F.broadcast(dimension) if dimension.limit(rows + 1).count() <= rows else dimension


def with_airframes(flights: DataFrame, airframes: DataFrame) -> DataFrame:
    """flights with ``af`` (struct of the airframe, null without one)."""
    af = airframes.dropDuplicates(["icao24"])
    whole = af.select(F.col("icao24").alias("__icao"), F.struct(*[c for c in af.columns if c != "icao24"]).alias("af"))
    return flights.join(small(whole), F.col("icao24") == F.col("__icao"), "left").drop("__icao")


def with_routes(flights: DataFrame, waypoints: DataFrame) -> DataFrame:
    """flights with start_airport and end_airport (structs, null without one)."""
    out = flights
    for end in ("start", "end"):
        side = waypoints.select(F.col("id").alias("__id"), F.struct(*waypoints.columns).alias(f"{end}_airport"))
        out = out.join(small(side), F.col(f"{end}_airport_ident") == F.col("__id"), "left").drop("__id")
    return out


def in_cells(flights: DataFrame, cells: list[int]) -> Column:
    """Whether a flight's cells meet a literal cover: a pre-filter of exact tests."""
    return F.arrays_overlap(F.col("cells"), F.array(*[F.lit(c).cast("long") for c in cells]))


def airspace_edges(airspaces: DataFrame) -> DataFrame:
    """airspaces with ``edges`` and a bounding box, from rings or from box columns."""
    if "rings" in airspaces.columns:
        out = airspaces.withColumn("edges", geo.edges_of_rings(F.col("rings")))
        at = lambda f, a, b: f(F.concat(F.transform("edges", lambda e: e[a]), F.transform("edges", lambda e: e[b])))
        return out.withColumns({"min_lon": at(F.array_min, "x1", "x2"), "max_lon": at(F.array_max, "x1", "x2"), "min_lat": at(F.array_min, "y1", "y2"), "max_lat": at(F.array_max, "y1", "y2")})
    x0, y0, x1, y1 = (F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    corner = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return airspaces.withColumn("edges", F.array(*[F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(corner, corner[1:], strict=False)]))


def _in_reach(points: DataFrame, areas: DataFrame, km: float) -> DataFrame:
    """Pairs of points (lon, lat, ...) and airspaces whose widened boxes share the point's cell."""
    lat_reach = F.lit(km * 1000 / geo.DEGREE_M)
    lon_reach = lat_reach / F.cos(F.radians(F.least(F.lit(85.0), F.greatest(F.abs("min_lat"), F.abs("max_lat")) + lat_reach)))
    cells = geo.box_cells(F.col("min_lon") - lon_reach, F.col("min_lat") - lat_reach, F.col("max_lon") + lon_reach, F.col("max_lat") + lat_reach, AREA_CELL)
    side = airspace_edges(areas).withColumn("__cell", F.explode(cells))
    return points.withColumn("__cell", geo.cell(F.col("lon"), F.col("lat"), AREA_CELL)).join(side, "__cell").drop("__cell")


def containing(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Each point with each airspace that contains it, its border not included, and area_km2: a join on grid cells, then the exact test."""
    return _in_reach(points, areas, 0.0).where(geo.strictly_in_edges(F.col("edges"), F.col("lon"), F.col("lat"))).withColumn("area_km2", geo.edges_area_km2(F.col("edges"))).drop("edges")


def near(points: DataFrame, areas: DataFrame, km: float) -> DataFrame:
    """Each point with each airspace at most ``km`` away, and distance_m (0 inside)."""
    lon, lat, edges = F.col("lon"), F.col("lat"), F.col("edges")
    far = F.when(geo.in_edges(edges, lon, lat), 0.0).otherwise(geo.edge_distance(edges, lon, lat))
    return _in_reach(points, areas, km).withColumn("distance_m", far).where(F.col("distance_m") <= km * 1000).drop("edges")


def aerodrome_airspaces(airports: DataFrame, areas: DataFrame) -> DataFrame:
    """All airports with their ATZ, MATZ and CTR, smallest first in each airport's list."""
    wanted = areas.where(F.col("type_code").isin(*text.AERODROME_TYPES)).select(*[F.col(c).alias({"id": "airspace_id", "name": "airspace_name", "type_code": "airspace_type"}.get(c, c)) for c in areas.columns])
    pairs = containing(airports.select(F.col("id"), F.col("lon"), F.col("lat")), wanted)
    label = text.lookup(F.col("airspace_type"), text.AERODROME_TYPES)
    lists = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("area_km2", F.col("airspace_id").alias("id"), label.alias("type")))).alias("airspaces"))
    return airports.join(lists, "id", "left")


def search(waypoints: DataFrame, areas: DataFrame, query: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Waypoints and airspaces of which every word of the query begins a word; closed airports are hidden.

    Airports come first, then navaids, reporting points and airspaces, each by name.
    """
    words = lambda df, *more: df["tokens"] if "tokens" in df.columns else text.tokens(*[df[c] for c in more])
    open_ = waypoints.where((F.col("kind") != "airport") | F.col("type_code").isNull() | (F.col("type_code") != 8))
    hits = open_.where(text.matches_prefixes(words(open_, "name", "ident"), query)).select("id", "kind", "name", "lon", "lat")
    centred = airspace_edges(areas).where(text.matches_prefixes(words(areas, "name"), query)).withColumn("c", geo.edges_centroid(F.col("edges")))
    both = hits.unionByName(centred.select("id", F.lit("airspace").alias("kind"), "name", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat")))
    both = both if kinds is None else both.where(F.col("kind").isin(*kinds))
    order = F.when(F.col("kind") == "airport", 0).when(F.col("kind") == "navaid", 1).when(F.col("kind") == "reporting_point", 2).otherwise(3)
    return both.orderBy(order, "name", "id").limit(limit)


def airport(waypoints: DataFrame, code: str) -> DataFrame:
    """The airport with an ICAO code, else IATA code; among several the first by name."""
    wanted = text.norm_value(code)
    iata = F.upper("iata_code") == wanted if "iata_code" in waypoints.columns else F.lit(False)
    found = waypoints.where((F.col("kind") == "airport") & ((F.upper("ident") == wanted) | iata))
    return found.orderBy(F.when(F.upper("ident") == wanted, 0).otherwise(1), "name").limit(1)


def airspaces_near(areas: DataFrame, lat: float, lon: float, km: float, limit: int = 50) -> DataFrame:
    """Airspaces at most ``km`` from a position, lowest floor first."""
    point = areas.sparkSession.range(1).select(F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat"))
    order = [F.col("lower_value").asc_nulls_last()] if "lower_value" in areas.columns else []
    return near(point, areas, km).orderBy(*order, "id").limit(limit)


def altitude_bounds(lower: dict | None, upper: dict | None) -> dict:
    """An airspace's limits as bounds for an altitude predicate: flight levels if both sides are, else feet; ground is 0."""

    def feet(side):
        if not side or side.get("value") is None or side.get("unit") not in text.LIMIT_UNITS.values():
            return None
        if side.get("ref") == "gnd" and side["value"] == 0:
            return 0.0
        return side["value"] * {"m": 1 / geo.FT_M, "ft": 1.0, "fl": 100.0}[side["unit"]]

    low, high = feet(lower), feet(upper)
    units = {s["unit"] for s in (lower, upper) if s and s.get("value")}
    scale, unit = (100.0, "fl") if units == {"fl"} else (1.0, "ft")
    return {"unit": unit, "min": None if low is None else low / scale, "max": None if high is None else high / scale}


#: Kinds of search hits in the order they are shown.
KINDS = ("airport", "navaid", "reporting_point", "airspace")


def token_index(waypoints: DataFrame, areas: DataFrame) -> DataFrame:
    """(token, kind, id, name, lon, lat): a row for each word of each waypoint and airspace that a search can show.

    ``store_index`` writes it sorted by token; closed airports are not in it.
    """
    words = lambda df, *more: df["tokens"] if "tokens" in df.columns else text.tokens(*[df[c] for c in more])
    open_ = waypoints.where((F.col("kind") != "airport") | F.col("type_code").isNull() | (F.col("type_code") != 8))
    points = open_.select(F.explode(F.array_distinct(words(open_, "name", "ident"))).alias("token"), "kind", "id", "name", "lon", "lat")
    spaces = airspace_edges(areas).withColumn("c", geo.edges_centroid(F.col("edges")))
    spaces = spaces.select(F.explode(F.array_distinct(words(spaces, "name"))).alias("token"), F.lit("airspace").alias("kind"), "id", "name", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))
    return points.unionByName(spaces)


def store_index(index: DataFrame, path: str) -> None:
    """The index in ranges of tokens, sorted within them: a prefix is in a few row groups of a few files."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.repartitionByRange(parts, "token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(path)


def prefix_range(column: str, prefix: str) -> Column:
    """Whether a text begins with ``prefix``, as a range that files can be searched by, and exactly."""
    return (F.col(column) >= prefix) & (F.col(column) <= prefix + "\U0010ffff") & F.col(column).startswith(prefix)


def search_index(index: DataFrame, query: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """``search`` by the stored index: each word of the query is a range of tokens, and what all of them find is a hit."""
    from functools import reduce

    wanted = sorted({w.lower() for w in text.words(query)})
    key = ["kind", "id"]
    if not wanted:
        return index.select(*key, "name", "lon", "lat").limit(0)
    rows = index if kinds is None else index.where(F.col("kind").isin(*kinds))
    found = [rows.where(prefix_range("token", w)) for w in wanted]
    hits = reduce(lambda a, b: a.join(b.select(*key).distinct(), key, "left_semi"), found[1:], found[0])
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return hits.select(*key, "name", "lon", "lat").distinct().orderBy(order, "name", "id").limit(limit).select("id", "kind", "name", "lon", "lat")
