"""Mixing of sources to target weights by proportionate-fair (Pfair) scheduling of blocks."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, texts

#: Rows of one block.
BLOCK_ROWS = 64
#: Rows that one numbering group holds on average; a source with more rows is numbered in several groups.
GROUP_ROWS = 4_096
#: A table of sources is broadcast up to this many rows; beyond that it is shuffled.
BROADCAST_SOURCES = 10_000
#: What a null source is called in the result and in `weights`.
NO_SOURCE = "(none)"


def schedule(share: dict[str, int]) -> Iterator[str]:
    """The source of slot 0, 1, ... without end, where a source's weight w is its part of the sum of all shares.

    Block j (from 1) of a source is released at floor((j - 1) / w) and due at ceil(j / w); each slot goes to the
    released block with the earliest deadline. So every source is always less than one block off w x t.
    """
    period = sum(share.values())
    waiting = [(0, s, 1) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // share[s]), s, j))
        _, s, j = heapq.heappop(ready)
        yield s
        heapq.heappush(waiting, (j * period // share[s], s, j + 1))
        t += 1


def timetable(share: dict[str, int], period: int) -> dict[str, list[int]]:
    """Slots of each source's blocks within one period, the sum of all shares."""
    slots: dict[str, list[int]] = {s: [] for s in share}
    for t, s in enumerate(islice(schedule(share), period)):
        slots[s].append(t)
    return slots


def turns(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[str]:
    """The source of each slot of the whole run, by the weights just as they are written (floats as exact decimal fractions).

    When a source runs out, the others go on with their weights scaled up: a new phase.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    exact = {s: Fraction(str(weights[s])) for s in left}
    whole = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    share = {s: int(w * whole) for s, w in exact.items()}
    while left:
        for s in schedule({s: share[s] for s in left}):
            yield s
            left[s] -= 1
            if not left[s]:
                del left[s]
                break


def tempered(blocks: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights proportional to a power of the sources' sizes: small sources get more than their part."""
    return {s: n**power for s, n in blocks.items()}


def _slots(counted: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """``counted`` (__source, __salt, __n) -> __source, __salt, __slots: the slots of the blocks of each numbering group.

    One task goes through the slots; it holds the groups' sizes and each source's slots of one group.
    """
    schema = T.StructType([T.StructField("__source", T.StringType()), T.StructField("__salt", T.LongType()), T.StructField("__slots", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for batch in batches:
            for s, salt, n in zip(*(batch.column(c).to_pylist() for c in ("__source", "__salt", "__n")), strict=True):
                groups[s].append((salt, n))
        for own in groups.values():
            own.sort(reverse=True)
        blocks = {s: sum(n for _, n in own) for s, own in groups.items()}
        held: dict[str, list[int]] = {s: [] for s in groups}
        done: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=schema.names)
        for t, s in enumerate(turns(blocks, weights or tempered(blocks))):
            held[s].append(t)
            if len(held[s]) == groups[s][-1][1]:
                done.append((s, groups[s].pop()[0], held[s]))
                held[s] = []
                if len(done) == 1000:
                    yield batch_of()
                    done = []
        if done:
            yield batch_of()

    return counted.select("__source", F.col("__salt").cast("long"), F.col("__n").cast("long")).coalesce(1).mapInArrow(run, schema)


def _placed(docs: DataFrame, weights: dict[str, float] | None, block_rows: int) -> tuple[DataFrame, int]:
    """``docs`` as a struct column ``row`` with source, block, slot and place, and how many slots there are."""
    spark = docs.sparkSession
    named = "source" in docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce((F.col("source") if named else F.lit(None)).cast("string"), F.lit(NO_SOURCE)).alias("__source"))
    sizes = cut(rows.groupBy("__source").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("__groups")))
    if weights is not None:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "__source string, __weight double")
        right = (F.col("__weight") > 0) & ~F.col("__weight").isin(math.inf, math.nan)
        if lacking := [r[0] for r in sizes.join(given, "__source", "left").where(~F.coalesce(right, F.lit(False))).select("__source").limit(5).collect()]:
            raise ValueError(f"no positive weight for {lacking}")
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    wide = F.broadcast(sizes) if few else sizes

    def dealt(some: DataFrame, *by) -> DataFrame:
        return some.withColumn("__hash", F.xxhash64(*by, F.lit("mix"))).join(wide, "__source").withColumn("__salt", F.pmod("__hash", "__groups")).drop("__groups")

    def sized(some: DataFrame) -> DataFrame:
        return cut(some.groupBy("__source", "__salt").agg(F.count(F.lit(1)).alias("__rows")))

    out = dealt(rows, F.col("row.doc_id"))
    groups = sized(out)
    if not groups.where(F.col("__rows") > 4 * GROUP_ROWS).isEmpty():  # null or repeated doc_ids: dealt by their places, which are written first
        rows = cut(rows.withColumn("__at", F.monotonically_increasing_id()))
        out = dealt(rows, F.col("row.doc_id"), F.col("__at")).drop("__at")
        groups = sized(out)
    running = Window.partitionBy("__source").orderBy("__salt")
    counted = groups.select("__source", "__salt", F.ceil(F.col("__rows") / block_rows).alias("__n"))
    counted = cut(counted.withColumn("__before", F.sum("__n").over(running) - F.col("__n")))
    plan = cut(counted.join(_slots(counted, weights), ["__source", "__salt"]))
    number = F.row_number().over(Window.partitionBy("__source", "__salt").orderBy("__hash", "row.doc_id")) - 1
    out = out.withColumn("__number", number).join(plan, ["__source", "__salt"])  # dealt as the window is: no further shuffle
    own = F.floor(F.col("__number") / block_rows)
    out = out.select("row", "__source", (F.col("__before") + own).cast("long").alias("__block"), F.element_at("__slots", (own + 1).cast("int")).alias("__slot"), (F.col("__number") % block_rows).cast("long").alias("__place"))
    return out, counted.agg(F.sum("__n")).first()[0] or 0


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of ``docs``: row (a struct of its columns), and its source, block (within the source, from 0),
    slot (the block's turn in the mix) and place (in the block).

    Every row stays. ``weights`` are the target weights of sources (default: square roots of their numbers of blocks);
    a source that it lacks is refused. A null source is a source of its own, "(none)". Blocks have ``block_rows`` rows;
    the last of each numbering group may have fewer. Rows of a source are dealt by a hash of doc_id, or by their places
    where null or repeated doc_ids are many, so a hot source is numbered in many tasks. An empty table gives an empty one.
    """
    out, _ = _placed(docs, weights, block_rows)
    return out.select("row", *[F.col(f"__{c}").alias(c) for c in ("source", "block", "slot", "place")])


def mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` in the order of the mix, with its own columns: files and row groups hold consecutive slots."""
    out, slots = _placed(docs, weights, block_rows)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.floor(F.col("__slot") * n / F.lit(max(1, slots))).cast("int")  # slots have no gaps, so equal ranges hold equal numbers of blocks
    return out.repartitionById(n, part).sortWithinPartitions("__slot", "__place").select("row.*")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and __rank of ``docs``, read from the Parquet files that ``mixed_order`` was written to: a row's number in that order.

    Readers may take files in another order, so it is had from the files' numbers and the rows' places in them. What
    was not read from files is written first, and so has some order.
    """
    docs = texts(docs)
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = cut(docs)
    at = docs.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("__part"), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = at.groupBy("__part", "__file").agg(F.count(F.lit(1)).alias("__n"))
    files = cut(files.select("__file", (F.sum("__n").over(Window.orderBy("__part", "__file")) - F.col("__n")).alias("__first")))  # one row a file
    return at.join(F.broadcast(files), "__file").withColumn("__rank", F.col("__first") + F.col("__row")).drop("__part", "__file", "__row", "__first")
