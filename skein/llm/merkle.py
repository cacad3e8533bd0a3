"""A Merkle manifest of a table: a leaf for each row, a tree for each group, a root over the groups, and proofs that fold back to it.

A tree is reduced in exchanges: superblocks of 2 ** BITS consecutive nodes become one node each, until one is left. On the
way back the nodes of each superblock are cogrouped with the one row of outer nodes that their block has: the local
reduction, the join of both parts of every proof and the folding happen together, a superblock at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Levels that one exchange reduces: a superblock holds 1024 nodes.
BITS = 10
#: Rows that a task orders.
SORT_ROWS = 250_000
#: A table of where the sorted partitions begin is broadcast up to this many rows (some 60 bytes each); beyond that it is shuffled.
BROADCAST_STARTS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_OUTER = "path string, siblings array<string>, subroot string, root string"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) over the fields: ``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a stored table with ``g``) and each row's place ``pos`` within its g by ``order`` (from 0, nulls first), with the size ``n`` of g.

    Rows are dealt by ranges of (g, order) and sorted within them; a place is the rows of earlier ranges of the same g and
    the place within the range, so that no task has to hold a g. Rows that are alike in ``order`` are split by an id.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORT_ROWS))
    keys = ["g", *order, "__at"]
    ranged = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = cut(ranged.drop("__at").withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}))
    starts = placed.groupBy("g", "__part").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__size"))
    of_g = Window.partitionBy("g")  # a row for each range
    before = F.sum("__size").over(of_g.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    starts = cut(starts.select("g", "__part", "__first", before.alias("__before"), F.sum("__size").over(of_g).alias("n")))
    few = starts.limit(BROADCAST_STARTS + 1).count() <= BROADCAST_STARTS
    out = placed.join(F.broadcast(starts) if few else starts, ["g", "__part"])
    return out.withColumn("pos", F.col("__before") + F.col("__place") - F.col("__first")).drop("__part", "__place", "__first", "__before", "__size")


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def local_levels(nodes: list[str], n: int, bits: int) -> list[list[str]]:
    """The levels that a superblock's nodes go through in one exchange, in a tree of ``n`` nodes; the last has one node."""
    levels = [nodes]
    for _ in range(min(bits, (n - 1).bit_length())):
        below = levels[-1]
        levels.append([digest_of(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def way_up(levels: list[list[str]], place: int) -> tuple[str, list[str]]:
    """For each level below the top where the sibling of the node on the way stands (R, L or A for none), and the siblings."""
    path, siblings = [], []
    for level in levels[:-1]:
        other = place ^ 1
        path.append("A" if other >= len(level) else "L" if place & 1 else "R")
        if other < len(level):
            siblings.append(level[other])
        place >>= 1
    return "".join(path), siblings


def fold(digest: str, path: str, siblings: list[str]) -> str:
    """The root that a digest and its proof lead to."""
    rest: Iterator[str] = iter(siblings)
    for side in path:
        digest = digest_of(digest) if side == "A" else digest_of(next(rest), digest) if side == "L" else digest_of(digest, next(rest))
    return digest


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", bits))


def reduced(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """One exchange up: (g, pos, n, digest) of the superblocks of (g, pos, n, digest)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, n = frame.sort_values("pos"), int(frame["n"].iloc[0])
        top = local_levels(frame["digest"].tolist(), n, bits)[-1][0]
        return pd.DataFrame({"g": frame["g"].iloc[:1].tolist(), "pos": [frame["block"].iloc[0]], "n": [-(-n >> bits)], "digest": [top]})

    return _blocks(nodes, bits).select("g", "block", "pos", "n", "digest").groupBy("g", "block").applyInPandas(run, "g string, pos long, n long, digest string")


def proved(nodes: DataFrame, outer: DataFrame, bits: int = BITS) -> DataFrame:
    """One exchange down: ``nodes`` (g, pos, n, digest, row, changed) cogrouped by superblock with ``outer`` (g, pos of the superblock, and its proof).

    Gives g, pos, row, digest, the proof from the node to the root (``path``, ``siblings``), subroot, root, and what
    ``changed`` folds to with it (null where that is null).
    """

    def run(key: tuple, frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame, above = frame.sort_values("pos"), above.iloc[0]
        levels = local_levels(frame["digest"].tolist(), int(frame["n"].iloc[0]), bits)
        beyond, ways = list(above["siblings"]), [way_up(levels, k) for k in range(len(frame))]
        out = frame[["g", "pos", "row", "digest"]].copy()
        out["path"], out["siblings"] = [p + above["path"] for p, _ in ways], [s + beyond for _, s in ways]
        out["subroot"], out["root"] = above["subroot"], above["root"]
        out["folded"] = [None if c is None else fold(c, p, s) for c, p, s in zip(frame["changed"], out["path"], out["siblings"], strict=True)]
        return out

    left = _blocks(nodes, bits).select("g", "block", "pos", "n", "digest", "row", "changed").groupBy("g", "block")
    right = outer.select("g", F.col("pos").alias("block"), "path", "siblings", "subroot", "root").groupBy("g", "block")
    return left.cogroup(right).applyInPandas(run, f"g string, pos long, row string, digest string, {_OUTER}, folded string")


def _up(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes and what each exchange makes of them, until every g has one node; at least one exchange."""
    steps = [nodes]
    while len(steps) == 1 or (steps[-1].agg(F.max("n")).first()[0] or 1) > 1:
        steps.append(cut(reduced(steps[-1], bits)))
    return steps


def _down(steps: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """Proofs of the first of ``steps`` from those of the last; the tables between are a superblock's part of the one below."""
    bare = {"row": F.lit(None).cast("string"), "changed": F.lit(None).cast("string")}
    for nodes in steps[-2:0:-1]:
        outer = cut(proved(nodes.withColumns(bare), outer, bits))
    return proved(steps[0], outer, bits)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", presented: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: ``order`` and ``group`` as strings, leaf, subroot, root, path, siblings, folded, verified.

    Each group's leaves (digests of ``fields``) ascend by ``order`` and are paired level by level up to its subroot, a last
    odd one alone; the subroots, by group, likewise up to the root. ``siblings`` and ``path`` prove a leaf: ``path`` says for
    each level whether the sibling stands right (R), left (L) or is missing (A). ``presented`` replaces columns of the rows
    as they are shown to the check: ``folded`` is the root that those lead to, ``verified`` whether it is the root.

    A null group is a group of its own and comes first, as does a null ``order``; rows with the same ``order`` go by their
    leaves, and repeated rows have a leaf each. Nulls, empty and very long values are leaves like any other; an empty
    table gives an empty manifest. Columns beyond those named are left behind, so their names cannot clash. A group of any
    size is shared out in superblocks; none is held by one task.
    """
    shown = presented or {}
    g = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit(""))  # a null before all others
    leaf, changed = leaf_digest([F.col(c) for c in fields]), leaf_digest([shown.get(c, F.col(c)) for c in fields])
    leaves = cut(docs.select(g.alias("g"), F.col(order).alias("__order"), leaf.alias("digest"), changed.alias("changed") if shown else F.lit(None).cast("string").alias("changed")))
    nodes = cut(numbered(leaves, ["__order", "digest"]).withColumn("row", F.col("__order").cast("string")).drop("__order").withColumn("changed", F.coalesce("changed", "digest")))
    steps = _up(nodes, bits)
    tops = cut(steps[-1].select(F.lit("").alias("g"), F.col("g").alias("row"), "digest"))
    trees = _up(cut(numbered(tops, ["row"]).withColumn("changed", F.lit(None).cast("string"))), bits)
    peak = trees[-1].select("g", "pos", F.lit("").alias("path"), F.array().cast("array<string>").alias("siblings"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    groups = cut(_down(trees, peak, bits).select(F.col("row").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "siblings", F.col("digest").alias("subroot"), "root"))
    out = _down(steps, groups, bits)
    return out.select(F.col("row").alias(order), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group), F.col("digest").alias("leaf"), "subroot", "root", "path", "siblings", "folded", (F.col("folded") == F.col("root")).alias("verified"))


def tampered_manifest(docs: DataFrame, seventh: int = 7) -> DataFrame:
    """The manifest of documents, checked against rows of which those whose doc_id's CRC-32 ``seventh`` divides have n_chars raised by 1.

    A null doc_id is never tampered with, a null n_chars stays. Columns: doc_id, leaf, subroot, root, proof_sha256 (SHA-256 of
    the siblings), folded_root, verified.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")], F.col("n_chars").cast("long").alias("n_chars"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % seventh == 0, F.lit(False))
    out = manifest(rows, presented={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")
