"""Exact deduplication with a log-structured merge index of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, texts

#: Records of one sorted run: what a task holds of its memtable is at most this many digests.
MEMTABLE_ROWS = 1_000_000
#: A table of hits is broadcast up to this many rows (60 bytes each); beyond that it is shuffled.
BROADCAST_HITS = 400_000


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def flush(docs: DataFrame, digest, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Level 0: each task sorts the digests of its rows and flushes them as runs of at most ``memtable_rows`` records.

    A run is a Parquet file in the shared folder, ordered by digest and with a Bloom filter on it, so a later
    lookup of given digests skips the runs that cannot hold them. ``seq`` numbers the rows once and for all; ``raw`` is a
    cheap hash of the text as it stands, by which a later scan finds the rows of hits without normalising all others.
    """
    rows = texts(docs).select("doc_id", digest(normalised()).alias("digest"), F.xxhash64("text").alias("raw"), F.monotonically_increasing_id().alias("seq"))
    return cut(
        rows.sortWithinPartitions("digest", "doc_id"),
        maxRecordsPerFile=memtable_rows,
        **{"parquet__bloom__filter__enabled#digest": "true", "parquet__bloom__filter__expected__ndv#digest": str(memtable_rows), "parquet__bloom__filter__adaptive__enabled": "true"},
    )


def compact(runs: DataFrame) -> DataFrame:
    """Level 1: one record for each digest, with its smallest identifier and its number of rows."""
    return cut(runs.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).sortWithinPartitions("digest"))


def lookup(runs: DataFrame, digests: list[str]) -> DataFrame:
    """Records of a bounded list of digests; sorted runs and Bloom filters let the scan skip the others."""
    return runs.where(F.col("digest").isin(digests))


def _verified(docs: DataFrame, runs: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """Digests of which some text differs from the text of the smallest identifier, byte for byte.

    ``hits`` are the digests with two rows or more. Other texts never leave their scan, nor are they normalised: rows of
    hits are known by their raw hash, broadcast behind a count, else shuffled. The members of a large group meet copies of
    the kept text dealt by their places, so that no task gets a whole group, even one of a single doc_id.
    """
    found = cut(runs.join(hits, "digest").groupBy("raw", "digest").agg(F.first("keep_id").alias("keep_id"), F.first(F.ceil(F.col("group_size") / 64)).alias("shares")))
    few = found.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    body = texts(docs).withColumn("raw", F.xxhash64("text")).join(F.broadcast(found) if few else found, "raw").withColumn("body", normalised())
    body = body.where(digest(F.col("body")) == F.col("digest")).withColumn("place", F.monotonically_increasing_id())
    kept = body.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "shares").agg(F.first("body").alias("kept_body"))
    kept = kept.select("digest", "kept_body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("salt"))
    members = body.select("digest", "body", F.pmod(F.xxhash64("place"), F.col("shares")).alias("salt"))
    return members.join(kept, ["digest", "salt"]).where(F.encode("body", "UTF-8") != F.encode("kept_body", "UTF-8")).select("digest").distinct()


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "digest"]


def _decided(docs: DataFrame, memtable_rows: int, digest) -> tuple[DataFrame, DataFrame]:
    """COLUMNS and raw, for the rows of groups of one and for the rows of larger groups."""
    runs = flush(docs, digest, memtable_rows)
    level = compact(runs)
    clash = cut(_verified(docs, runs, level.where("group_size > 1"), digest))
    if not clash.isEmpty():  # group the clashing texts by their bytes: a digest of another kind beside the first
        second = lambda c: F.concat(F.md5(c), F.lit("-"), F.length(c), F.lit("-"), F.crc32(c))
        runs = flush(docs, lambda c: F.concat(digest(c), F.lit("/"), F.sha2(c, 512), second(c)), memtable_rows)
        level = compact(runs)
    plain = F.substring_index("digest", "/", 1).alias("digest")
    # a group of one is its own row; only rows of larger groups need the join for their keeper
    alone = level.where("group_size = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.lit(True).alias("kept"), plain)
    many = level.where("group_size > 1")
    few = many.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    members = runs.join(F.broadcast(many) if few else many, "digest")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = members.where(same).groupBy("digest").agg(F.min("seq").alias("first"))  # of repeated rows of the smallest doc_id one stays
    members = members.join(F.broadcast(first) if few else first, "digest").withColumn("kept", F.col("seq") == F.col("first"))
    return alone, members.select(*COLUMNS[:-1], plain, "raw")


def exact_duplicates(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts count as equal when they are identical after each run of white space became one space. A null text is
    an empty text; all empty texts form one group, a text of only white space (one space) another. Rows with a
    null doc_id count in their group, but stay only if no row of the group has a doc_id; then keep_id is null. Of
    repeated rows with the smallest doc_id one has kept = true. Extra columns are ignored; an empty table gives
    an empty table. A digest that two different texts share is settled by grouping those texts themselves.
    """
    alone, members = _decided(docs, memtable_rows, digest)
    return alone.select(COLUMNS).unionByName(members.select(COLUMNS))


def drop_exact_duplicates(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, as ``exact_duplicates`` decides; all columns stay.

    A row is found again by its doc_id and the hash of its text as it stands. Where the kept row itself is repeated, one
    copy stays. Columns of ``docs`` may have any names.
    """
    none = F.lit(-1 << 63)
    _, members = _decided(docs, memtable_rows, lambda text: F.sha2(text, 256))
    lost = cut(members.groupBy(F.coalesce("doc_id", none).alias("doc_id"), "raw").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    gone = lost.where(~F.col("kept")).select("doc_id", "raw")
    few = gone.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), none).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("raw"))
    out = out.join(F.broadcast(gone) if few else gone, ["doc_id", "raw"], "left_anti")
    if not lost.where(F.col("kept") & (F.col("n") > 1)).isEmpty():
        out = out.dropDuplicates(["doc_id", "raw"])
    return out.select("row.*")
