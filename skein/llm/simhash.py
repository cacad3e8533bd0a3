"""SimHash fingerprints by meet-in-the-middle ball hashing, and near duplicates by the same, completed by prefixes of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SLICE_BYTES, batches_of, cut, cut_instead, slices, texts, words_of
from .graph import components
from .substring import _mix

#: A side of a join is broadcast up to this many rows of some 40 bytes; beyond that it is shuffled.
BROADCAST_ROWS = 500_000
#: Texts that share a shingle are compared pair by pair up to this many, beyond it with heads first.
BUCKET = 32
#: Turns in which members of larger buckets are compared with HEADS of them, before what is left is compared pair by pair.
ROUNDS = 2
HEADS = 3
#: 64-bit words of a text's parities.
PARITY = 8
#: Rows of texts, and of pairs of texts, that Spark and a Python task hold at once.
BATCH_ROWS, BATCH_PAIRS = 2_000, 500
#: Bytes of them: long texts come in smaller batches.
BATCH_BYTES = 4 << 20
#: Shingles at most that are put last in the order of shingles (8 bytes each, in every worker).
FREQUENT = 500_000


def shingle_hashes(column: pa.Array, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of ``size`` words (repeats included), and how many each row has.

    A row of fewer words has one shingle, its whole sequence; a row of none has none.
    """
    lengths, flat = words_of(pc.ascii_lower(column))
    words = flat.to_pylist()
    hashed, counts, start = [], np.zeros(len(lengths), dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    for row, n in enumerate(lengths.tolist()):
        own = [w.encode() for w in words[start : start + n]]
        start += n
        if not n:
            continue
        if n <= size:
            hashed.append(digest(b" ".join(own), seed))
            counts[row] = 1
            continue
        line = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashed.extend([digest(line[s:e], seed) for s, e in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)])
        counts[row] = n - size + 1
    return np.array(hashed, dtype=np.uint64), counts


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; further lanes are independent mixes of it."""
    if not lane:
        return hashes
    x = hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, counts: np.ndarray, at_once: int = 1 << 17) -> np.ndarray:
    """For each row the 64 bits that over half of its hashes have; zero for a row without hashes."""
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for start in range(0, len(hashes), at_once):
        part, own = hashes[start : start + at_once], owner[start : start + at_once]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    over = 2 * ones > counts[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1, at_once: int = SLICE_BYTES) -> DataFrame:
    """doc_id, tkey (a hash of the text, to tell rows of one doc_id apart) and f0, f1, ...: 64-bit fingerprints as longs.

    A task holds the words of ``at_once`` bytes of text.
    """
    rows = texts(docs).withColumn("tkey", F.xxhash64("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "tkey", *(f"f{k}" for k in range(lanes)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", at_once):
                hashes, counts = shingle_hashes(part.column("text"), shingle)
                prints = [pa.array(majority(_lane(hashes, k), counts, min(1 << 17, max(1 << 12, at_once >> 5))).view(np.int64)) for k in range(lanes)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), *prints], names=schema.names)

    return rows.mapInArrow(run, schema)


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the low ``bits`` bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def ball_links(prints: DataFrame, bits: int = 64, radius: int = 2) -> DataFrame:
    """``prints`` (table, f: distinct) -> links (table, a, b) of fingerprints at ``radius`` or fewer differing bits.

    Every fingerprint emits all variants within half the radius; two fingerprints at the radius share a variant.
    Those that meet on a variant are within the radius of each other, so each is linked to the smallest one there:
    no pair lists, yet no component is lost. A variant has at most one ball of fingerprints, which bounds its group.
    """
    if radius % 2:
        raise ValueError("the radius must be even: each side emits half of it")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radius // 2)])
    emitted = prints.select("table", "f", F.explode(masks).alias("mask")).select("table", "f", F.col("f").bitwiseXOR(F.col("mask")).alias("variant"))
    met = emitted.withColumn("a", F.min("f").over(Window.partitionBy("table", "variant"))).where("a <> f")
    return met.select("table", "a", F.col("f").alias("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of fingerprints at ``radius`` or fewer differing bits.
    A null text is an empty text; texts without words have fingerprint zero, which is linked like any other. Texts of
    fewer words than a shingle are one shingle. Rows with a null doc_id take part; the id of a component without any
    doc_id is null. Repeated rows give repeated results. Extra columns are ignored; an empty table gives an empty one.
    """
    rows = cut(fingerprints(docs, shingle))
    prints = rows.groupBy("f0").agg(F.min("doc_id").alias("least"))
    links = ball_links(prints.select(F.lit(0).alias("table"), F.col("f0").alias("f")), 64, radius)
    found = components(links.select("a", "b"))
    named = prints.join(found, F.col("f0") == F.col("node"), "left").select("f0", "least", F.coalesce("component", "f0").alias("component"))
    named = cut(named)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "component").select("f0", "component_id")
    return rows.join(of, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's distinct shingles of ``size`` words (A-Z lower-cased), ascending, and how many each row has.

    A row of fewer words has one shingle, its whole sequence; a row of none has none.
    """
    lengths, flat = words_of(pc.ascii_lower(column))
    coded = flat.dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    words = names[np.asarray(coded.indices, dtype=np.int64)] if len(names) else np.zeros(0, np.uint64)
    ends, each = np.cumsum(lengths), np.where(lengths > size, lengths - size + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(lengths)), each)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each - (ends - lengths), each)
    run = np.minimum(lengths, size)[owner]
    hashes = run.astype(np.uint64)
    for k in range(size):
        inside = k < run
        hashes[inside] = _mix(hashes[inside] * np.uint64(0x9E3779B97F4A7C15) ^ words[first[inside] + k])
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, bool)
    return hashes[new], np.bincount(owner[new], minlength=len(lengths)).astype(np.int64)


def _jaccard(pairs: DataFrame, size: int) -> DataFrame:
    """Exact similarity of the shingle sets of ``text_a`` and ``text_b``."""
    schema = T.StructType([*pairs.drop("text_a", "text_b").schema, T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 18):
                sides = []
                for name in ("text_a", "text_b"):
                    hashes, counts = shingle_sets(part.column(name), size)
                    sides.append(np.split(hashes, np.cumsum(counts)[:-1]))
                alike = []
                for a, b in zip(*sides, strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    alike.append(both / max(1, len(a) + len(b) - both))
                kept = [part.column(c) for c in schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(alike, pa.float64())], names=schema.names)

    return pairs.mapInArrow(run, schema)


def prefixes(rows: DataFrame, shingle: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """h, node, size, pos: of each text's ``size`` distinct shingles the first few in one order of all shingles.

    Two texts at ``similarity`` share so many shingles that they share one of these. The order is that of hashes, with
    the ``frequent`` ones (ascending) last; which ones these are does not matter for what is found, only for the work.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    schema = T.StructType.fromDDL("h long, node long, size int, pos int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes, counts = shingle_sets(part.column("text"), shingle)
                owner = np.repeat(np.arange(len(counts)), counts)
                if len(often) and len(hashes):
                    late = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
                    hashes = hashes[np.lexsort((hashes, late, owner))]
                pos = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
                keep = pos <= (counts - np.ceil(similarity * counts - 1e-9))[owner]
                own = owner[keep]
                columns = [pa.array(hashes[keep].view(np.int64)), part.column("node").take(pa.array(own)), pa.array(counts[own], pa.int32()), pa.array(pos[keep], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("node", "text").mapInArrow(run, schema)


def parities(rows: DataFrame, shingle: int, words: int = PARITY) -> DataFrame:
    """node, parity (p0, p1, ...: longs): each bit says whether an odd number of the text's distinct shingles fall on it.

    Two texts' parities differ in no more bits than their sets do in shingles, so too many such bits rule a pair out.
    """
    names = [f"p{k}" for k in range(words)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("node", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes, counts = shingle_sets(part.column("text"), shingle)
                place = np.repeat(np.arange(len(counts)), counts) * (64 * words) + (hashes % np.uint64(64 * words)).astype(np.int64)
                odd = (np.bincount(place, minlength=len(counts) * 64 * words) & 1).astype(np.uint8).reshape(len(counts), 64 * words)
                packed = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("node"), *[pa.array(np.ascontiguousarray(packed[:, k])) for k in range(words)]], names=schema.names)

    return rows.select("node", "text").mapInArrow(run, schema).select("node", F.struct(*names).alias("parity"))


def ball_pairs(rows: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Candidates (a, b) among the nodes of ``rows`` (node, text) by ball hashing, as many as nodes and links of fingerprints.

    Nodes of one fingerprint hang on the smallest of them, and these on each other where their fingerprints link.
    """
    # words are Python objects here, many times their bytes: they are held a quarter of a megabyte at once, in bounded batches
    with batches_of(rows.sparkSession, BATCH_ROWS, BATCH_BYTES):
        prints = cut(fingerprints(rows.select(F.col("node").alias("doc_id"), "text"), shingle, at_once=1 << 18).select(F.col("doc_id").alias("node"), "f0"))
    heads = prints.groupBy("f0").agg(F.min("node").alias("head"))
    same = prints.join(heads, "f0").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = ball_links(heads.select(F.lit(0).alias("table"), F.col("f0").alias("f")), 64, radius).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    end = lambda c: heads.select(F.col("f0").alias(f"f{c}"), F.col("head").alias(c))
    return same.unionByName(links.join(end("a"), "fa").join(end("b"), "fb").select("a", "b"))


def near_duplicate_links(rows: DataFrame, shingle: int = 5, similarity: float = 0.8, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b, similarity) between the nodes of ``rows`` (node, text) whose components are those of all pairs at ``similarity`` or more.

    Texts whose fingerprints ball hashing links are compared first. Fingerprints alone lose pairs; so what is then still apart
    is compared where it shares a shingle of the texts' prefixes, which loses no pair. Shingles in the prefixes of more than ``bucket``
    texts go to the end of the order. A text leaves a bucket where even its smallest text is too large for it: the sizes
    and the place of the shared shingle bound the overlap. In buckets that are still large, all members are compared
    with a few heads, in the first turn those with the fewest other shingles before the shared one, as the text has that others were copied
    from, later the same ones in as many buckets as may be; then only texts of different components need be
    compared, first with other heads, after ``rounds`` turns pair by pair. Pairs come out of a bucket only where the texts' parities
    don't rule them out, which loses none. Every link is verified on the texts' sets.
    """
    spark = rows.sparkSession
    counts = prefixes(rows, shingle, similarity, np.zeros(0, np.uint64)).groupBy("h").count().where(F.col("count") > bucket)
    with batches_of(spark, BATCH_ROWS, BATCH_BYTES):
        frequent = np.sort(counts.orderBy(F.desc("count")).limit(FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    items = prefixes(rows, shingle, similarity, frequent)
    # two texts of sizes x and y have similarity t only if they share t / (1 + t) (x + y) shingles, none of them before this one
    most = F.floor((F.col("size") - F.col("pos")) * ((1 + similarity) / similarity) - F.col("size") + 1e-6).cast("int")
    with batches_of(spark, BATCH_ROWS, BATCH_BYTES):
        items = cut(items.withColumn("most", most).drop("pos"))
    if not rows.groupBy("node").count().where("count > 1").isEmpty():
        items = cut_instead(items, items.dropDuplicates(["h", "node"]))
    for _ in range(2):
        small = items.groupBy("h").agg(F.min("size").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
        items = cut_instead(items, items.drop("members").join(small, "h").where("most >= least").drop("least"))
    items = cut_instead(items, items.drop("members").join(items.groupBy("h").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "h"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b), a before b, with their similarity where that is high enough."""
        pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        body = cut(rows.select("node", "text").join(F.broadcast(wanted) if few else wanted, "node").dropDuplicates(["node"]))
        side = lambda c: body.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        with batches_of(spark, BATCH_PAIRS, BATCH_BYTES):
            return cut(_jaccard(pairs.join(side("a"), "a").join(side("b"), "b"), shingle).where(F.col("similarity") >= similarity))

    links = [verified(ball_pairs(rows))]

    def labelled(some: DataFrame) -> DataFrame:
        """With ``of``, the component so far of each node."""
        found = components(reduce(DataFrame.unionByName, links).select("a", "b"))
        few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return some.join(F.broadcast(found) if few else found, "node", "left").withColumn("of", F.coalesce("component", "node")).drop("component")

    def open_buckets(some: DataFrame) -> DataFrame:
        """Buckets that hold texts of several components."""
        several = some.groupBy("h").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("h")
        return cut(some.join(several, "h"))

    with batches_of(spark, BATCH_ROWS, BATCH_BYTES):
        marks = cut(parities(rows, shingle).dropDuplicates(["node"]))
    # sets at the similarity differ in so many shingles at most
    unlike = sum((F.bit_count(F.col(f"parity_a.p{k}").bitwiseXOR(F.col(f"parity_b.p{k}"))) for k in range(PARITY)), F.lit(0))
    differ = F.floor((F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    fit = (F.col("of_a") != F.col("of_b")) & (F.col("size_a") <= F.col("most_b")) & (F.col("size_b") <= F.col("most_a")) & (unlike <= differ)
    side = lambda some, k: some.join(marks, "node").select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "size", "most", "of", "parity")])
    large = items.where(F.col("members") > bucket)
    for turn in range(rounds):
        large = open_buckets(labelled(large.drop("of")))
        if large.isEmpty():
            break
        member = F.struct("node", "size", "most", "of")
        first = F.col("most") / F.col("size") if turn == 0 else F.lit(0.0)  # large where few shingles stand before the shared one
        heads = large.groupBy("h").agg(*[F.min_by(member, F.struct(-first, F.xxhash64("node", F.lit(HEADS * turn + k)))).alias(f"head{k}") for k in range(HEADS)])
        heads = cut(heads.select("h", F.explode(F.array_distinct(F.array(*[f"head{k}" for k in range(HEADS)]))).alias("head")).select("h", "head.*"))
        hung = side(large, "a").join(side(heads, "b"), "h").where(fit)
        links.append(verified(hung.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))))
    rest = open_buckets(labelled(items.drop("of")))
    pairs = side(rest, "a").join(side(rest, "b"), "h").where((F.col("node_a") < F.col("node_b")) & fit)
    links.append(verified(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))))
    return reduce(DataFrame.unionByName, links)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest doc_id.

    Groups are the components of links: texts whose sets of five-word shingles (A-Z lower-cased) have a Jaccard
    similarity of 0.8 or more; the groups are those that comparing all pairs would give. Equal texts are one group, null
    texts count as empty, and of repeated rows one stays. A row with a null doc_id comes after all others of its group. All columns are returned; an empty table gives an empty table.
    """
    low = F.lit(-1 << 63)
    # a node is a distinct text; equal texts share it
    bodies = texts(docs).withColumn("node", F.xxhash64("text"))
    links = near_duplicate_links(bodies, shingle, similarity).select("a", "b")
    found = components(links)
    rows = bodies.select("doc_id", F.col("node").alias("tkey"), "node")
    groups = cut(rows.join(found, "node", "left").select(F.coalesce("component", "node").alias("group"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank"), F.coalesce("doc_id", low).alias("doc_id"), "tkey"))
    kept = groups.groupBy("group").agg(F.min(F.struct("rank", "tkey")).alias("kept"))
    lost = cut(groups.join(kept, "group").where("rank <> kept.rank or tkey <> kept.tkey").select("doc_id", "tkey").distinct())
    repeated = groups.groupBy("doc_id", "tkey").count().where("count > 1").select("doc_id", "tkey")
    few = lost.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # columns of docs lie in a struct meanwhile, so that no name clashes
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), low).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tkey"))
    out = key.join(F.broadcast(lost) if few else lost, ["doc_id", "tkey"], "left_anti")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", "tkey"])
    return out.select("row.*")
