"""Substring deduplication: repeated windows of words, found in a compacted De Bruijn graph of sampled k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, texts, words_of

#: Words of a k-mer: an edge of the graph. Windows are longer, so each one holds several.
KMER = 8
#: A side of a join is broadcast while its arrays have up to this many items (24 bytes each for spans to remove, some 72 for runs to tell apart); beyond that it is shuffled.
BROADCAST_ITEMS = 3_000_000
#: Windows of a mask.
PIECE = 62
NO_ID = -1 << 63
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """64-bit hashes of any run of words, from prefix sums modulo 2^64 of word hashes times powers of an odd base."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        power = np.full(n + 1, base, dtype=np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * self.power[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _M2)


def _hashed(column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    counts, flat = words_of(column)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    names = np.array([digest(w.encode(), seed) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return counts, names[np.asarray(coded.indices, dtype=np.int64)] if len(names) else np.zeros(0, np.uint64)


def _nodes(column: pa.Array, window: int, k: int) -> tuple[np.ndarray, ...]:
    """For each sampled k-mer place of the rows: row, k-mer hash, hash of all words of its windows, place, first and last window.

    Of each window the k-mer with the smallest hash (leftmost among equals) is sampled. Equal windows sample the same
    k-mer at the same offset, so windows can only be equal under equal k-mers.
    """
    counts, words = _hashed(column, 1)
    ends = np.cumsum(counts)
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    rolling = _Rolling(words, 0x9E3779B97F4A7C15)
    at = np.arange(len(words) - k + 1)
    kmers = rolling.of(at, at + k)
    span = window - k + 1
    row = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(words) - window + 1)
    starts = starts[starts + window <= ends[row[starts]]]
    if not len(starts):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    place = np.concatenate([np.argmin(np.lib.stride_tricks.sliding_window_view(kmers, span)[part], axis=1) for part in np.array_split(starts, max(1, len(starts) >> 16))]) + starts
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[starts[1:]] != row[starts[:-1]])])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(starts)]]) - 1
    first, last, place = starts[head], starts[tail], place[head]
    content = _mix(rolling.of(first, last + window) ^ _mix((place - first).astype(np.uint64) * np.uint64(64) + (place - last).astype(np.uint64)))
    own = row[first]
    begin = (ends - counts)[own]
    return own, kmers[place], content, place - begin, first - begin, last - begin


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumns({"kid": F.coalesce("doc_id", F.lit(NO_ID)), "tkey": F.xxhash64("text")})


def _joined(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """rows with ``spans`` of the table ``small`` (kid, tkey, spans)."""
    items = small.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    return rows.join(F.broadcast(small) if items <= BROADCAST_ITEMS else small, ["kid", "tkey"], how)


def graph_edges(docs: DataFrame, window: int = 35, k: int = KMER, label_bits: int = 64) -> DataFrame:
    """Occurrences (kid, tkey, kmer, after, content, first, last) of sampled k-mers, with their source coordinates.

    ``first`` and ``last`` are the first and last window start that the occurrence stands for, ``content`` hashes the
    run of words which those windows cover, and ``after`` is the k-mer sampled next in the document (null at its end):
    the occurrence as an edge of the graph. ``label_bits`` below 64 makes contents collide, for tests.
    """
    schema = T.StructType.fromDDL("kid long, tkey long, kmer long, after long, content long, first int, last int")
    keep = np.uint64((1 << label_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own, kmer, content, _, first, last = _nodes(part.column("text"), window, k)
                take = pa.array(own)
                ends = np.append(own[1:] != own[:-1], True)[: len(own)]
                after = pa.array(np.roll(kmer, -1).view(np.int64), mask=ends)
                columns = [part.column("kid").take(take), part.column("tkey").take(take), pa.array(kmer.view(np.int64)), after]
                columns += [pa.array((content & keep).view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _keyed(docs).select("kid", "tkey", "text").mapInArrow(run, schema)


def path_heads(links: DataFrame) -> DataFrame:
    """``links`` (node, to: the one node before it, without cycles) -> (node, head): where the path through node starts.

    Pointer doubling: every round joins each node's pointer with the pointer of the node it points to, so a path of n
    nodes takes about log2(n) rounds. Nodes that have arrived are set aside. An empty table gives an empty table.
    """
    known = active = cut(links.select("node", "to"))
    settled: DataFrame | None = None
    while not active.isEmpty():
        further = known.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = cut(active.join(further, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
        arrived = step.where("not moved").select("node", "to")
        settled = arrived if settled is None else settled.unionByName(arrived)
        active = step.where("moved").select("node", "to")
        known = settled.unionByName(active)
    return known.select("node", F.col("to").alias("head"))


def compact_paths(edges: DataFrame) -> DataFrame:
    """(kmer, straight, width): the repeated nodes of the graph, nonbranching paths compacted to their first node.

    A node is straight if all its occurrences carry one label and as many windows. It is linked to its successor if all
    its occurrences are followed by that node, which is straight too and occurs as often: then nothing else leads there.
    Since documents end, such links form no cycle. ``width`` counts the windows of a whole path; nodes that are not
    straight come back one by one without it, and nodes that occur once have no repeated window and are left out.
    """
    width = F.col("last") - F.col("first") + 1
    nodes = edges.groupBy("kmer").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.min(width).alias("width"), F.max(width).alias("widest"),
        F.count("after").alias("followed"), F.min("after").alias("next"), F.max("after").alias("other"),
    ).where("n > 1")
    nodes = cut(nodes.selectExpr("kmer", "n", "width", "low = high and width = widest as straight", "if(followed = n and next = other, next, null) as next"))
    straight = nodes.where("straight")
    links = straight.where("next is not null").select(F.col("kmer").alias("to"), F.col("next").alias("node"), "n")
    heads = path_heads(links.join(straight.select(F.col("kmer").alias("node"), "n"), ["node", "n"]))
    members = straight.join(heads.withColumnRenamed("node", "kmer"), "kmer", "left")
    paths = members.groupBy(F.coalesce("head", "kmer").alias("kmer")).agg(F.lit(True).alias("straight"), F.sum("width").cast("int").alias("width"))
    return paths.unionByName(nodes.where("not straight").select("kmer", "straight", F.lit(None).cast("int").alias("width")))


def _read_runs(rows: DataFrame, window: int) -> DataFrame:
    """Each row (kid, tkey, text, spans: key, first, last) -> a row for each span with the digest of the words there.

    The digest is the first half of SHA-256 over the words' own bytes, read at the source coordinates.
    """
    schema = T.StructType.fromDDL("kid long, tkey long, key long, first int, last int, digest binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                counts, words = words_of(part.column("text"))
                spaced = pc.binary_join_element_wise(words, "", " ")
                place = np.frombuffer(spaced.buffers()[1], dtype=np.int32) if len(words) else np.zeros(1, np.int32)
                data = memoryview(spaced.buffers()[2] or b"")
                spans = part.column("spans")
                flat, n = spans.flatten(), np.asarray(spans.value_lengths(), dtype=np.int64)
                begin = np.repeat(np.cumsum(counts) - counts, n)
                first, last = (np.asarray(flat.field(c), dtype=np.int64) for c in ("first", "last"))
                ends = zip(place[begin + first].tolist(), place[begin + last + window].tolist(), strict=True)
                digests = [hashlib.sha256(data[a:b]).digest()[:16] for a, b in ends]
                take = pa.array(np.repeat(np.arange(len(n)), n))
                columns = [part.column("kid").take(take), part.column("tkey").take(take), *(flat.field(c) for c in ("key", "first", "last")), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("kid", "tkey", "text", "spans").mapInArrow(run, schema)


def _window_hashes(rows: DataFrame, window: int) -> DataFrame:
    """Each row (text, spans: key, digest, piece, first, last) -> (key, digest, piece, offset, whash), read at the source coordinates.

    The hash is a second one, with other word hashes and another base than those of the graph.
    """
    schema = T.StructType.fromDDL("key long, digest binary, piece int, offset int, whash long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                counts, words = _hashed(part.column("text"), 2)
                if not len(words):
                    continue
                rolling = _Rolling(words, 0xD6E8FEB86659FD93)
                spans = part.column("spans")
                flat, n = spans.flatten(), np.asarray(spans.value_lengths(), dtype=np.int64)
                begin = np.repeat(np.cumsum(counts) - counts, n)
                first, last = (np.asarray(flat.field(c), dtype=np.int64) for c in ("first", "last"))
                each = last - first + 1
                offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                start = np.repeat(begin + first, each) + offset
                take = pa.array(np.repeat(np.arange(len(each)), each))
                columns = [*(flat.field(c).take(take) for c in ("key", "digest", "piece")), pa.array(offset, pa.int32()), pa.array(rolling.of(start, start + window).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("text", "spans").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, window: int = 35, k: int = KMER, label_bits: int = 64) -> DataFrame:
    """(kid, tkey, spans): for each document the runs (first, last) of window starts that occur anywhere else.

    1. Sampled k-mers with the runs of words around them are the graph's edges, each linked to its successor.
    2. Repeated nonbranching paths are compacted by joins (``compact_paths``): one run for each occurrence of a path,
       and one for each occurrence of a branching node.
    3. Every run is read at its source coordinates. Runs of one key and one digest of their words repeat as a whole.
    4. Where the runs of a key differ (branching nodes, or a path whose labels collided), they are told apart window by
       window, once for each distinct digest, at the source coordinates of its first occurrence.
    """
    if window - k >= PIECE:
        raise ValueError(f"a node stands for at most {PIECE} windows; take a larger k")
    edges = cut(graph_edges(docs, window, k, label_bits))
    # tables are written before joins, so that both sides are plain shuffles and a k-mer that stands almost everywhere is split
    seen = edges.join(cut(compact_paths(edges)), "kmer")
    found = F.struct(F.col("kmer").alias("key"), "first", F.when(F.col("straight"), F.col("first") + F.col("width") - 1).otherwise(F.col("last")).alias("last"))
    # sets: repeated rows (same doc_id and text) have the same runs, which the join gives to each of them
    placed = cut(seen.groupBy("kid", "tkey").agg(F.collect_set(found).alias("spans")))
    runs = cut(_read_runs(_keyed(docs).select("kid", "tkey", "text").join(placed.hint("merge"), ["kid", "tkey"]), window))
    labels = cut(runs.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kid", "tkey", "first", "last")).alias("at")))
    mixed = labels.join(labels.groupBy("key").count().where("count > 1"), "key", "left_semi")
    pieces = mixed.select("key", "digest", "at", F.explode(F.expr(f"sequence(0, at.last - at.first, {PIECE})")).alias("piece"))
    part = F.expr(f"struct(key, digest, piece, at.first + piece as first, least(at.last, at.first + piece + {PIECE - 1}) as last)")
    places = pieces.groupBy(F.col("at.kid").alias("kid"), F.col("at.tkey").alias("tkey")).agg(F.collect_list(part).alias("spans"))
    windows = cut(_window_hashes(_joined(_keyed(docs).select("kid", "tkey", "text"), cut(places)), window))
    shared = cut(windows.groupBy("key", "piece", "whash").count().where("count > 1").drop("count"))
    # a row that stands twice is read twice here, but its labels occur twice too and count as a whole
    masks = windows.join(shared, ["key", "piece", "whash"]).groupBy("key", "digest", "piece").agg(F.sum(F.expr("shiftleft(1L, offset)")).alias("mask"))
    whole = labels.where("n > 1").select("key", "digest", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("mask"))
    settled = cut(whole.unionByName(labels.where("n = 1").select("key", "digest").join(masks, ["key", "digest"])))
    hit = F.expr("struct(first + piece as first, if(mask = 0, last - first + 1, 0) as width, mask)")
    grouped = runs.join(settled, ["key", "digest"]).groupBy("kid", "tkey").agg(F.collect_set(hit).alias("starts"))
    return cut(_merged(grouped))


def _merged(grouped: DataFrame) -> DataFrame:
    """Each document's ``starts`` (first and width, or first and a mask where width is 0) as ordered runs (first, last) of window starts."""
    schema = T.StructType.fromDDL("kid long, tkey long, spans array<struct<first:int,last:int>>")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("starts")
            flat, n = lists.flatten(), np.asarray(lists.value_lengths(), dtype=np.int64)
            first, width, mask = (np.array(flat.field(c), dtype=np.int64) for c in ("first", "width", "mask"))
            item = np.arange(len(first))
            bits, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(mask) else (item, item)
            # windows of masks one by one, and whole runs
            item = np.concatenate([bits, np.flatnonzero(width)])
            start = np.concatenate([first[bits] + bit, first[width > 0]])
            stop = np.concatenate([first[bits] + bit, (first + width - 1)[width > 0]])
            owner = np.repeat(np.arange(len(n)), n)[item]
            order = np.lexsort((start, owner))
            owner, start, stop = owner[order], start[order], stop[order]
            reach = np.maximum.accumulate((owner << 32) + stop) - (owner << 32)
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1] + 1)]) if len(owner) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(owner)]]).astype(np.int64) - 1 if len(head) else head
            count = np.bincount(owner[head], minlength=len(n))
            runs = pa.StructArray.from_arrays([pa.array(start[head], pa.int32()), pa.array(reach[tail], pa.int32())], names=["first", "last"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("kid"), batch.column("tkey"), pa.ListArray.from_arrays(offsets, runs).cast(kind)], names=schema.names)

    return grouped.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = 35, k: int = KMER) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (text), removed (spans of words), kept_sha256.

    Words are runs without ASCII white space. A word goes when it lies in a window of ``window`` consecutive words whose
    sequence also starts anywhere else, in the same document or another, judged on the input. A null text has no words,
    and texts shorter than a window lose nothing. Repeated rows are documents of their own, so their windows repeat.
    Kept words are joined by one space. Extra columns are ignored; an empty table gives an empty table.
    """
    spans = repeated_spans(docs, window, k)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>, kept_sha256 string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[] for _ in schema]
                for doc_id, text, found in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("spans"), strict=True):
                    own = text.as_py().encode("utf-8", "surrogatepass").split()
                    gone = np.zeros(len(own) + 1, dtype=np.int64)
                    for span in found.as_py() or ():
                        gone[span["first"]] += 1
                        gone[span["last"] + window] -= 1
                    drop = np.cumsum(gone)[:-1] > 0
                    kept = b" ".join([w for w, d in zip(own, drop.tolist(), strict=True) if not d]) if found.is_valid else b" ".join(own)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                    row = (doc_id, len(own), int(drop.sum()), kept.decode("utf-8", "surrogatepass"), [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()], hashlib.sha256(kept).hexdigest())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=schema.names)

    return _joined(_keyed(docs), spans, "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
