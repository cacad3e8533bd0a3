"""Best-fit packing of token sequences by bin completion over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import batches_of, cut, slices, texts, words_of

#: Rows that one numbering group holds on average; a length with more rows is numbered in several groups.
GROUP_ROWS = 5_000
#: Text bytes that are encoded at once.
ENCODE_BYTES = 8 << 20
#: The same where sequences follow an order, a stage behind others whose workers and heap are still there; and rows and bytes of an Arrow batch.
ORDERED_BYTES, ORDERED_ROWS, ORDERED_BATCH = 1 << 20, 2_000, 4 << 20
#: Distinct words whose ids a task keeps in each of two generations (about 180 bytes each).
CACHE_WORDS = 120_000
#: Documents that are packed together where sequences follow an order: their sequences stand in it up to so many documents.
RANGE_ROWS = 8_192
#: Steps for one best filling; each looks at all last two lengths at once.
STEPS = 400
#: Fillings of one bin that are enumerated where the search comes back to it.
FILLINGS = 24
#: Bins that the branch-and-bound completes, over all branches, before it settles for the incumbent; an enumeration counts as FILLINGS.
NODES = 20_000


class WordCoder:
    """Ids of texts. Where the tokenizer drops white space and so treats words apart, words are encoded once and kept.

    Of a word of Latin letters with plain punctuation behind it, letters and punctuation are kept apart, so that fewer
    are distinct. What a probe of the tokenizer does not bear out is not used; then whole texts are encoded.
    """

    _PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[.,;:!?%&]*)$"
    _PROBES = ("Ab cd", " ab\tcd\n\x0b\x0c\r\n ef ", "x  1,5 don't. Z", "\u00c9t\u00e9 \u00fcb \u00e9a")
    _MARKED = ("ab,", "Ab%%%", "\u00e9.!?", "a;:&")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        joined = lambda parts: [i for x in parts for i in ids(x)]
        self.by_word = all(ids(x) == joined(x.split()) for x in self._PROBES)
        self.any_case = all(ids(x) == ids(x.translate(_LOWER)) for x in self._PROBES)
        self.marks_apart = all(ids(x) == joined((x.rstrip(".,;:!?%&"), x[len(x.rstrip(".,;:!?%&")) :])) for x in self._MARKED)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Ids that end a word; with them many words are encoded in one call.
        self.last = np.array(sorted(i for w, i in self.tokenizer.get_vocab().items() if suffix and w.endswith(suffix)), dtype=np.uint32)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, words: list[str], plain: bool) -> list[bytes]:
        """Ids of each word; ``plain`` words are of letters only, or of punctuation only: one run each."""
        out: list[bytes] = []
        for start in range(0, len(words), 500):
            part = words[start : start + 500]
            if plain and len(self.last):
                ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
                ends = np.flatnonzero(np.isin(ids, self.last)) + 1
                if len(ends) == len(part):
                    edges, data = [0, *(4 * ends).tolist()], ids.tobytes()
                    out += [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
                    continue
            out += [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _kept(self, words: list[str], plain: bool) -> list[bytes]:
        missing = []
        for w in words:
            if w not in self.young:
                if (got := self.old.get(w)) is not None:
                    self.young[w] = got
                else:
                    missing.append(w)
        self.young.update(zip(missing, self._encoded(missing, plain), strict=True))
        out = [self.young[w] for w in words]
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, dict(islice(reversed(self.young.items()), CACHE_WORDS))
        return out

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's begin and the last one's end."""
        if not self.marks_apart:
            own = self._kept(words.to_pylist(), False)
            return np.frombuffer(b"".join(own), np.uint32), np.cumsum([0, *map(len, own)]) // 4
        parts = pc.extract_regex(words, self._PLAIN)
        known = parts.is_valid()
        sides, sizes = [], np.zeros((2, len(words)), dtype=np.int64)
        for k, name in enumerate(("letters", "marks")):
            coded = pc.if_else(known, pc.struct_field(parts, name), "" if k else words).dictionary_encode()
            names = coded.dictionary.to_pylist()
            plain = np.array([not n or k == 1 or n.isalpha() for n in names], dtype=bool)
            own = [b""] * len(names)
            for kind in (False, True):
                at = np.flatnonzero((plain == kind) & np.array([n != "" for n in names], dtype=bool)).tolist()
                for i, got in zip(at, self._kept([names[i] for i in at], kind), strict=True):
                    own[i] = got
            index = np.asarray(coded.indices, dtype=np.int64)
            each = np.fromiter(map(len, own), np.int64, len(own)) // 4
            first = np.cumsum(each) - each
            sizes[k] = each[index]
            sides.append((np.frombuffer(b"".join(own), np.uint32), first[index]))
        edges = np.concatenate([[0], np.cumsum(sizes.sum(axis=0))])
        out = np.empty(edges[-1], dtype=np.uint32)
        for (data, first), size, start in zip(sides, sizes, (edges[:-1], edges[:-1] + sizes[0]), strict=True):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(start, size) + step] = data[np.repeat(first, size) + step]
        return out, edges

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by ``end_id``, and how many each row has."""
        odd = np.ones(len(column), bool) if not self.by_word else np.any([np.asarray(pc.match_substring(column, x, ignore_case=True)) for x in self.special] or [np.zeros(len(column), bool)], axis=0)
        if odd.any():  # whole texts: special tokens' strings in them, or words that depend on each other
            rows: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(column)
            for k in np.flatnonzero(odd).tolist():
                rows[k] = np.array([*self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, end_id], dtype=np.uint32)
            if not odd.all():
                ids, n = self.encode(column.filter(pa.array(~odd)), end_id)
                for k, own in zip(np.flatnonzero(~odd).tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    rows[k] = own
            return np.concatenate(rows) if rows else np.zeros(0, np.uint32), np.array([len(r) for r in rows], dtype=np.int64)
        counts, flat = words_of(pc.ascii_lower(column) if self.any_case else column)
        coded = flat.dictionary_encode()
        data, edges = self._table(coded.dictionary)
        # one more entry, the end of a row, stands behind each row's words
        lists = pa.ListArray.from_arrays(pa.array([*edges.tolist(), len(data) + 1], pa.int32()), pa.array(np.append(data, np.uint32(end_id))))
        index = np.insert(np.asarray(coded.indices, dtype=np.int32), np.cumsum(counts), len(edges) - 1)
        taken = lists.take(pa.array(index))
        at = np.asarray(taken.offsets, dtype=np.int64)[np.concatenate([[0], np.cumsum(counts + 1)])]
        return np.asarray(taken.flatten()), np.diff(at)


_LOWER = {b: b + 32 for b in range(65, 91)}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, more: tuple[str, ...] = (), at_once: int = ENCODE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of at most ``capacity`` ids that each document's ids make.

    ``more``: long columns of ``docs`` that its pieces get too. ``at_once``: text bytes that are encoded at once.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", *more))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(tokenizer)  # a task's own: what it keeps goes with it
        for batch in batches:
            for part in slices(batch, "text", at_once):
                ids, per_row = coder.encode(part.column("text"), end_id)
                data, n_pieces = ids.tobytes(), -(-per_row // capacity)
                owner = np.repeat(np.arange(len(per_row)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, per_row[owner] - start)
                at = (np.cumsum(per_row) - per_row)[owner] + start
                view = memoryview(data)
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *(part.column(c).take(pa.array(owner)) for c in more)], names=schema.names)

    return texts(docs, *more).mapInArrow(run, schema)


def _filling(counts: np.ndarray, room: int, nodes: int = STEPS) -> tuple[int, ...]:
    """Lengths that fill ``room`` with the least waste, larger ones first among equals.

    The incumbent is the best-fit filling. Branches take the longest lengths first; a branch is cut when its waste
    bound cannot beat the incumbent, and a filling that another dominates (larger single pieces in its place) is
    never tried: the last length is always the largest that fits.
    """
    lengths = np.flatnonzero(counts[: room + 1])
    if not len(lengths):
        return ()
    fits = np.zeros(room + 1, dtype=np.int64)
    fits[lengths] = lengths
    fits = np.maximum.accumulate(fits)
    best: list[int] = []
    left = top = room
    while n := int(fits[min(left, top)]):  # best fit: the longest that still fits, again and again
        if best.count(n) < counts[n]:
            best.append(n)
            left -= n
        else:
            top = n - 1
    waste, spent = left, 0
    greedy = tuple(best)
    down = lengths[::-1]

    def pair(r: int, top: int, used: tuple[int, ...]) -> None:
        nonlocal best, waste
        first = down[(down <= min(r, top))]
        if not len(first):
            return
        second = fits[np.minimum(r - first, first)]
        lost = r - first - second
        for k in np.argsort(lost, kind="stable")[:3]:
            if lost[k] >= waste:
                return
            chosen = (*used, int(first[k]), *((int(second[k]),) if second[k] else ()))
            if all(chosen.count(n) <= counts[n] for n in set(chosen)):
                best, waste = list(chosen), int(lost[k])
                return

    def branch(r: int, top: int, used: tuple[int, ...], depth: int) -> None:
        nonlocal spent
        spent += 1
        pair(r, top, used)
        if depth == 0 or waste == 0:
            return
        for n in down[down <= min(r, top)].tolist():
            if waste == 0 or spent > nodes:
                return
            if used.count(n) < counts[n] and r - n >= lengths[0]:
                branch(r - n, n, (*used, n), depth - 1)

    for back in range(1, min(4, len(greedy)) + 1):  # near the incumbent: other ends of it
        if waste and spent <= nodes:
            used = greedy[: len(greedy) - back]
            branch(room - sum(used), used[-1] if used else room, used, 1)
    for depth in range(3):
        if waste and spent <= nodes:
            branch(room, room, (), depth)
    return tuple(best)


def _dominated(counts: np.ndarray, chosen: tuple[int, ...], room: int) -> bool:
    """Whether some longer piece that is left fits in place of one or two of ``chosen``: then the filling need not be tried."""
    waste = room - sum(chosen)
    left = counts.copy()
    for n in chosen:
        left[n] -= 1
    for size in (1, 2):
        for some in set(combinations(chosen, size)):
            n = sum(some)
            # one longer piece leaves less waste; one as long as two leaves the two shorter ones to other bins
            low = n + 1 if size == 1 else n
            if low <= n + waste and left[low : n + waste + 1].any():
                return True
    return False


def _fillings(counts: np.ndarray, room: int, most_waste: int, limit: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` with at most ``most_waste`` left over, the best first.

    The first is found by ``_filling``; only when the search comes back are others enumerated, ``limit`` of them.
    """
    first = _filling(counts, room)
    if room - sum(first) <= most_waste:
        yield first
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    smallest, found, steps = (lengths[-1] if lengths else 0), [], 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and len(found) < limit and steps < 20 * limit:
        at, left, chosen = stack.pop()
        steps += 1
        if not lengths or left < smallest or at == len(lengths):
            if left <= most_waste and sorted(chosen) != sorted(first) and not _dominated(counts, chosen, room):
                found.append(chosen)
            continue
        n = lengths[at]
        stack.append((at + 1, left, chosen))
        if n <= left and chosen.count(n) < counts[n]:
            stack.append((at, left - n, (*chosen, n)))
    yield from sorted(found, key=lambda c: (room - sum(c), tuple(-n for n in c)))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can do without: by the sum of lengths, and by pieces that cannot lie together."""
    lengths = np.arange(len(counts))
    bound = -(-int((counts * lengths).sum()) // capacity)
    for k in np.flatnonzero(counts[: capacity // 2 + 1]).tolist() or [0]:  # longer than capacity - k: each alone beside those of k or more
        large, middle = counts[capacity - k + 1 :].sum(), counts[capacity // 2 + 1 : capacity - k + 1]
        room = int((middle * (capacity - lengths[capacity // 2 + 1 : capacity - k + 1])).sum())
        small = int((counts[k : capacity // 2 + 1] * lengths[k : capacity // 2 + 1]).sum())
        bound = max(bound, int(large + middle.sum()) + max(0, -(-(small - room) // capacity)))
    return bound


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how often) that use each length as often as ``counts`` says, in as few bins as the search finds.

    Branch and bound over whole packings. The incumbent is the best-fit packing. A branch takes the largest length left
    and tries its undominated fillings, the one with the least waste first; a filling is repeated while all its lengths
    last, or used once. A branch goes when the waste so far leaves no packing with fewer bins than the incumbent; the
    search ends at the lower bound, when nothing is left, or after ``nodes`` bins. The work depends on the number of
    lengths, not of documents.
    """
    counts = counts.copy()
    best = best_fit(counts, capacity)
    used, bound, total = sum(t for _, t in best), lower_bound(counts, capacity), int((counts * np.arange(len(counts))).sum())
    wasted, path = 0, []

    def choices() -> Iterator[tuple[tuple[int, ...], int]]:
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        room = (used - 1) * capacity - total - wasted
        fillings = _fillings(counts.copy(), capacity - largest, room, FILLINGS)
        counts[largest] += 1
        for filling in fillings:
            pattern = (largest, *filling)
            times = min(int(counts[n]) // pattern.count(n) for n in set(pattern))
            yield pattern, times
            if times > 1:
                yield pattern, 1

    levels = [choices()] if counts.any() and used > bound else []
    while levels and nodes > 0:
        if len(path) == len(levels):  # back from a branch: undo its bins
            pattern, times = path.pop()
            for n in pattern:
                counts[n] += times
            wasted -= times * (capacity - sum(pattern))
            nodes -= FILLINGS
        if (choice := next(levels[-1], None)) is None:
            levels.pop()
            continue
        pattern, times = choice
        nodes -= 1
        path.append(choice)
        for n in pattern:
            counts[n] -= times
        wasted += times * (capacity - sum(pattern))
        if wasted > (used - 1) * capacity - total:
            continue
        if counts.any():
            levels.append(choices())
            continue
        best, used = list(path), sum(t for _, t in path)
        if used <= bound:
            break
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram: the largest length, then the longest that still fits, again and again."""
    counts, out = counts.copy(), []
    while len(left := np.flatnonzero(counts)):
        pattern, room = [int(left[-1])], capacity - int(left[-1])
        counts[pattern[0]] -= 1
        while len(fit := np.flatnonzero(counts[: room + 1])):
            pattern.append(int(fit[-1]))
            counts[fit[-1]] -= 1
            room -= int(fit[-1])
        times = 1 + min(int(counts[n]) // pattern.count(n) for n in set(pattern))
        for n in set(pattern):
            counts[n] -= (times - 1) * pattern.count(n)
        out.append((tuple(pattern), times))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text (null: empty) and ``end_id``; only longer ones are cut. Lengths, at most
    ``capacity`` of them, are counted in Spark; the driver completes bins on that histogram only, and pieces find
    their places by number within their length. A hot length is numbered in salted groups. Rows with a null or
    repeated doc_id are documents like any other; extra columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id).withColumn("seq", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    items = counts.copy()
    items[capacity] = 0
    plan = bin_completion(items, capacity)
    keys, base, offset = [], [], []
    taken, bins = np.zeros(capacity + 1, dtype=np.int64), 0
    for pattern, times in plan:
        at = 0
        for n in pattern:
            keys.append((n << 44) | int(taken[n]))
            base.append(bins - int(taken[n]))
            offset.append(at)
            taken[n] += times
            at += n
        bins += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    table = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64)[order] for x in (keys, base, offset)))

    groups = F.element_at(F.array(*[F.lit(int(n)) for n in np.maximum(1, -(-counts // GROUP_ROWS))]), (F.col("length") + 1).cast("int"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("seq"), groups))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("seq")))
    numbered = numbered.join(before, ["length", "salt"]).withColumn("key", F.shiftleft(F.col("length"), 44) + F.col("before") + F.col("number") - 1)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in pieces.drop("seq").schema), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, bases, offsets = table.value
        for batch in batches:
            key, whole = np.asarray(batch.column("key")), np.asarray(batch.column("length")) == capacity
            if len(starts):
                k = np.maximum(np.searchsorted(starts, key, side="right") - 1, 0)
                number, at = bases[k] + (key & ((1 << 44) - 1)), offsets[k].copy()
            else:
                number, at = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            number[whole] = bins + np.asarray(batch.column("seq"))[whole]
            at[whole] = 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-2]), pa.array(number), pa.array(at)], names=schema.names)

    return numbered.select(*schema.names[:-2], "seq", "key").mapInArrow(place, schema)


def pack_in_order(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of ``pack``, with sequence ids that follow the order of __rank (0, 1, ...: a column of ``docs``).

    Ranges of ``range_rows`` consecutive documents are packed each by itself, so the sequences of a range hold just its
    documents; ids rise from range to range, and within one by the mean rank of what the sequences hold.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, ("__rank",), ORDERED_BYTES).withColumn("__range", F.floor(F.col("__rank") / range_rows).cast("long"))
    schema = T.StructType.fromDDL("doc_id long, piece int, start long, length long, ids_crc32 long, __range long, sequence_id long, offset long")

    def place(table: pa.Table) -> pa.Table:
        length, rank = (table.column(c).to_numpy() for c in ("length", "__rank"))
        order = np.lexsort((table.column("piece").to_numpy(), rank))
        counts = np.bincount(length, minlength=capacity + 1)
        whole, counts[capacity] = order[length[order] == capacity], 0
        plan = bin_completion(counts, capacity)
        by_length = {int(n): order[length[order] == n] for n in np.flatnonzero(counts)}
        own, offset, taken, bins = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), dict.fromkeys(by_length, 0), 0
        for pattern, times in plan:
            at = 0
            for n in pattern:
                these = by_length[n][taken[n] : taken[n] + times]
                own[these], offset[these] = np.arange(bins, bins + times), at
                taken[n] += times
                at += n
            bins += times
        own[whole] = bins + np.arange(len(whole))
        mean = np.bincount(own, weights=rank) / np.bincount(own)
        number = np.empty(len(mean), np.int64)
        number[np.argsort(mean, kind="stable")] = np.arange(len(mean))
        return pa.table([*(table.column(c) for c in schema.names[:-2]), pa.array(number[own]), pa.array(offset)], names=schema.names)

    with batches_of(docs.sparkSession, ORDERED_ROWS, ORDERED_BATCH):
        placed = cut(pieces.groupBy("__range").applyInArrow(place, schema))
    used = placed.groupBy("__range").agg((F.max("sequence_id") + 1).alias("n"))
    first = used.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("first"))  # one row a range
    return placed.join(first, "__range").withColumn("sequence_id", F.col("first") + F.col("sequence_id")).drop("__range", "first")
