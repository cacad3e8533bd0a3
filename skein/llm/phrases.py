"""Collocations: phrases whose words stand together far more often than their parts would have them.

Counts come from truncated suffix trees. Every place of a text begins a suffix of at most ``depth`` words. Prefixes are
counted and lengthened round by round, and those rarer than ``least`` are not followed, since nothing that holds them
can be a candidate. The suffixes that are left are shared out by their prefixes, prefixes with too many suffixes being
lengthened by a word, into groups within a memory budget; each group's subtree is built by itself, and what a node
counts is the total of the leaves below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import batches_of, cut, joined_runs, runs_of, slices
from .substring import _mix

#: Words of the longest phrase, how often a candidate stands in the texts, and the percentage of a phrase's count from
#: which a longer one takes its place.
DEPTH, LEAST, TAKEN = 3, 10, 50
TOP = 2000
#: Leaves that a group holds in memory: twice as many at most.
BUDGET = 50_000
#: Candidates that one task ranks.
RANKED = 50_000
#: Bits of a filter of prefixes: 16 for each prefix, between these bounds (32 KB and 64 MB).
FEWEST_BITS, MOST_BITS = 1 << 18, 1 << 29
#: Text bytes that a Python task holds as words at once, and rows that it is handed at once.
TEXT_BYTES, BATCH_ROWS = 4 << 20, 2_000
#: Tables of counts are broadcast up to this many rows; beyond that they are shuffled.
BROADCAST_ROWS = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """All words of a text column in order (A-Z lower-cased), with the row and the piece that each stands in."""
    data, offsets, start, end = runs_of(column, _KIND == 0)
    words = joined_runs(_LOWER[data], _KIND[data] == 0, start, end)
    return words, np.searchsorted(offsets[1:], start, side="right"), np.searchsorted(np.flatnonzero(_KIND[data] == 2), start)


class Filter:
    """A Bloom filter of 64-bit keys with two probes: it never misses a key, and what it lets through besides is only work."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], dtype=np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for probe in (keys & self.mask, (keys >> np.uint64(32)) & self.mask):
            out &= (self.bits[(probe >> np.uint64(3)).astype(np.int64)] >> (probe & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def filter_of(keys: DataFrame) -> Filter:
    """The filter of ``keys`` (key): its blocks are built apart; what reaches the driver is MOST_BITS at most, however many keys there are."""
    bits = FEWEST_BITS
    wanted = 16 * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    probes = F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))
    places = keys.select(F.explode(probes).alias("place")).withColumn("block", F.shiftright("place", 18)).distinct()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << 18, dtype=np.uint8)
        block[(frame["place"] & ((1 << 18) - 1)).to_numpy()] = 1
        return pd.DataFrame({"block": frame["block"].iloc[:1].tolist(), "body": [np.packbits(block, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in places.groupBy("block").applyInPandas(run, "block long, body binary").toLocalIterator():
        out[row["block"] << 15 : (row["block"] + 1) << 15] = np.frombuffer(row["body"], dtype=np.uint8)
    return Filter(out)


def _hashes(values: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(v) for v in values.cast(pa.binary()).to_pylist()], dtype=np.uint64)


class Suffixes:
    """The words of a slice of rows (lang, text), the keys of the prefixes at each place, and how far each place is followed."""

    def __init__(self, part: pa.RecordBatch, filters: list[Filter], depth: int = 1):
        words, self.row, self.piece = words_of(part.column("text"))
        self.words, self.codes = words.dictionary, np.asarray(words.indices, dtype=np.int64)
        lang = part.column("lang").dictionary_encode()
        self.langs, self.lang = lang.dictionary, np.asarray(lang.indices, dtype=np.int64)[self.row]
        if not filters:
            return
        self.names, salt = _hashes(self.words)[self.codes], _mix(_hashes(self.langs))
        #: Keys of the prefixes of one word, two words, ..., ``depth`` words, and whether they are followed.
        self.keys, self.open = [_mix(self.names ^ salt[self.lang])], [np.ones(len(self.codes), dtype=bool)]
        for k, f in enumerate(filters, 1):
            self.open[-1] &= f.has(self.keys[-1])
            if k == depth:
                break
            known, key = self.open[-1], self.keys[-1]
            longer = np.zeros(len(known), dtype=bool)
            if len(known) > k:
                longer[:-k] = known[:-k] & known[1 : len(known) - k + 1] & (self.piece[:-k] == self.piece[k:])
            mixed = np.zeros(len(key), dtype=np.uint64)
            if len(key) > k:
                mixed[:-k] = _mix(_mix(key[:-k]) + self.names[k:] * _ODD)
            self.keys.append(mixed)
            self.open.append(longer)

    def counted(self, places: np.ndarray, reach: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Different (lang, word, ..., word) at ``places``, ``reach`` words deep (-1 beyond), and how often each stands there."""
        size = len(self.words) + 1
        ids, columns = self.lang[places], []
        for k in range(depth):
            columns.append(np.where(reach > k, self.codes[np.minimum(places + k, len(self.codes) - 1)], -1))
            _, first, ids = np.unique(ids * size + columns[-1] + 1, return_index=True, return_inverse=True)
        return self.lang[places][first], [c[first] for c in columns], np.bincount(ids, minlength=len(first))

    def batch(self, places: np.ndarray, reach: np.ndarray, schema: T.StructType) -> pa.RecordBatch:
        depth = len(schema) - 2
        lang, columns, n = self.counted(places, reach, depth)
        taken = [self.words.take(pa.array(c, pa.int64(), mask=c < 0)) for c in columns]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(lang)), *taken, pa.array(n.astype(np.int64))], names=schema.names)


def _said(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _schema(depth: int) -> T.StructType:
    return T.StructType([T.StructField("lang", T.StringType()), *(T.StructField(w, T.StringType()) for w in _w(depth)), T.StructField("n", T.LongType())])


def _w(depth: int) -> list[str]:
    return [f"w{k + 1}" for k in range(depth)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w1, n): every word of every language, counted by slice, by task and then by word."""
    schema = _schema(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                s = Suffixes(part, [])
                if len(s.codes):
                    yield s.batch(np.arange(len(s.codes)), np.ones(len(s.codes), dtype=np.int64), schema)

    return _said(docs).mapInArrow(run, schema).groupBy("lang", "w1").agg(F.sum("n").alias("n"))


def _shared(df: DataFrame, filters: list[Filter]):
    return df.sparkSession.sparkContext.broadcast(filters)  # at most depth filters of MOST_BITS


def word_keys(words: DataFrame) -> DataFrame:
    """The keys that ``Suffixes`` gives (lang, w1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _mix(_hashes(batch.column("w1")) ^ _mix(_hashes(batch.column("lang")))) if len(batch) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return words.select("lang", "w1").mapInArrow(run, "key long")


def longer_keys(docs: DataFrame, filters: list[Filter], least: int) -> DataFrame:
    """Keys of the prefixes one word longer than the last filter's that stand ``least`` times or more, and perhaps of a few others.

    Two prefixes with one key count together, so none that is frequent is missed.
    """
    shared, depth = _shared(docs, filters), len(filters) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                s = Suffixes(part, shared.value, depth)
                keys, n = np.unique(s.keys[-1][s.open[-1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = _said(docs).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("key")


def leaves(docs: DataFrame, filters: list[Filter], depth: int) -> DataFrame:
    """(lang, w1, ..., n): the suffix at every place, as far as its prefixes are followed; null beyond."""
    schema, shared = _schema(depth), _shared(docs, filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                s = Suffixes(part, shared.value, depth)
                reach = np.sum(np.cumprod(s.open, axis=0), axis=0) if len(s.codes) else np.zeros(0, np.int64)
                places = np.flatnonzero(reach)
                if len(places):
                    yield s.batch(places, reach[places], schema)

    return _said(docs).mapInArrow(run, schema).groupBy("lang", *_w(depth)).agg(F.sum("n").alias("n"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def grouped(found: DataFrame, depth: int, budget: int) -> DataFrame:
    """``found`` (leaves) with ``group``, ``deep`` (words of the prefix that went there) and ``whole`` (all of the prefix is in that group).

    Prefixes with more than ``budget`` leaves are lengthened by a word, and by another; one that is a word short of the
    leaves is dealt in shares. Prefixes go to groups in order, as many as the budget holds.
    """
    keyed = found.withColumns({"deep": F.lit(1), "shares": F.lit(1).cast("long")})
    for k in range(1, depth):
        here = ["lang", *_w(k)]
        wide = keyed.where(F.col("deep") == k).groupBy(*here).agg(F.count(F.lit(1)).alias("leaves")).where(F.col("leaves") > budget)
        wide = _few(cut(wide.withColumn("shares_", F.ceil(F.col("leaves") / budget))).drop("leaves"))  # total / budget of them at most
        step = F.col("shares_").isNotNull()
        last = k == depth - 1
        keyed = keyed.join(wide, here, "left").withColumns({"deep": F.when(step & F.lit(not last), k + 1).otherwise(F.col("deep")), "shares": F.when(step & F.lit(last), F.col("shares_")).otherwise(F.col("shares"))}).drop("shares_")
    prefix = [F.when(F.col("deep") > k, F.col(w)).alias(f"p{k}") for k, w in enumerate(_w(depth - 1))]
    share = F.pmod(F.xxhash64(f"w{depth}"), F.col("shares")).alias("share")
    keyed = cut(keyed.select("*", *prefix, share))
    key = ["lang", *[f"p{k}" for k in range(depth - 1)], "share"]
    sizes = cut(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("leaves")))
    total = sizes.agg(F.sum("leaves")).first()[0] or 0
    bucket = F.pmod(F.xxhash64(*key), F.lit(-(-total // (8 * budget)) or 1))  # prefixes of one bucket: 8 budgets of leaves, and one prefix
    before = F.sum("leaves").over(Window.partitionBy("bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("leaves")
    groups = sizes.withColumn("bucket", bucket).withColumn("group", F.struct("bucket", F.floor(before / budget).alias("place"))).select(*[F.col(c).alias(f"__{c}") for c in key], "group")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return keyed.join(groups, same).select(*found.columns, "deep", (F.col("shares") == 1).alias("whole"), "group.bucket", "group.place")


def subtree_totals(frame: pd.DataFrame, depth: int, least: int) -> pd.DataFrame:
    """The nodes of one group's subtrees with the totals of their leaves; nodes that are whole here and too rare are left out."""
    names = ["lang", *_w(depth)]
    codes = [pd.factorize(frame[c])[0] for c in names]  # null: -1
    order = np.lexsort(codes[::-1])
    n, deep, whole = (frame[c].to_numpy()[order] for c in ("n", "deep", "whole"))
    new, out = np.zeros(len(order), dtype=bool), []
    new[:1] = True
    for k, code in enumerate(codes):
        code = code[order]
        new[1:] |= code[1:] != code[:-1]
        if k == 0:
            continue
        start = np.flatnonzero(new)
        totals = np.add.reduceat(n, start)
        mine = (whole[start] & (deep[start] <= k)) | (k == depth)
        start, totals = (x[(code[start] >= 0) & ~(mine & (totals < least))] for x in (start, totals))
        nodes = frame.iloc[order[start]][names[: k + 1]].copy()
        for w in names[k + 1 :]:
            nodes[w] = None
        nodes["f"] = totals
        out.append(nodes)
    return pd.concat(out, ignore_index=True)


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, ..., f): phrases of up to ``depth`` words that stand ``least`` times or more; and (lang, n), all words of each language."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        words = cut(word_counts(docs))
        filters = [filter_of(cut(word_keys(words.where(F.col("n") >= least))))]
        for _ in range(depth - 1):
            filters.append(filter_of(cut(longer_keys(docs, filters, least))))
        found = cut(leaves(docs, filters, depth))
    found = grouped(found, depth, budget)
    schema = T.StructType([*_schema(depth)[:-1], T.StructField("f", T.LongType())])
    nodes = found.groupBy("bucket", "place").applyInPandas(lambda frame: subtree_totals(frame, depth, least), schema)
    # a prefix that was lengthened has a part of its total in each of its groups
    summed = nodes.groupBy("lang", *_w(depth)).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return cut(summed), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _phrase(words: list[str]) -> Column:
    return F.concat_ws(" ", *words)


def floor_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exactly, for counts under 10 ** 15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def first_of_lang(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language by score, count and phrase, with ``rank``.

    Before the last ranking, rows compete in shares of about RANKED rows, again and again while that still thins them, so
    no task ranks all candidates of a language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = lambda df, keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    size = rows.count()
    while size > max(RANKED, 4 * top):
        shares = -(-size // max(RANKED, 4 * top))
        rows = cut(best(rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares))), ["lang", "share"]).drop("share", "rank"))
        size, before = rows.count(), size
        if 2 * size > before:  # many languages: each share holds few rows of one
            break
    return best(rows, ["lang"]).withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, taken: int = TAKEN, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (null: empty) have their A-Z lower-cased and are split into pieces at ``.,;:!?`` and line ends, pieces into words
    at spaces and tabs; a phrase stands within a piece. A null lang is ``und``. a is how often the phrase stands in the
    language, l and r how often the parts of its worst cut do, n is the language's words, score is
    floor(1000000 a a / (l r)). A phrase that a longer candidate takes (at least ``taken`` percent of its count) is left
    out. Repeated rows count each time; no text, or no candidate: no row; columns beyond lang and text are left behind.
    """
    if depth < 2:
        raise ValueError("phrases have two words or more")
    nodes, totals = phrase_counts(docs, depth, least, budget)
    names = _w(depth)
    counts = nodes.select("lang", _phrase(names).alias("part"), "f")
    candidates = nodes.where("w2 IS NOT NULL").withColumn("phrase", _phrase(names)).withColumnRenamed("f", "a")
    # each candidate with its cuts: the first part and, as far as the phrase goes, the rest
    rest = lambda k: F.when(F.col(names[k]).isNotNull(), F.struct(F.lit(k).alias("k"), _phrase(names[:k]).alias("first"), _phrase(names[k:]).alias("rest")))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.filter(F.array(*[rest(k) for k in range(1, depth)]), lambda c: c.isNotNull())).alias("cut")).select("lang", "phrase", "a", "cut.*")
    parts = _few(counts)
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(floor_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("worst"))
    # what stands inside longer candidates, with the largest of their counts
    inner = [F.when(F.col(names[max(size, i + size - 1)]).isNotNull(), _phrase(names[i : i + size])) for size in range(2, depth) for i in range(depth - size + 1)]
    if inner:
        covers = candidates.select("lang", "a", F.explode(F.filter(F.array(*inner), lambda p: p.isNotNull())).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
        scored = scored.join(covers, ["lang", "phrase"], "left").where(F.col("covered").isNull() | (100 * F.col("covered") < taken * F.col("a")))
    rows = cut(scored.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score"))
    return first_of_lang(rows, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
