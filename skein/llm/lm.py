"""Stupid-backoff scores of documents under a bigram model: n-gram count tables joined to exploded n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, texts, words_of
from .substring import NO_ID, _mix

#: Words and bigrams with these shares of all words are counted first and looked up where they stand: at most
#: 2 / HOT_WORDS and 2 / HOT of them.
HOT_WORDS = 1e-6
HOT = 2e-6
ALPHA = 0.4
#: Words for each hash partition of the count table; a partition sorts about as many n-grams, in memory.
PARTITION_ROWS = 2_000_000
#: The word before the first one of a document.
START = np.uint64(0x5D58B1D6C2A4E93E)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# Keys are hashes of 63 bits; the lowest bit is 0 for words and 1 for bigrams.


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts, flat = words_of(pc.ascii_lower(column))
    coded = flat.dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w.encode()) & ~1 for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return counts, names[np.asarray(coded.indices, dtype=np.int64)] if len(names) else np.zeros(0, np.uint64)


def _bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many words each row has, and for each word: the word before it, itself, and the key of both."""
    counts, words = _hashed(column)
    before = np.concatenate([[START], words[:-1]]).astype(np.uint64) if len(words) else words
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return counts, before, words, _mix(_mix(before) + words * _ODD) | np.uint64(1)


def _ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of the rows: words of each row, then for each n-gram its row, its key and its weight.

    The log of a bigram's count is added, that of its first word's count taken away. A row's words are therefore
    unigrams of weight -1, with the start before them; its last word is counted, but is no bigram's first.
    """
    counts, before, words, keys = _bigrams(column)
    owner = np.repeat(np.arange(len(counts)), counts)
    last = (np.cumsum(counts) - 1)[counts > 0]
    return (
        counts,
        np.concatenate([owner, owner, owner[last]]),
        np.concatenate([keys, before, words[last]]).view(np.int64),
        np.concatenate([np.ones(len(keys), np.int32), np.full(len(before), -1, np.int32), np.zeros(len(last), np.int32)]),
    )


def _unigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts, _, words, _ = _bigrams(column)
    keys = np.concatenate([words, np.full(int((counts > 0).sum()), START, np.uint64)])
    return np.unique(keys.view(np.int64), return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _tally(docs: DataFrame, count, keep=None) -> DataFrame:
    """(key, n) summed over all rows; ``count`` maps a text column to keys and numbers. Tasks add up before the shuffle.

    ``keep`` chooses from what a task has added up, a few million keys at a time.
    """
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])

    def added(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        keys, n = keep(keys, n) if keep else (keys, n)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                keys, n = count(part.column("text"))
                held.append((keys, n))
                size += len(keys)
                if size > 4_000_000:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield added(*held[0])
                        held, size = [], 0
        if held:
            yield added(*_merged(held))

    return texts(docs).select("text").mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"))


def _found(keys: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted ``hot``, and which of them are there."""
    at = np.minimum(np.searchsorted(hot, keys), max(0, len(hot) - 1))
    return at, hot[at] == keys if len(hot) else np.zeros(len(keys), bool)


def hot_ngrams(docs: DataFrame, hot_words: float, hot: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys and exact counts of the hot words and bigrams, and how many words there are in all.

    What a task has added up is reported from the share on. So an n-gram that half the share was not reported of has
    less than one and a half times the share, and those that are taken are at most two over the share.
    """

    def often(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = n[keys & 1 == 1].sum()
        kept = n >= np.where(keys & 1, hot, hot_words) * words
        # the key 0 carries the number of words
        return np.concatenate([[0], keys[kept]]).astype(np.int64), np.concatenate([[words], n[kept]]).astype(np.int64)

    reported = cut(_tally(docs, lambda column: np.unique(_ngrams(column)[2], return_counts=True), often))
    total = reported.where("key = 0").agg(F.sum("n")).first()[0] or 0
    enough = F.when(F.col("key").bitwiseAND(1) == 1, hot).otherwise(hot_words) * total / 2
    likely = reported.where((F.col("n") >= enough) & (F.col("key") != 0)).select("key")
    chosen = docs.sparkSession.sparkContext.broadcast(np.sort(likely.toPandas()["key"].to_numpy(np.int64)))

    def exact(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at, known = _found(_ngrams(column)[2], chosen.value)
        n = np.bincount(at[known], minlength=len(chosen.value))
        return chosen.value[n > 0], n[n > 0]

    sums = _tally(docs, exact).toPandas().sort_values("key")
    return sums["key"].to_numpy(np.int64), sums["n"].to_numpy(np.int64), total


def _named(docs: DataFrame) -> DataFrame:
    return texts(docs).select(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), "text").alias("doc"), "doc_id", "text")


def _own_sums(docs: DataFrame, hot_words: float, hot: float, partition_rows: int) -> DataFrame:
    """(doc, n_words, log_score) under the counts of ``docs`` itself, where no bigram is unseen."""
    hot_keys, hot_counts, total = hot_ngrams(docs, hot_words, hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot_keys, np.log(hot_counts)))
    rows = T.StructType.fromDDL("key long not null, doc long not null, weight int not null, base double")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each n-gram that is not hot, and one for each document: its words, and what its hot n-grams add up to."""
        keys_, logs = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                counts, owner, keys, weight = _ngrams(part.column("text"))
                at, known = _found(keys, keys_)
                base = np.bincount(owner[known], weights=weight[known] * logs[at[known]], minlength=len(counts)) if known.any() else np.zeros(len(counts))
                names = np.asarray(part.column("doc"))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names), pa.array(counts.astype(np.int32)), pa.array(base)], names=rows.names)
                keys, owner, weight = keys[~known], owner[~known], weight[~known]
                order = np.argsort(owner, kind="stable")  # a document's rows side by side
                keys, owner, weight = keys[order], owner[order], weight[order]
                for a in range(0, len(keys), 200_000):
                    b = a + 200_000
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a:b]), pa.array(names[owner[a:b]]), pa.array(weight[a:b]), pa.nulls(len(keys[a:b]), pa.float64())],
                        names=rows.names,
                    )

    parts = max(1, -(-total // partition_rows))
    grams = _named(docs).select("doc", "text").mapInArrow(explode, rows).repartition(parts, "key")
    # Both sides of the join read all columns of ``grams``, so that they share one exchange.
    counts = grams.groupBy("key").agg(F.count(F.when(F.col("base").isNull(), F.struct("doc", "weight"))).alias("n"))
    value = F.when(F.col("base").isNull(), F.col("weight") * F.log("n")).otherwise(F.col("base"))
    # the log of an n-gram's count of one adds nothing: it makes no row for its document
    return grams.join(counts.hint("merge"), "key").where("n <> 1 or base is not null").groupBy("doc").agg(
        F.sum(F.when(F.col("base").isNotNull(), F.col("weight"))).alias("n_words"), F.sum(value).alias("log_score")
    )


def _other_sums(docs: DataFrame, corpus: DataFrame, alpha: float) -> DataFrame:
    """(doc, n_words, log_score) under the counts of ``corpus``; a word that it lacks counts as one."""
    one = cut(_tally(corpus, _unigrams))
    two = _tally(corpus, lambda column: np.unique(_bigrams(column)[3].view(np.int64), return_counts=True))
    total = one.where(F.col("key") != int(START.view(np.int64))).agg(F.sum("n")).first()[0] or 1
    rows = T.StructType.fromDDL("doc long, before long, word long, key long")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, before, words, keys = _bigrams(part.column("text"))
                owner = np.repeat(np.arange(len(counts)), counts)
                columns = [np.asarray(part.column("doc"))[owner], *[x.view(np.int64) for x in (before, words, keys)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=rows.names)

    grams = _named(docs).select("doc", "text").mapInArrow(explode, rows)
    seen = grams.join(two, "key", "left").select(
        "doc", F.col("n").alias("both"), F.when(F.col("n").isNull(), F.col("word")).otherwise(F.col("before")).alias("key")
    )
    alone = F.log(F.coalesce("n", F.lit(1)))
    value = F.when(F.col("both").isNull(), math.log(alpha) + alone - math.log(total)).otherwise(F.log("both") - alone)
    return seen.join(one, "key", "left").groupBy("doc").agg(F.count(F.lit(1)).alias("n_words"), F.sum(value).alias("log_score"))


def score(docs: DataFrame, corpus: DataFrame | None = None, hot_words: float = HOT_WORDS, hot: float = HOT, alpha: float = ALPHA, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, log_score (sum over words), mean_log_score.

    Words are runs without ASCII white space, A-Z lower-cased. A word's score after the word before it (or a document's
    start) is the bigram's count in ``corpus`` over the first word's count; where the corpus lacks the bigram, ``alpha``
    times the word's share of all words. No word or bigram is left out. Without ``corpus`` the documents are scored by
    their own counts, in which every bigram stands. N-grams are exploded and dealt by the hash of their words, each hash
    partition counts its own and joins the counts back, and the logs are summed by document; words of a share
    ``hot_words`` and bigrams of a share ``hot`` are counted first, so no task gathers one. N-grams are told apart by
    hashes of 63 bits, documents by one of 64 bits. A null text is empty; texts
    without words have log_score 0 and a null mean. Repeated rows and rows with a null doc_id are documents like any
    other, counted each time. Extra columns are ignored; an empty table gives an empty table.
    """
    sums = _own_sums(docs, hot_words, hot, partition_rows) if corpus is None else _other_sums(docs, corpus, alpha)
    rows = _named(docs).select("doc", "doc_id")
    # rows of equal doc_id and text have added up
    copies = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"))
    each = copies.join(sums, "doc", "left").select(
        "doc",
        F.coalesce((F.col("n_words") / F.col("copies")).cast("long"), F.lit(0).cast("long")).alias("n_words"),
        F.coalesce(F.col("log_score") / F.col("copies"), F.lit(0.0)).alias("log_score"),
    )
    return rows.join(each, "doc").select(
        "doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score")
    )
