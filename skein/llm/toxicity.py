"""Toxicity by a classifier chain: each category's linear model sees the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, texts

#: About so many labelled rows are fitted on, chosen by a hash of doc_id; more labels do not make the fit larger.
FIT_ROWS = 20_000
#: Words with a weight, for each category: those that go most clearly with it or against it.
WORDS = 128
#: How many standard deviations a word's count in a category must be off, and in how many labelled rows it must stand.
CLEAR, MIN_DOCS = 5.0, 3
FOLDS = 3
RIDGE = 0.3
#: Categories in the order of the chain, as conditions on a row of `labels`.
CHAIN = {"junk": "quality = 0", "toxic": "toxic = 1"}
THRESHOLD = 0.5


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Each word (lower-cased run of letters and digits) of a text column with its row."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\p{L}\p{N}]+")
    return np.repeat(np.arange(len(column)), np.asarray(pc.list_value_length(lists), dtype=np.int64)), lists.flatten().dictionary_encode()


def occurrences(column: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Rows by words: log2(1 + how often the word stands in the row's text)."""
    row, words = words_of(column)
    out = np.zeros((len(column), len(vocabulary)), dtype=np.float32)
    known = np.asarray(pc.fill_null(pc.index_in(words.dictionary, value_set=vocabulary), -1), dtype=np.int64)
    if len(known):
        at = known[np.asarray(words.indices, dtype=np.int64)]
        np.add.at(out, (row[at >= 0], at[at >= 0]), 1)
    return np.log2(1 + out)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights, the constant last, of a ridge logistic regression by Newton steps; one side only: the smoothed share."""
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(k + 1)
    w[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < n:
        return w
    full = np.concatenate([x, np.ones((n, 1), np.float32)], axis=1)
    penalty = np.full(k + 1, ridge)
    penalty[-1] = 1e-6
    loss = lambda v: float(np.logaddexp(0, -(2 * y - 1) * (full @ v)).sum() + (penalty * v * v).sum() / 2)
    now = loss(w)
    for _ in range(rounds):
        p = logistic(full @ w)
        slope = full.T @ (p - y) + penalty * w
        curve = (full * (p * (1 - p))[:, None].astype(np.float32)).T @ full + np.diag(penalty)
        step, size = np.linalg.solve(curve.astype(np.float64), slope), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if now - then < 1e-6 * now:
            break
        now = then
    return w


@dataclass
class Chain:
    categories: list[str]
    words: list[str] = field(default_factory=list)
    #: For each category: weights of the words, then of the categories before it, then the constant.
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Rows by categories, each category's from the words and from those before it."""
        if not self.weights:
            return np.zeros((len(column), len(self.categories)))
        x = occurrences(column, pa.array(self.words, pa.string()))
        out = np.zeros((len(column), 0))
        for w in self.weights:
            p = logistic(x @ w[: x.shape[1]] + out @ w[x.shape[1] : -1] + w[-1])
            out = np.concatenate([out, p[:, None]], axis=1)
        return out

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and p_<category> for each row of (doc_id, text); one scan, without a shuffle."""
        schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"p_{c}", T.DoubleType()) for c in self.categories)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    p = self.probabilities(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, p.T)], names=schema.names)

        return texts(docs).mapInArrow(run, schema)

    def keep(self, docs: DataFrame, category: str, threshold: float) -> DataFrame:
        """Rows of ``docs`` whose probability is under the threshold, with all columns."""
        k = self.categories.index(category)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    yield part.filter(pa.array(self.probabilities(part.column("text"))[:, k] < threshold))

        return docs.mapInArrow(run, docs.schema)


def _clear_words(rows: DataFrame, sides: list[str], limit: int, folds: int) -> list[list[str]]:
    """Words whose share of a category's rows is furthest off, ``limit`` for each: chosen without fold 0, without fold 1, ..., then on all rows.

    Words are counted by task, then by word, for each fold.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(s, T.DoubleType()) for s in sides)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, words = words_of(part.column("text"))
                at, size = np.asarray(part.column("fold"), dtype=np.int64), len(words.dictionary)
                pairs = np.unique(np.asarray(words.indices, dtype=np.int64) * len(at) + row) if len(row) else np.zeros(0, np.int64)
                word, row = pairs // max(1, len(at)), pairs % max(1, len(at))
                key = at[row] * size + word
                seen = np.unique(key)
                count = lambda w=None: np.bincount(key, weights=w, minlength=size * folds)[seen]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(seen % max(1, size))), pa.array(seen // max(1, size), pa.int32()), pa.array(count().astype(np.int64)), *(pa.array(count(np.asarray(part.column(s))[row])) for s in sides)], names=schema.names)

    counted = rows.select("text", "fold", *sides).mapInArrow(run, schema)
    sums = {(c, f): F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)) for c in ("n", *sides) for f in range(folds)}
    counted = cut(counted.groupBy("word").agg(*[e.alias(f"{c}_{f}") for (c, f), e in sums.items()]).where(F.col("word") != "").where(sum((F.col(f"n_{f}") for f in range(folds)), F.lit(0)) >= MIN_DOCS))
    shares = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sides]).collect()}  # one row a fold
    out: list[list[str]] = []
    for left_out in (*range(folds), None):
        seen, chosen = [f for f in range(folds) if f != left_out], set()
        total = sum(shares[f]["n"] for f in seen if f in shares)
        for s in sides:
            share = sum(shares[f][s] for f in seen if f in shares) / max(1, total)
            if 0 < share < 1:
                n, own = (sum((F.col(f"{c}_{f}") for f in seen), F.lit(0)) for c in ("n", s))
                off = F.abs(own - n * share) / F.sqrt(n * share * (1 - share))
                best = counted.select("word", n.alias("n"), off.alias("off")).where((F.col("n") >= MIN_DOCS) & (F.col("off") >= CLEAR))
                chosen.update(r["word"] for r in best.orderBy(F.desc("off"), "word").limit(limit).collect())
        out.append(sorted(chosen))
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, fit_rows: int = FIT_ROWS, folds: int = FOLDS) -> Chain:
    """Fit one logistic model for each category on word occurrences and the probabilities of those before it.

    For training, those probabilities come from models that did not see the row, nor was it seen when their words were
    chosen (``folds`` folds by a hash of doc_id); for scoring, from a model of all rows. The table of labels has two
    categories, ``junk`` (quality 0, not a kind of toxicity) and ``toxic``; ``chain`` takes any conditions on its columns.
    Labels with a null category or doc_id are left out; a doc_id with several
    labels or texts counts each time. The fit itself takes the rows' occurrences of the chosen words, about ``fit_rows``
    small rows at most, in one task. Without usable labels every probability is 0.
    """
    total = labels.count()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1_000_000)) < max(1, round(1_000_000 * min(1.0, fit_rows / max(1, total))))
    sides = [f"y_{name}" for name in chain]
    chosen = labels.where(share).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.expr(c).cast("double").alias(f"y_{n}") for n, c in chain.items()]).dropna()
    # about fit_rows labels: small enough for every task, whatever the size of the tables
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("text", *sides, F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(folds)).cast("int").alias("fold"))
    rows = cut(rows)
    chosen_by = _clear_words(rows, sides, WORDS, folds)
    words = sorted(set().union(*chosen_by))
    known = np.array([[w in set(some) for w in words] for some in chosen_by], dtype=bool).reshape(folds + 1, len(words))
    vocabulary = pa.array(words, pa.string())
    sparse = T.StructType([*(T.StructField(s, T.DoubleType()) for s in sides), T.StructField("fold", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = occurrences(part.column("text"), vocabulary)
                row, at = np.nonzero(x)
                offsets = np.searchsorted(row, np.arange(len(x) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values) for values in (pa.array(at, pa.int32()), pa.array(x[row, at], pa.float32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(s) for s in sides), part.column("fold"), *lists], names=sparse.names)

    fitted = T.StructType([T.StructField("category", T.IntegerType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort([frame["at"].map(len), *(frame[s] for s in sides), frame["fold"]])]
        x = np.zeros((len(frame), len(words)), dtype=np.float32)
        for row, (at, value) in enumerate(zip(frame["at"], frame["value"], strict=True)):
            x[row, np.asarray(at, dtype=np.int64)] = value
        fold, out = frame["fold"].to_numpy(), []
        for k, s in enumerate(sides):
            y = frame[s].to_numpy()
            before = np.ones(x.shape[1] - len(words), dtype=bool)  # probabilities of the categories before
            w = np.zeros(x.shape[1] + 1)
            mine = np.concatenate([known[-1], before, [True]])
            w[mine] = fit_logistic(x[:, mine[:-1]], y)
            out.append((k, w.tolist()))
            held = np.zeros(len(frame))
            for f in range(folds):
                other, use = fold != f, np.concatenate([known[f], before])
                seen = fit_logistic(x[other][:, use], y[other])
                held[~other] = logistic(x[~other][:, use] @ seen[:-1] + seen[-1])
            x = np.concatenate([x, held[:, None].astype(np.float32)], axis=1)
        return pd.DataFrame(out, columns=fitted.names)

    located = rows.select("text", *sides, "fold").mapInArrow(locate, sparse)
    models = located.groupBy(F.lit(0).alias("all")).applyInPandas(lambda frame: fit(frame), fitted).orderBy("category").collect()
    return Chain(list(chain), words, [np.array(m["weights"]) for m in models])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, p_junk, p_toxic, toxic.

    A null or empty text has no words, so only the models' constants speak. Null or repeated doc_ids are rows like any
    other; extra columns are ignored; an empty table gives an empty table.
    """
    return fit_chain(docs, labels).score(docs).withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the chain rejects; all other rows and all columns stay. Edges as above."""
    return fit_chain(docs, labels).keep(docs, "toxic", threshold)
