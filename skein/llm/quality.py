"""Quality of documents by a factorisation machine over hashed words, structure statistics and metadata.

Each feature has a weight and a short vector; every pair of a document's features adds the product of their values and
their vectors' inner product. All pairs together are half of (the square of the sum, less the sum of the squares) in
each dimension, so that a document is scored in time linear in its features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, joined_runs, runs_of, slices

#: About so many labelled rows are fitted on, chosen by a hash of doc_id, and so many feature values of theirs at most.
FIT_ROWS, FIT_VALUES = 12_000, 8_000_000
#: Buckets of hashed words, dimensions of the vectors.
BUCKETS, RANK = 1 << 14, 8
EPOCHS, BATCH, RATE, RIDGE, SEED = 12, 128, 0.1, 1e-4, 11
#: A row is held out if its doc_id's CRC-32 has this remainder.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
KINDS = ("control", "blank", "line", "lower", "upper", "digit", "stop", "loud", "symbol", "beyond")
_KIND = np.zeros(256, dtype=np.int64)
for _name, _bytes in {"blank": b" \t", "line": b"\n\r\x0b\x0c", "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "stop": b".,;:'\"()-", "loud": b"!?", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "beyond": range(128, 256)}.items():
    _KIND[[*_bytes]] = KINDS.index(_name)
STATISTICS = (*KINDS, "log_bytes", "log_words", "word_length", "different_words", "commonest_word", "symbol_ends", "loud_ends", "capital_starts", "log_lines", "log_n_chars", "no_n_chars", "n_chars_ratio")


def _per_row(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=rows).astype(np.float64)


@dataclass
class Features:
    """The rows' statistics, and their hashed words as (row, bucket, value): log counts, scaled to length one in each row."""

    statistics: np.ndarray
    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, text: pa.Array, n_chars: pa.Array, buckets: int = BUCKETS) -> Features:
        data, offsets, start, end = runs_of(text, _WORD)
        rows, sizes = len(text), np.diff(offsets)
        kinds = _per_row(np.repeat(np.arange(rows), sizes) * len(KINDS) + _KIND[data], rows * len(KINDS)).reshape(rows, -1)
        kinds[:, KINDS.index("line")] -= 1  # the one that ``runs_of`` adds
        size = np.maximum(1, sizes - 1)
        words = joined_runs(_LOWER[data], _WORD[data], start, end)
        row, code = np.searchsorted(offsets[1:], start, side="right"), np.asarray(words.indices, dtype=np.int64)
        n_words = _per_row(row, rows)
        many = np.maximum(1, n_words)
        different = max(1, len(words.dictionary))
        pairs, often = np.unique(row * different + code, return_counts=True)
        most = np.zeros(rows)
        np.maximum.at(most, pairs // different, often)
        kind_of = lambda at, name: _per_row(row, rows, _KIND[data[at]] == KINDS.index(name)) / many
        said = np.asarray(n_chars.cast(pa.float64()).fill_null(-1.0))
        known = said >= 0
        said = np.where(known, said, 0)
        statistics = np.column_stack([
            kinds / size[:, None], np.log1p(sizes - 1), np.log1p(n_words), _per_row(row, rows, end - start) / many, _per_row(pairs // different, rows) / many, most / many,
            kind_of(end - 1, "symbol"), kind_of(end - 1, "loud"), kind_of(start, "upper"), np.log1p(kinds[:, KINDS.index("line")]),
            np.log1p(said), ~known, np.where(known, np.log((said + 1) / (size + 1)), 0),
        ])
        names = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
        hashed, n = np.unique(row * buckets + names[code], return_counts=True) if len(code) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        row, value = hashed // buckets, np.log1p(n)
        return cls(statistics, row, hashed % buckets, value / np.sqrt(_per_row(row, rows, value * value))[row])


@dataclass
class Machine:
    """score = logistic(bias + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j); the statistics stand after the buckets."""

    buckets: int
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scaled(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -5, 5)

    def scores(self, f: Features) -> np.ndarray:
        dense, rows = self.scaled(f.statistics), len(f.statistics)
        z = self.bias + dense @ self.w[self.buckets :] + _per_row(f.row, rows, self.w[f.bucket] * f.value)
        for v in self.v.T:  # one dimension at a time
            word = v[f.bucket] * f.value
            s = dense @ v[self.buckets :] + _per_row(f.row, rows, word)
            q = (dense * dense) @ (v[self.buckets :] ** 2) + _per_row(f.row, rows, word * word)
            z += (s * s - q) / 2
        return logistic(z)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss_and_slopes(at: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean logistic loss of rows of features (``at``, ``x``; rows begin at ``first``), its slopes by score, and by w and v for each value."""
    vx = v[at] * x[:, None]
    s = np.add.reduceat(vx, first)
    z = bias + np.add.reduceat(w[at] * x, first) + ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), first)) / 2
    row = np.repeat(np.arange(len(y)), np.diff(np.append(first, len(at))))
    slope = (logistic(z) - y) / len(y)
    own = slope[row] * x
    return float(np.mean(np.logaddexp(0, -(2 * y - 1) * z))), slope, own, own[:, None] * (s[row] - vx)


def fit_machine(statistics: np.ndarray, at: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS) -> Machine:
    """Adaptive gradient steps on batches of rows, in an order that a seed fixes; labels of one kind give their smoothed share to every row."""
    rng = np.random.default_rng(SEED)
    n, size = len(y), buckets + statistics.shape[1]
    mean, scale = (statistics.mean(0), np.maximum(statistics.std(0), 1e-6)) if n else (np.zeros(statistics.shape[1]), np.ones(statistics.shape[1]))
    share = (y.sum() + 0.5) / (n + 1)
    out = Machine(buckets, mean, scale, float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, rank)))
    if not 0 < y.sum() < n:
        return out
    out.v = rng.normal(0, 0.02, (size, rank))
    dense, beyond = out.scaled(statistics), np.arange(buckets, size)
    rows = [(np.concatenate([a, beyond]), np.concatenate([v, d])) for a, v, d in zip(at, value, dense, strict=True)]
    seen_w, seen_v, seen_b = np.full(size, 1e-8), np.full((size, rank), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(n)
        for batch in np.array_split(order, -(-n // BATCH)):
            ids, x = (np.concatenate([rows[k][c] for k in batch]) for c in (0, 1))
            first = np.concatenate([[0], np.cumsum([len(rows[k][0]) for k in batch])[:-1]])
            _, slope, by_w, by_v = loss_and_slopes(ids, x, first, y[batch], out.bias, out.w, out.v)
            by = np.argsort(ids, kind="stable")
            mine = ids[by]
            start = np.flatnonzero(np.diff(mine, prepend=-1))
            mine = mine[start]
            dw = np.add.reduceat(by_w[by], start) + RIDGE * out.w[mine]
            dv = np.add.reduceat(by_v[by], start) + RIDGE * out.v[mine]
            seen_w[mine] += dw * dw
            seen_v[mine] += dv * dv
            seen_b += slope.sum() ** 2
            out.w[mine] -= RATE * dw / np.sqrt(seen_w[mine])
            out.v[mine] -= RATE / 2 * dv / np.sqrt(seen_v[mine])
            out.bias -= RATE * slope.sum() / np.sqrt(seen_b)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("n_chars").cast("long").alias("n_chars"))


def held_out(doc_id="doc_id"):
    """Whether a doc_id is never learned from; a null one is not held out, nor does it have labels."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_values: int = FIT_VALUES, buckets: int = BUCKETS) -> Machine:
    """A machine fitted on ``labels`` (doc_id, quality) of rows that are not held out.

    Labels that are null or of no document are left out; a doc_id with several labels or texts counts each time. Features
    are made where the texts are; the fit takes a sample of about ``fit_rows`` rows with about ``fit_values`` values, in one task.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).dropna().where(~held_out())
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1_000_000))
    chosen = usable.where(share < max(1, round(1_000_000 * min(1.0, fit_rows / max(1, usable.count())))))
    rows = _rows(docs).join(F.broadcast(chosen), "doc_id").select("text", "n_chars", "y")  # about fit_rows labels, whatever the tables' size
    schema = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("statistics", T.ArrayType(T.DoubleType())), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f = Features.of(part.column("text"), part.column("n_chars"), buckets)
                ends = pa.array(np.searchsorted(f.row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(f.bucket, pa.int32()), pa.array(f.value, pa.float32()))]
                dense = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(STATISTICS), pa.int32()), pa.array(f.statistics.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("y"), dense, *lists], names=schema.names)

    made = cut(rows.mapInArrow(run, schema))
    total = made.agg(F.sum(F.size("at") + len(STATISTICS))).first()[0] or 0
    if total > fit_values:
        made = made.where(F.pmod(F.xxhash64("statistics"), F.lit(1_000_000)) < round(1_000_000 * fit_values / total))
    fitted = "mean array<double>, scale array<double>, bias double, w array<double>, v array<double>"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        statistics = np.array(frame["statistics"].tolist(), dtype=np.float64).reshape(len(frame), -1)
        order = np.lexsort([*statistics.T, frame["y"]])
        m = fit_machine(statistics[order], [frame["at"].iloc[k] for k in order], [frame["value"].iloc[k] for k in order], frame["y"].to_numpy()[order], buckets)
        return pd.DataFrame([(m.mean, m.scale, m.bias, m.w, m.v.ravel())], columns=["mean", "scale", "bias", "w", "v"])

    for row in made.groupBy(F.lit(0).alias("all")).applyInPandas(lambda frame: fit(frame), fitted).collect():  # one row, of a size that BUCKETS fixes
        w = np.array(row["w"])
        return Machine(buckets, np.array(row["mean"]), np.array(row["scale"]), row["bias"], w, np.array(row["v"]).reshape(len(w), -1))
    return fit_machine(np.zeros((0, len(STATISTICS))), [], [], np.zeros(0), buckets)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    A null text is empty; an empty text is scored by its statistics and n_chars. Labels, lang, source and doc_id never go
    into a score, so repeated texts with the same n_chars score alike. Null and repeated doc_ids are rows like any other;
    extra columns are ignored; an empty table gives an empty table; without usable labels every score is one half. Whole
    texts are read, in slices; one scan, without a shuffle.
    """
    machine = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = machine.scores(Features.of(part.column("text"), part.column("n_chars"), machine.buckets))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    out = _rows(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
