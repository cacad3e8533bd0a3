import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import quality, queries


def features(texts, n_chars=None, buckets=64):
    return quality.Features.of(pa.array(texts, pa.string()), pa.array(n_chars or [None] * len(texts), pa.int64()), buckets)


def test_pairs_like_brute_force():
    """The linear-time score is the sum over all pairs of features."""
    rng = np.random.default_rng(3)
    f = features(["a b c a", "", None, "The end! of ### 12,\nnew line | é", "x " * 500], [7, 0, None, 20, 1000])
    size = 64 + len(quality.STATISTICS)
    m = quality.Machine(64, rng.normal(size=len(quality.STATISTICS)), rng.uniform(1, 2, len(quality.STATISTICS)), 0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.1, (size, 5)))
    dense = m.scaled(f.statistics)
    for k, score in enumerate(m.scores(f)):
        x = np.concatenate([np.zeros(64), dense[k]])
        for b, v in zip(f.bucket[f.row == k], f.value[f.row == k], strict=True):
            x[b] += v
        z = m.bias + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(size) for j in range(i))
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_slopes():
    rng = np.random.default_rng(5)
    at, first, y = np.array([0, 2, 3, 1, 2, 0]), np.array([0, 3, 5]), np.array([1.0, 0.0, 1.0])
    x, w, v = rng.normal(size=6), rng.normal(size=4), rng.normal(size=(4, 3))
    loss = lambda w, v, b=0.2: quality.loss_and_slopes(at, x, first, y, b, w, v)[0]
    _, slope, by_w, by_v = quality.loss_and_slopes(at, x, first, y, 0.2, w, v)
    assert (loss(w, v, 0.2 + 1e-6) - loss(w, v, 0.2 - 1e-6)) / 2e-6 == pytest.approx(slope.sum(), abs=1e-6)
    for i in range(4):
        step = np.zeros(4)
        step[i] = 1e-6
        assert (loss(w + step, v) - loss(w - step, v)) / 2e-6 == pytest.approx(by_w[at == i].sum(), abs=1e-6)
        for d in range(3):
            turn = np.zeros((4, 3))
            turn[i, d] = 1e-6
            assert (loss(w, v + turn) - loss(w, v - turn)) / 2e-6 == pytest.approx(by_v[at == i, d].sum(), abs=1e-6)


def test_statistics():
    f = features(["Ab c! ##\nab é", "", "  \n"], [13, None, 5])
    get = lambda k, name: f.statistics[k][quality.STATISTICS.index(name)]
    assert get(0, "upper") == 1 / 14 and get(0, "line") == 1 / 14 and get(0, "symbol") == 2 / 14 and get(0, "beyond") == 2 / 14
    assert get(0, "different_words") == 4 / 5 and get(0, "commonest_word") == 2 / 5 and get(0, "symbol_ends") == 1 / 5 and get(0, "loud_ends") == 1 / 5
    assert get(0, "capital_starts") == 1 / 5 and get(0, "word_length") == 2 and get(0, "log_lines") == pytest.approx(np.log(2))
    assert get(1, "no_n_chars") == 1 and get(0, "no_n_chars") == 0 and get(1, "log_bytes") == 0 and get(2, "log_words") == 0 and get(2, "line") == 1 / 3
    ones = np.bincount(f.row, weights=f.value**2, minlength=3)
    assert ones == pytest.approx([1, 0, 0])


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op11_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    return out, labels, queries.table(spark, sf, "documents").count()


def test_held_out_accuracy(scored):
    out, labels, n = scored
    assert len(out) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [(out[i].score, out[i].predicted, y) for i, y in labels.items() if out[i].held_out]
    good, bad = ([s for s, _, y in held if y == c] for c in (1, 0))
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.97
    assert np.mean([p == y for _, p, y in held]) > 0.95


def test_held_out_labels_are_not_learned(spark, scored):
    """Other labels of held-out rows, other sources and languages: the same scores."""
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs.withColumns({"lang": F.lit("xx"), "source": F.col("doc_id").cast("string")}), turned).collect()}
    assert again == pytest.approx({i: r.score for i, r in scored[0].items()}, abs=1e-9)


def test_bounded_fit(spark):
    """A bound on values thins the sample, it does not fail."""
    sf = "/root/testdata/sf0.001"
    m = quality.fit_quality(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"), fit_rows=60, fit_values=4_000)
    assert np.isfinite(m.w).all() and np.isfinite(m.v).all()


def test_edges(spark, edge_docs, edge_rows, empty_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, None), (None, 1), (999, 0), (14, 0), (14, 1)], "doc_id long, quality int")
    clash = edge_docs.withColumns({c: F.lit("x") for c in ("y", "score", "statistics", "at", "value")})
    out = quality.score_quality(clash, labels).collect()
    assert len(out) == len(edge_rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    assert quality.score_quality(empty_docs, labels).collect() == []
    none = quality.score_quality(edge_docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
