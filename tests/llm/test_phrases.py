import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import phrases


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows, depth=3, least=10, taken=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from all contiguous phrases of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in n:
        rows = []
        for (g, words), a in found.items():
            if g != lang:
                continue
            longer = [b for (h, w), b in found.items() if h == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
            if any(100 * b >= taken * a for b in longer):
                continue
            score, k, left, right = min((10**6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            rows.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, texts=120, vocabulary=14):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "ßx", "a-b", "\x1c", "日本", " ", *(f"w{k}" for k in range(vocabulary))]
    weights = [1 / (k + 1) for k in range(len(words))]
    ends = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "!? ", ";:"]
    say = lambda: "".join(rng.choices(words, weights)[0] + rng.choice(ends) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und", ""]), say()) for _ in range(texts)]
    return rows + [("en", None), ("en", ""), ("en", " .\n"), ("fr", "one two three " * 9), ("x", "same same same " * 40), ("en", "of the " * 3000), *[rows[0]] * 30]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    docs = docs.withColumns({c: F.lit("x") for c in ("w1", "w2", "w3", "n", "f", "key", "deep", "whole", "phrase", "rank", "bucket")})
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


def test_like_brute_force(spark):
    """With groups of a few leaves, so that prefixes are lengthened and dealt in shares."""
    rows = corpus(1)
    got = run(spark, rows, budget=3)
    assert got == brute(rows) and len(got) > 30
    assert {r[0] for r in got} >= {"en", "und", "x", ""}


@pytest.mark.parametrize("depth, least, taken, top", [(2, 3, 50, 7), (4, 5, 30, 2000)])
def test_other_parameters(spark, monkeypatch, depth, least, taken, top):
    monkeypatch.setattr(phrases, "RANKED", 20)
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)
    rows = corpus(2, texts=60)
    assert run(spark, rows, depth=depth, least=least, taken=taken, top=top, budget=5) == brute(rows, depth, least, taken, top)


def test_small_slices_and_colliding_filters(spark, monkeypatch):
    """Texts cut into many slices; filters that let everything through give the same counts."""
    monkeypatch.setattr(phrases, "TEXT_BYTES", 200)
    rows = corpus(3)
    wanted = brute(rows)
    monkeypatch.setattr(phrases, "filter_of", lambda keys: phrases.Filter(np.full(1 << 15, 255, dtype=np.uint8)))
    assert run(spark, rows) == wanted


def test_exact_scores(spark):
    rows = [(10**13 + 7, 10**13 + 9, 3 * 10**13 + 1), (10, 10, 10), (999_999_999_999, 10**12, 10**12), (10, 10**14, 10**14)]
    out = spark.createDataFrame(rows, "a long, l long, r long").select(phrases.floor_score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in out] == [10**6 * a * a // (b * c) for a, b, c in rows]


def test_empty_table(spark, empty_docs):
    assert phrases.collocations(empty_docs).collect() == []


def test_filter():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    bits = np.zeros(1 << 18, dtype=np.uint8)
    for probe in (keys & np.uint64((1 << 18) - 1), (keys >> np.uint64(32)) & np.uint64((1 << 18) - 1)):
        bits[probe.astype(np.int64)] = 1
    f = phrases.Filter(np.packbits(bits, bitorder="little"))
    assert f.has(keys).all() and f.has(keys + np.uint64(12345)).mean() < 0.01


def test_edges(spark, edge_docs, edge_rows):
    got = sorted(map(tuple, phrases.collocations(edge_docs, least=2).collect()))
    assert got == brute([(g, t) for _, t, g, _, _ in edge_rows], least=2)
