import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Levels from the nodes to the root, and each node's siblings with their sides."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[k : k + 2]) for k in range(0, len(below), 2)])
    ways = []
    for place in range(len(nodes)):
        way, k = [], place
        for level in levels[:-1]:
            other = k ^ 1
            way.append((k % 2, level[other] if other < len(level) else None))
            k //= 2
        ways.append(way)
    return levels[-1][0], ways


def brute(rows):
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sub, out = {}, []
    for g in order:
        groups[g] = sorted(((leaf(*r), r) for r in groups[g]), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        sub[g] = tree([h for h, _ in groups[g]])
    root, upper = tree([sub[g][0] for g in order])
    for g, above in zip(order, upper, strict=True):
        for (h, r), way in zip(groups[g], sub[g][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = leaf(r[0], r[1], r[2], r[3] + 1, r[4]) if hit else h
            for side, other in way + above:
                now = H(now) if other is None else H(other, now) if side else H(now, other)
            out.append((r[0], h, sub[g][0], root, H(*(o for _, o in way + above if o)), now, now == root))
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    langs = [None, "", "de", "en", "z", "ü", "日"]
    some = lambda v: None if rng.random() < 0.1 else v
    rows = [(k * 3 - 5, some(f"s{k % 4}"), rng.choice(langs + ["en"] * 5), some(k), some("tëxt " * (k % 9))) for k in range(n)]
    return rows + [(None, "s", "en", 4, "none"), (None, None, None, None, None), (None, None, None, None, None), rows[0], rows[0], (1 << 60, "s", "en", None, "x" * 50_000)]


@pytest.mark.parametrize("n, bits", [(1, 1), (40, 1), (150, 2), (300, 10)])
def test_manifest_like_brute_force(spark, monkeypatch, n, bits):
    rows = rows_of(n, n)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    docs = docs.withColumns({c: F.lit("x") for c in ("g", "pos", "n", "row", "digest", "block", "changed", "path")})
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: whole(*a, bits=bits, **k))
    got = sorted(map(tuple, merkle.tampered_manifest(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert n < 100 or len({r[-1] for r in got}) == 2  # some tampered, most not


def test_proofs_fold_back(spark):
    rows = rows_of(70, 3)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(docs, bits=3).collect()
    assert len(out) == len(rows) and all(r.verified for r in out)
    assert all(merkle.fold(r.leaf, r.path, r.siblings) == r.root for r in out)
    assert all(len(r.siblings) == sum(s != "A" for s in r.path) for r in out)
    assert {r.lang for r in out} == {r[2] for r in rows}


def test_shuffled_starts_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_STARTS", 0)
    monkeypatch.setattr(merkle, "SORT_ROWS", 3)
    rows = [(f"k{k:03d}", k % 2, str(k)) for k in range(50)]
    out = merkle.manifest(spark.createDataFrame(rows, "name string, part int, body string"), ("name", "body"), group="part", order="name", bits=2).collect()
    assert {r.name: r.leaf for r in out} == {n: H(*(f"{len(v)}:{v}" for v in (n, b))) for n, _, b in rows}
    assert {r.part: r.subroot for r in out} == {str(p): tree([H(*(f"{len(v)}:{v}" for v in (n, b))) for n, q, b in rows if p == q])[0] for p in (0, 1)}


def test_empty_table(spark, empty_docs):
    assert merkle.tampered_manifest(empty_docs).collect() == []


def test_edges(spark, edge_docs, edge_rows):
    out = merkle.tampered_manifest(edge_docs).collect()
    assert sorted(map(tuple, out), key=str) == sorted(brute([(i, s, g, n, t) for i, t, g, s, n in edge_rows]), key=str)
