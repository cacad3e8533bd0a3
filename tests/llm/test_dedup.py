"""Exact, substring and SimHash deduplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import exact, graph, simhash, substring

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_against_brute_force(edge_docs, edge_rows):
    groups = defaultdict(list)
    for i, t, *_ in edge_rows:
        groups[SPACES.sub(" ", t or "")].append(i)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, done = (min(known) if known else None), False
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            kept = i == keep and not done
            done |= kept
            want[(i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = Counter(map(tuple, exact.exact_duplicates(edge_docs, memtable_rows=5).collect()))
    assert got == want


def test_exact_digest_clashes_are_settled_by_bytes(edge_docs):
    weak = exact.exact_duplicates(edge_docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))
    strong = exact.exact_duplicates(edge_docs)
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    assert Counter(map(tuple, weak.select(cols).collect())) == Counter(map(tuple, strong.select(cols).collect()))


def test_exact_lookup_and_runs(edge_docs):
    digest = lambda c: F.sha2(c, 256)
    runs = exact.flush(edge_docs, digest, 4)
    one = hashlib.sha256(b"x").hexdigest()
    assert [r.doc_id for r in exact.lookup(runs, [one]).collect()] == [13]


def test_exact_drop_keeps_one_row_of_each_group(edge_docs, edge_rows, empty_docs):
    kept = exact.drop_exact_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [SPACES.sub(" ", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({SPACES.sub(" ", t or "") for _, t, *_ in edge_rows})
    assert exact.drop_exact_duplicates(empty_docs).count() == 0 and exact.exact_duplicates(empty_docs).count() == 0


def test_drops_keep_columns_of_any_name(spark):
    """Columns named as the operators' own come back with their values; null and repeated ids of one text are one row."""
    rows = [(k % 7 if k % 3 else None, f"text number {k % 11} of some words in a row", f"mine{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    docs = docs.withColumns({c: F.col("__id") for c in ("__digest", "__t", "raw", "row", "tkey", "digest", "kept")})
    for drop in (exact.drop_exact_duplicates, simhash.drop_near_duplicates):
        kept = drop(docs)
        got = kept.collect()
        assert kept.columns == docs.columns and all(r["__id"].startswith("mine") and len({r[c] for c in docs.columns[2:]}) == 1 for r in got)
    assert sorted(r.text for r in exact.drop_exact_duplicates(docs).collect()) == sorted({t for _, t, _ in rows})


def removed_by_hand(rows, window):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    starts = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("window", "k"), [(35, 8), (12, 4)])
def test_substring_against_brute_force(edge_docs, edge_rows, window, k):
    got = substring.remove_repeats(edge_docs, window=window, k=k).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == removed_by_hand(edge_rows, window)


def test_substring_small_alphabet_branches(spark):
    import random

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(80)), "en", "s", 0) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = substring.remove_repeats(docs, window=10, k=3).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == removed_by_hand(rows, 10)


@pytest.mark.parametrize("bits", [0, 3])
def test_substring_label_collisions_are_settled_at_the_source(edge_docs, edge_rows, bits):
    """Labels of 0 or 3 bits collide, so paths are compacted that differ: the words at the coordinates decide."""
    spans = substring.repeated_spans(edge_docs, 12, 4, label_bits=bits)
    got = {(r.kid, r.tkey): [tuple(s) for s in r.spans] for r in spans.collect()}
    want = {(r.kid, r.tkey): [tuple(s) for s in r.spans] for r in substring.repeated_spans(edge_docs, 12, 4).collect()}
    assert got == want and got


def test_substring_collided_paths_repeat_in_part(spark):
    """One path of two texts that differ in one word: with labels of no bits it is split window by window."""
    one = [f"w{k}" for k in range(400)]
    two = [*one[:200], "other", *one[201:]]
    rows = [(1, " ".join(one), "", "", 0), (2, " ".join(two), "", "", 0), (3, "a b " * 60, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = [(k, substring.repeated_spans(docs, 10, 3, label_bits=k).collect()) for k in (0, 64)]
    for _, got in runs:
        assert {r.kid: [tuple(s) for s in r.spans] for r in got} == {1: [(0, 190), (201, 390)], 2: [(0, 190), (201, 390)], 3: [(0, 110)]}


def test_paths_are_compacted_to_their_heads(spark):
    links = [(k, k - 1) for k in range(1, 1000)] + [(2001, 2000)]
    heads = {r.node: r.head for r in substring.path_heads(spark.createDataFrame(links, "node long, to long")).collect()}
    assert heads == {**{k: 0 for k in range(1, 1000)}, 2001: 2000}
    assert substring.path_heads(spark.createDataFrame([], "node long, to long")).count() == 0
    words = " ".join(f"w{k}" for k in range(3000))
    rows = [(k, words, "", "", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    paths = substring.compact_paths(substring.graph_edges(docs)).collect()
    assert [(p.straight, p.width) for p in paths] == [(True, 3000 - 34)]


def test_substring_empty(empty_docs):
    assert substring.remove_repeats(empty_docs).count() == 0


def fingerprint_by_hand(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    shingles = [b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(edge_docs, edge_rows, empty_docs):
    prints = [fingerprint_by_hand(t) for _, t, *_ in edge_rows]
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(edge_rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, f"{prints[k]:016x}", least.get(find(k))) for k, (i, *_) in enumerate(edge_rows))
    assert Counter(map(tuple, simhash.simhash_components(edge_docs).collect())) == want
    assert simhash.simhash_components(empty_docs).count() == 0


def test_spark_hash_is_the_same_function(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_ball_links_find_every_pair(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {*base, *(b ^ (1 << rng.randrange(64)) for b in base), *(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(0, p) for p in signed], "table int, f long")
    found = graph.components(simhash.ball_links(df).select("a", "b"))
    comp = {r.node: r.component for r in found.collect()}
    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) % 2**64).count("1") <= 2:
                assert comp[a] == comp[b]


def test_components_long_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(300)) and 5000 not in got


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or {tuple(w)}


def test_near_duplicates_drop_close_copies_and_keep_the_rest(spark, edge_docs, empty_docs):
    import random

    rng = random.Random(11)
    rows = []
    for g in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((g * 10, " ".join(w)))
        for c in range(1, 4):
            v = list(w)
            v[rng.randrange(200)] = f"new{c}"
            rows.append((g * 10 + c, " ".join(v)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [g * 10 for g in range(30)]
    kept = simhash.drop_near_duplicates(edge_docs).collect()
    texts = [r.text or "" for r in kept]
    assert len(texts) == len(set(texts)) and simhash.drop_near_duplicates(empty_docs).count() == 0
    ids = {r.doc_id for r in kept}
    assert 12 not in ids and 10 in ids  # a copy with one word more


def test_near_duplicates_recall_on_documents(spark):
    """Against all pairs at 0.8 or more over the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    lost = set(sets) - kept
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.8]
    assert all(any(alike(a, b) >= 0.8 for b in sets if b != a) for a in lost)
    assert pairs and not [p for p in pairs if p[0] in kept and p[1] in kept]  # none is missed


@pytest.mark.parametrize(("bucket", "rounds"), [(32, 6), (2, 1), (2, 4)])
def test_near_duplicates_are_those_of_all_pairs(spark, bucket, rounds):
    """Appended, cut and replaced blocks near 0.8, a line repeated many times, and passages that very many documents share."""
    import random

    rng = random.Random(21)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared, line, rows = [some(60) for _ in range(3)], some(15), []
    for _ in range(12):
        w = some(240)
        at = rng.randrange(180)
        rows += [w, w + some(rng.randint(50, 64)), w[: rng.randint(188, 200)], w[:at] + some(rng.randint(20, 32)) + w[at + 26 :], w + line, w + line * 12]
    rows += [p + some(rng.randint(0, 25)) for p in shared for _ in range(25)] + [some(3), some(3), ["one", "two"], ["One", "two"]]
    bodies = [" ".join(w) for w in rows]
    docs = spark.createDataFrame(list(enumerate(bodies)), "node long, text string")
    links = simhash.near_duplicate_links(docs, bucket=bucket, rounds=rounds).collect()
    sets = [shingles(t) for t in bodies]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])

    def groups(pairs):
        of = list(range(len(sets)))
        for a, b in pairs:
            x, y = of[a], of[b]
            of = [min(x, y) if k in (x, y) else k for k in of]
        return of

    assert all(alike(r.a, r.b) >= 0.8 for r in links)
    assert groups([(r.a, r.b) for r in links]) == groups([(a, b) for a in range(len(sets)) for b in range(a) if alike(a, b) >= 0.8])


def test_near_duplicates_go_through_ball_hashing(spark, monkeypatch):
    """Its candidates are a star for each fingerprint, and what they link is in the groups; the prefixes add what fingerprints lose."""
    words = [f"w{k}" for k in range(200)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(words).upper()), (4, "other text")], "node long, text string")
    pairs = {tuple(sorted(r)) for r in simhash.ball_pairs(rows).collect()}
    assert (1, 3) in pairs and not any(4 in p for p in pairs) and len(pairs) <= 3
    asked, plain = [], simhash.ball_pairs
    monkeypatch.setattr(simhash, "ball_pairs", lambda some: asked.append(1) or plain(some))
    kept = simhash.drop_near_duplicates(rows.withColumnRenamed("node", "doc_id"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and asked == [1]


def test_first_candidates_are_made_in_bounded_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"a b c d e f {i % 7} g h " * (i % 5)) for i in range(60)], "node long, text string")
    whole = {(r.doc_id, r.f0) for r in simhash.fingerprints(rows.withColumnRenamed("node", "doc_id")).collect()}
    assert {(r.doc_id, r.f0) for r in simhash.fingerprints(rows.withColumnRenamed("node", "doc_id"), at_once=50).collect()} == whole
    seen, was, names = [], simhash.cut, ("maxRecordsPerBatch", "maxBytesPerBatch")
    monkeypatch.setattr(simhash, "cut", lambda df: (seen.append([df.sparkSession.conf.get(f"spark.sql.execution.arrow.{n}") for n in names]), was(df))[1])
    simhash.ball_pairs(rows).collect()
    assert seen == [[str(simhash.BATCH_ROWS), f"{simhash.BATCH_BYTES}b"]]


def test_near_copies_that_stay_apart_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of one text with more and more words changed: what is compared grows with the copies, and the groups are those of all pairs."""
    import random

    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    bodies = [" ".join(words)]
    for c in range(160):
        copy = list(words)
        for k in rng.sample(range(150), 1 + c % 8):
            copy[k] = f"new{c}x{k}"
        bodies.append(" ".join(copy))
    rows = spark.createDataFrame(list(enumerate(bodies)), "node long, text string")
    compared, plain = [], simhash._jaccard
    monkeypatch.setattr(simhash, "_jaccard", lambda pairs, size: compared.append(pairs.count()) or plain(pairs, size))
    links = [(r.a, r.b) for r in simhash.near_duplicate_links(rows).collect()]
    assert sum(compared) <= 8 * len(bodies)
    sets = [shingles(t) for t in bodies]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = lambda some: {(r.node, r.component) for r in graph.components(spark.createDataFrame(some, "a long, b long")).collect()}
    assert groups(links) == groups(pairs)


def test_parities_differ_in_no_more_bits_than_sets(spark):
    texts = ["", "one two", "one two three four five six", "one two three four five seven", " ".join(f"w{k}" for k in range(900)), " ".join(f"w{k}" for k in range(100, 990))]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    bits = {r.node: [x & ((1 << 64) - 1) for x in r.parity] for r in simhash.parities(rows, 5).collect()}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True))
    sets = [shingles(t) if t else set() for t in texts]
    assert all(apart(a, b) <= len(sets[a] ^ sets[b]) for a in bits for b in bits) and apart(0, 1) == 1 and apart(2, 3) in (0, 2)
    assert apart(4, 0) % 2 == 0 and apart(4, 5) > 50
