"""Licenses, scores, packing, mixing, chat, media, toxicity and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, license, lm, media, mixing, packing, queries, toxicity

SF = "/root/testdata/sf0.001"
LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- licenses


def base_by_hand(text):
    w = LICENSE_WORD.findall(low(text))
    places, labels = [], set()
    for phrase, label in license.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENSED = ["Under the MIT License, under the mit license", "Licensed under the Apache License, Version 2.0", "CC BY-NC 4.0 cc/by/nc", "released undr the mit licence!", "This work is licenced under the GNU Genral Public License", "under the mit licenses", "thunder the mit license", "", None, "apache license version 2" * 2, "all rights resrved", "é" * 50 + " cc by nc"]


def test_license_base_columns_and_fuzzy_labels(spark, edge_rows):
    texts = LICENSED + [t for _, t, *_ in edge_rows]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in license.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert "mit" in got[3].labels and "gpl" in got[4].labels and got[10].labels == "all-rights-reserved" and got[8].score == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_search_finds_every_notice_within_its_edits():
    import random

    rng = random.Random(2)
    for text, label, most in license.NOTICES:
        for _ in range(30):
            x = list(text)
            for _ in range(rng.randint(0, most)):
                k = rng.randrange(len(x))
                kind = rng.randrange(3)
                if kind == 0:
                    x[k] = rng.choice("qzx")
                elif kind == 1 and len(x) > 1:
                    del x[k]
                else:
                    x.insert(k, rng.choice("qzx"))
            line = " before it " + "".join(x) + " and after "
            found = license.Notice(text, label, most).find(line)
            assert found and all(edits(text, line[a:b]) <= most for a, b, _ in found)


def test_fuzzy_search_finds_every_notice_of_a_run():
    """Exact and misspelt copies side by side: each is found, as far as a search of its own place finds it."""
    import random

    rng = random.Random(9)
    for text, label, most in license.NOTICES:
        notice = license.Notice(text, label, most)
        for _ in range(20):
            line, own = " ", []
            for _ in range(rng.randint(2, 6)):
                x = list(text)
                for _ in range(rng.randint(0, most)):
                    x[rng.randrange(1, len(x) - 1)] = rng.choice("qzx")
                own.append((len(line), len(line) + len(x)))
                line += "".join(x) + rng.choice([" ", " and then ", " x "])
            found = notice.find(line)
            assert len(found) == len(own) and all(edits(text, line[a:b]) <= most for a, b, _ in found)
            assert all(min(b, d) - max(a, c) > len(text) // 2 for (a, b, _), (c, d) in zip(found, own, strict=True))


LOOKALIKES = {
    "released under the BSD license": "", "released under the GPL license": "", "released under the new license": "", "under the cc license": "", "under the ISO license": "",
    "licensed under CC BY SA 4.0": "", "licensed under CC BY-ND 4.0": "", "licensed under CC BY-NC 3.0": "cc-by-nc", "licensed under CC BY NC 4.0": "cc-by-nc", "licensd undr CC BY NC 4.0": "cc-by-nc",
    "this work is licensed under the GNU General Public License version 2": "gpl", "this work is licensed under the GNU General Public License version 3": "gpl,gpl-3", "this wrk is licenced under the GNU General Public License version 3.": "gpl,gpl-3",
    "licensed under the Apache License, version 1.1": "", "licensed under the Apache License, version 2.0": "apache-2", "licensed under the Apach Licence, version 2.0": "apache-2", "licensed under the Apache License, version 2.01": "apache-2",
    "released under the MIT license": "mit", "relesed undr the MIT licence": "mit", "released under the mut license": "", "under the ISC licence": "isc",
}


def test_license_lookalikes_have_no_foreign_label():
    for text, labels in LOOKALIKES.items():
        got = license.scan(text)
        assert ",".join(sorted({*got["base"], *(s[0] for s in got["spans"])})) == labels, text


def test_no_notice_counts_as_another():
    """Every pair of the list: a notice as it stands has its own label, and those of notices that it contains."""
    for text, label, _ in license.NOTICES:
        inside = {m for t, m, _ in license.NOTICES if f" {t} " in f" {text} "} | {m for t, m in license.BASE.items() if f" {t} " in f" {text} "}
        assert {s[0] for s in license.scan(f"here {text} there")["spans"]} | set(license.scan(text)["base"]) == inside | {label}, text


def test_license_lists_are_parameters(spark):
    docs = spark.createDataFrame([(1, "our hous rules apply, under the mit license")], "doc_id long, text string")
    r = license.scan_licenses(docs, base={"rules apply": "own"}, notices=(("our house rules", "house", 2),)).first()
    assert (r.n_base, r.base_labels, r.labels, r.first_word) == (1, "own", "house,own", 2)


# --- language model


def scores_by_hand(texts, corpus=None):
    docs = [low(t).encode().split() for t in texts]
    learnt = docs if corpus is None else [low(t).encode().split() for t in corpus]
    one, two, n = Counter(), Counter(), sum(map(len, learnt))
    for d in learnt:
        one.update(d)
        two.update(zip([None, *d], d, strict=False))
    one[None] = sum(bool(d) for d in learnt)
    out = []
    for d in docs:
        s = 0.0
        for a, b in zip([None, *d], d, strict=False):
            s += math.log(two[a, b] / one[a]) if two[a, b] else math.log(0.4 * max(1, one[b]) / max(1, n))
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("hot", [1e-5, 0.01])
def test_scores_against_brute_force(spark, edge_docs, edge_rows, empty_docs, hot):
    want = Counter((i, n, round(s, 6)) for (i, *_), (n, s) in zip(edge_rows, scores_by_hand([t for _, t, *_ in edge_rows]), strict=True))
    got = lm.score(edge_docs, hot=hot, hot_words=hot, partition_rows=500)
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got.collect()) == want
    assert lm.score(empty_docs).count() == 0


def test_scores_under_another_corpus_back_off(spark, edge_docs, edge_rows, empty_docs):
    corpus = ["one two one two three", "a b a", None, "abc one"]
    known = spark.createDataFrame([(k, t) for k, t in enumerate(corpus)], "doc_id long, text string")
    for table, learnt in ((known, corpus), (empty_docs, [])):
        want = Counter((i, n, round(s, 6)) for (i, *_), (n, s) in zip(edge_rows, scores_by_hand([t for _, t, *_ in edge_rows], learnt), strict=True))
        got = lm.score(edge_docs, table)
        assert Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got.collect()) == want


def test_rare_words_keep_their_own_counts(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "x z")], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in lm.score(docs, hot=0.3, hot_words=0.3).collect()}
    assert got[1] == got[2] == pytest.approx(math.log(2 / 3)) and got[3] == pytest.approx(math.log(1 / 3))


# --- packing


def check_packing(pieces, docs, capacity=4096):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in docs:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for p, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[(i, p, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(n for parts in bins.values() for _, n in parts)


def test_lm_rare_bigrams_are_counted_first(spark):
    """A bigram of a share of 3 in a million is among those looked up where they stand, with its exact count."""
    from collections import Counter

    from skein.llm import lm

    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 1000 + j) % 7} v{j % 11}" for j in range(1000)) + " rare pair") for k in range(160)], "doc_id long, text string")
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 5, F.concat("text", F.lit(" only once"))).otherwise(F.expr("replace(text, ' rare pair', '')")))
    keys, counts, total = lm.hot_ngrams(docs, lm.HOT_WORDS, lm.HOT)
    texts = [r.text for r in docs.collect()]
    want = Counter()
    for t in texts:
        w = t.split()
        want.update(zip(["", *w], w))
    assert total == sum(len(t.split()) for t in texts) and want["only", "once"] == 1
    assert sorted(counts[keys & 1 == 1].tolist()) == sorted(want.values())


def test_packing_round_trip(edge_docs, edge_rows, empty_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(edge_docs, path).collect()
    used, total = check_packing(rows, [(i, t) for i, t, *_ in edge_rows])
    assert used <= -(-total // 4096) + 1
    assert packing.pack(empty_docs, path).count() == 0


def test_packing_is_close_to_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    used, total = len({r.sequence_id for r in rows}), sum(r.length for r in rows)
    assert used <= -(-total // 4096) * 1.01 + 1


def test_bin_completion_is_optimal_on_small_cases():
    import random

    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randint(1, 20) for _ in range(9)]
        counts = np.bincount(sizes, minlength=21)
        plan = packing.bin_completion(counts, 20)
        spent = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 20
            for n in pattern:
                spent[n] += times
        assert spent == Counter(sizes)

        def least(items, bins=()):
            if not items:
                return len(bins)
            n, *rest = items
            tried, best = set(), 99
            for k, b in enumerate(bins):
                if b + n <= 20 and b not in tried:
                    tried.add(b)
                    best = min(best, least(rest, (*bins[:k], b + n, *bins[k + 1 :])))
            return min(best, least(rest, (*bins, n)))

        assert sum(t for _, t in plan) == least(sorted(sizes, reverse=True)) >= packing.lower_bound(counts, 20)


def test_bin_completion_meets_the_bound_on_many_lengths():
    sizes = np.clip(np.random.default_rng(1).lognormal(5.7, 1.0, 20_000).astype(int), 1, 4095)
    counts = np.bincount(sizes, minlength=4097)
    used = sum(t for _, t in packing.bin_completion(counts, 4096))
    assert packing.lower_bound(counts, 4096) <= used <= packing.lower_bound(counts, 4096) + 1 and used <= sum(t for _, t in packing.best_fit(counts, 4096))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_tokenizers_ids(edge_rows, name):
    import pyarrow as pa

    coder = packing.WordCoder(public_tokenizers.path(name))
    assert coder.by_word == name.startswith("word")  # the other one keeps white space
    texts = [t or "" for _, t, *_ in edge_rows] + ["don't <|endoftext|> x", "<|ENDOFTEXT|>a", "É,É é\u0301 İstanbul ǅ 12,5 a\u00a0b \x1c z\x85y", "", "É", " 's 't ’s ﬁ", "ñ%%% ß. ÀÖ;; µ ÷× ª º Ab.,c %%", "word\n\nword"]
    ids, n = coder.encode(pa.array(texts), 1)
    for own, text in zip(np.split(ids, np.cumsum(n)[:-1]), texts, strict=True):
        assert own.tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


# --- mixing


def test_mixing_keeps_every_row_and_stays_within_a_block(spark, edge_docs, edge_rows, empty_docs):
    weights = {"src0": 0.5, "src1": 0.3, "src2": 0.15, mixing.NO_SOURCE: 0.05}
    rows = mixing.mix(edge_docs, weights, block_rows=2).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in rows) == Counter((i, t) for i, t, *_ in edge_rows)
    slots = defaultdict(set)
    for r in rows:
        slots[r.slot].add((r.source, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    order = [next(iter(slots[k]))[0] for k in range(len(slots))]
    left = Counter(order)
    for t, _ in enumerate(order, 1):  # up to the first source that runs out
        for s, w in weights.items():
            assert abs(order[:t].count(s) - w * t) < 1
        if any(order[:t].count(s) == left[s] for s in weights):
            break
    assert mixing.mix(empty_docs).count() == 0 and mixing.mixed_order(edge_docs).columns == edge_docs.columns
    with pytest.raises(ValueError):
        mixing.mix(edge_docs, {"src0": 1.0})


def test_timetable_meets_releases_and_deadlines():
    for share in ({"a": 500, "b": 300, "c": 200}, {"a": 1, "b": 999}, {str(k): 20 for k in range(50)}, {"a": 333, "b": 333, "c": 334}):
        slots = mixing.timetable(share, 1000)
        assert sorted(x for s in slots.values() for x in s) == list(range(1000))
        for s, own in slots.items():
            for j, t in enumerate(own, 1):
                assert (j - 1) * 1000 // share[s] <= t < -(-j * 1000 // share[s])


def test_hot_source_is_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 500, "hot").otherwise("cold").alias("source"))
    rows = mixing.mix(docs, {"hot": 0.5, "cold": 0.5}, block_rows=10).collect()
    assert len({(r.slot, r.place) for r in rows}) == 600 and {r.slot for r in rows} == set(range(max(r.slot for r in rows) + 1))


def test_mixing_stays_within_a_block_of_the_weights_themselves():
    from fractions import Fraction

    for weights in ({"a": 1 / 3, "b": 2 / 3}, {"a": 0.0001, "b": 0.9999}, {str(k): math.sqrt(k) for k in range(1, 12)}):
        exact, done, n = {s: Fraction(str(w)) for s, w in weights.items()}, Counter(), 20_000
        for t, s in zip(range(1, n + 1), mixing.turns(dict.fromkeys(weights, n), weights), strict=False):
            done[s] += 1
            if t % 97 == 0 or t == n:
                assert all(abs(done[x] - w / sum(exact.values()) * t) < 1 for x, w in exact.items())


def test_mixing_deals_null_and_repeated_ids_by_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    docs = spark.range(600).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc_id"), F.lit("hot").alias("source"), F.col("id").alias("slot"), F.lit("mine").alias("__hash"))
    rows = mixing.mix(docs, block_rows=10).collect()
    assert sorted(r.row.slot for r in rows) == list(range(600)) and {r.row["__hash"] for r in rows} == {"mine"}
    assert len({(r.slot, r.place) for r in rows}) == 600 and {r.slot for r in rows} == set(range(max(r.slot for r in rows) + 1))
    assert len({r.slot for r in rows}) <= 60 + 30  # as many short blocks as groups: none holds most of the rows


def test_mixed_order_keeps_columns_of_any_name(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), *[F.lit(c).alias(c) for c in ("__slot", "__block", "__hash", "__salt", "__n", "row", "place")])
    out = mixing.mixed_order(docs, block_rows=4)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_mixing_takes_many_sources(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 600).alias("source"))
    rows = mixing.mix(docs, block_rows=2).collect()
    assert len(rows) == 2000 and {r.slot for r in rows} == set(range(len({(r.source, r.block) for r in rows})))


# --- chat


def test_chat_round_trip(spark):
    said = [(1, 0, "system", "be\\good </s>"), (1, 1, "user", "[INST] <s> \\l"), (1, 2, "assistant", " </s> "), (2, 1, "assistant", "b"), (2, 0, None, None), (2, 1, "assistant", "a"), (2, None, "weird [INST]", "x<</TURN>>y"), (None, 0, "user", "\U0001f600"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    by = defaultdict(list)
    for c, t, r, x in said:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    for c, turns in by.items():
        want = [(r, x) for _, r, x in sorted(turns)]
        assert [(t.role, t.text) for t in got[c].turns] == want and not got[c].rewrites
        assert "".join(chat.unescape(got[c].output[s.start : s.end]) for s in got[c].loss) == "".join(x for r, x in want if r == "assistant")
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_rewriting_template_is_detected(spark):
    def forgetful(turns):
        return "".join(f"<{r}>{t if k >= len(turns) - 2 else '...'}" for k, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, k, "user", f"text {k}") for k in range(4)], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(df, template=forgetful).first()
    assert row.rewrites == [2, 3] and not row.loss


def test_escape_is_reversible():
    import itertools

    for x in map("".join, itertools.product(["\\", "</s>", "[INST]", "l", "b", "<", "[", "/s>"], repeat=4)):
        assert chat.unescape(chat.escape(x)) == x and not any(c in chat.escape(x) for c in chat.CONTROL)


# --- media


def test_media_of_documents(edge_docs, edge_rows, empty_docs):
    got = media.document_media(edge_docs).collect()
    want = Counter()
    for i, t, *_ in edge_rows:
        raw = (t or "").encode()
        full = media.padded(raw)
        assert len(full) % 64 == 0 and full and media.from_media(media.to_media(full)) == full
        want[(i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media.to_media(full)), hashlib.sha256(media.to_media(full)).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == want
    assert {r.feature for r in got if r.n_bytes == 0} == {media.feature_of(np.zeros(64, np.uint8))}
    assert media.document_media(empty_docs).count() == 0


def test_interleaved_sequences_keep_order_and_captions(spark):
    payload = b"picture"
    digest = hashlib.sha256(media.padded(payload)).hexdigest()
    html = f'<html><head><title>no</title></head><p>one <b>two</b></p><figure><img src="sha256:{digest}" alt="alt"><figcaption>the &amp; caption</figcaption></figure>three<img src="http://x/y.png" alt="other"><script>no</script><p>four'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>broken <figure><img src=a"), (1, html)], "page_id long, html string").withColumn("items", F.lit(0))
    seq = media.interleave(pages, "page_id")
    store = media.store(spark.createDataFrame([(1, bytearray(payload))], "id long, data binary"), "id", "data")
    rows = {r.page_id: r["items"] for r in media.resolve(seq.dropDuplicates(["page_id"]), "page_id", store).collect()}
    assert [(x.kind, x.text or x.caption) for x in rows[1]] == [("text", "one two"), ("media", "the & caption"), ("text", "three"), ("media", "other"), ("text", "four")]
    assert [x.pos for x in rows[1]] == list(range(5)) and rows[1][1].media.payload_bytes == 64 and rows[1][3].media is None and rows[2] == []


@pytest.mark.parametrize(("html", "want"), [
    ("<html><head><title>t</title><p>one", ["one"]),
    ("<head><meta charset=x>plain words<body>more", ["plain words", "more"]),
    ("<p>a<nav><li>menu</nav><p>b", ["a", "b"]),
    ("<p>a<nav><p>all the rest<p>and more", ["a", "all the rest", "and more"]),
    ("<figure><img src=x><figcaption>cap</figure><p>after", [("x", "cap"), "after"]),
    ("<figure><img src=x><figcaption>cap<p>after<p>more", [("x", "cap"), "after", "more"]),
    ("<figure><figcaption>cap</figcaption><img src=x><img src=y alt=z></figure>after<img src=q alt=w>", [("x", "cap"), ("y", "cap"), "after", ("q", "w")]),
    ("<figure><figcaption>alone</figcaption></figure><p>x", ["alone", "x"]),
    ("<template><p>no<img src=n></template>yes</nav></p>", ["yes"]),
    ("<figure><img src=x><figcaption>one<figure><img src=y><figcaption>two</figcaption></figure>", [("x", "one"), ("y", "two")]),
    ("<script>no", []),
])
def test_broken_pages_keep_texts_and_captions(html, want):
    got = media.sequence_of(html)
    assert [x["text"] if x["kind"] == "text" else (x["ref"], x["caption"]) for x in got] == want and [x["pos"] for x in got] == list(range(len(want)))


def test_hot_digest_is_dealt(spark):
    digest = hashlib.sha256(media.padded(b"hot")).hexdigest()
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), "id", F.lit(f'<img src="sha256:{digest}" alt=a><img src="sha256:none">')).alias("html"))
    store = media.store(spark.createDataFrame([(1, bytearray(b"hot"))], "id long, data binary"), "id", "data")
    rows = media.resolve(media.interleave(pages, "page_id"), "page_id", store).collect()
    assert len(rows) == 600 and all([x.pos for x in r["items"]] == [0, 1, 2] and r["items"][1].media.payload_sha256 == digest and r["items"][2].media is None for r in rows)


def test_real_pages_parse(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = media.interleave(pages, "page_id").collect()
    assert len(rows) == pages.count() and all(r["items"] for r in rows)
    assert all([x.pos for x in r["items"]] == list(range(len(r["items"]))) for r in rows)


# --- toxicity


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0)
    chain = toxicity.fit_chain(docs, labels.join(held.select("doc_id"), "doc_id", "left_anti"))
    scored = chain.score(docs.join(held, "doc_id")).join(held, "doc_id").collect()
    right = [r.toxic for r in scored if r.p_toxic >= 0.5]
    toxic = [r for r in scored if r.toxic]
    assert sum(right) / len(right) > 0.95 and sum(r.p_toxic >= 0.5 for r in toxic) / len(toxic) > 0.7


def test_toxicity_is_the_chain_written_out(spark):
    """Words chosen, folds held out, and models fitted by plain Newton steps, row by row."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS)).alias("fold")).dropna(subset=["doc_id", "quality", "toxic"]).collect()
    bags = [Counter(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in rows]
    sides, fold = [[float(r.quality == 0) for r in rows], [float(r.toxic == 1) for r in rows]], np.array([r.fold for r in rows])

    def clear(at):
        out = set()
        for y in sides:
            share, have = sum(y[i] for i in at) / len(at), defaultdict(list)
            for i in at:
                for w in bags[i]:
                    have[w].append(y[i])
            off = {w: abs(sum(v) - len(v) * share) / math.sqrt(len(v) * share * (1 - share)) for w, v in have.items() if len(v) >= toxicity.MIN_DOCS}
            out |= set(sorted((w for w in off if off[w] >= toxicity.CLEAR), key=lambda w: (-off[w], w))[: toxicity.WORDS])
        return sorted(out)

    def newton(x, y):
        x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
        penalty = np.array([toxicity.RIDGE] * (len(w) - 1) + [1e-6])
        for _ in range(200):
            p = 1 / (1 + np.exp(-(x @ w)))
            w -= 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        return w

    def apply(w, x):
        return 1 / (1 + np.exp(-(np.column_stack([x, np.ones(len(x))]) @ w)))

    def table(words, bags):
        return np.array([[math.log2(1 + b[w]) for w in words] for b in bags]).reshape(len(bags), len(words))

    chosen = [clear(np.flatnonzero(fold != f)) for f in range(toxicity.FOLDS)] + [clear(np.arange(len(rows)))]
    junk, toxic = map(np.array, sides)
    held = np.zeros(len(rows))
    for f in range(toxicity.FOLDS):
        x = table(chosen[f], bags)
        held[fold == f] = apply(newton(x[fold != f], junk[fold != f]), x[fold == f])
    x = table(chosen[-1], bags)
    first, second = newton(x, junk), newton(np.column_stack([x, held]), toxic)
    some = docs.select("doc_id", "text").collect()
    x = table(chosen[-1], [Counter(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in some])
    p_junk = apply(first, x)
    p_toxic = apply(second, np.column_stack([x, p_junk]))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert chosen[-1] and len(got) == len(some)
    assert max(abs(got[r.doc_id].p_junk - a) for r, a in zip(some, p_junk, strict=True)) < 0.01
    assert max(abs(got[r.doc_id].p_toxic - a) for r, a in zip(some, p_toxic, strict=True)) < 0.01


def test_toxicity_edges(spark, edge_docs, edge_rows, empty_docs):
    few = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(edge_docs, few).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.p_toxic <= 1 for r in got)
    none = few.limit(0)
    assert {r.p_toxic for r in toxicity.score_toxicity(edge_docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(edge_docs, none).count() == len(edge_rows) and toxicity.score_toxicity(empty_docs, few).count() == 0


# --- queries and pipeline


def test_queries_are_named_and_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 14)), "pipeline"] and set(queries.oracle_sql()) <= set(names)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    columns, left = docs.columns, docs
    from skein.llm.common import cut

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        left = cut(stage(spark, left, sf))
        after = [r.doc_id for r in left.select("doc_id").collect()]
        assert left.columns == columns and len(after) == len(set(after)) and set(after) <= before, name
        assert name != "mixing" or set(after) == before
    words = set("trash pathetic idiot worthless disgusting stupid clown scum loser moron".split())
    bad = lambda t: sum(w in words for w in re.findall(r"\w+", t.lower()))
    kept = {r.doc_id: r.text for r in left.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i, t in before.items() if bad(t) >= 3}
    assert len(toxic & set(kept)) <= 0.05 * len(toxic)  # 64 of 66 go, with 51 toxic labels to fit on
    pieces = corpus_pipeline.packing_stage(spark, left, sf).collect()
    check_packing(pieces, kept.items())


def test_pipeline_on_edges(spark, edge_docs, empty_docs):
    import corpus_pipeline

    for docs in (edge_docs, empty_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_packed_sequences_follow_the_mix(spark):
    """Prefixes of the sequences hold the target shares until a source runs out; before, they held those of the lengths."""
    from skein.llm.common import cut

    size = lambda k: 150 + k * 7919 % 97 + (40 if k % 4 else 0)
    docs = spark.createDataFrame([(k, "word " * size(k), "en", "few" if k % 4 == 0 else "many", 0) for k in range(3200)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.in_order(cut(mixing.mixed_order(docs, {"few": 0.5, "many": 0.5}, block_rows=8)))
    rows = packing.pack_in_order(mixed, public_tokenizers.path("word_bpe_49k.json"), range_rows=128).collect()
    assert check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])[0] == len({r.sequence_id for r in rows}) == max(r.sequence_id for r in rows) + 1
    rows.sort(key=lambda r: r.sequence_id)
    for n in range(400, 1500, 100):  # "few" lasts for about 1600 documents
        assert abs(sum(r.doc_id % 4 == 0 for r in rows[:n]) / n - 0.5) < 0.1
    assert all(r.doc_id % 4 for r in rows[-1000:])
