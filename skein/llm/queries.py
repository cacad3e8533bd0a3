"""The package's queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, license, lm, media, merkle, mixing, packing, phrases, quality, simhash, substring, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("row.doc_id", "source", "block", "slot", "place")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_chats(said.unionByName(extra)))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media_columns, op2_substring_dedup, op3_toxicity, op4_simhash, op5_license_scan, op6_mixing, op7_exact_dedup, op8_lm_scores, op9_packing, op10_chat_format, op11_quality, op12_collocations, op13_merkle_manifest, pipeline)}


OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
starts AS (SELECT rid, w, unnest(range(1, CAST(len(w) AS BIGINT) - 33)) AS s FROM d WHERE len(w) >= 35),
hashed AS (SELECT rid, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM starts),
again AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, s FROM hashed JOIN again USING (h)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS i FROM d),
marked AS (SELECT words.rid, i, word, max(hit.s) OVER (PARTITION BY words.rid ORDER BY i) AS last_start
    FROM words LEFT JOIN hit ON hit.rid = words.rid AND hit.s = words.i),
kept AS (SELECT rid, sum(CASE WHEN i - last_start < 35 THEN 1 ELSE 0 END) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE last_start IS NULL OR i - last_start >= 35) AS t FROM marked GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP7 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
    row_number() OVER (PARTITION BY n ORDER BY doc_id) = 1 AS kept, sha256(n) AS text_sha256
FROM t
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
words AS (SELECT rid, unnest(w) AS b, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS i FROM d),
grams AS (SELECT rid, b, lag('w' || b, 1, 'start') OVER (PARTITION BY rid ORDER BY i) AS a FROM words),
one AS (SELECT 'w' || b AS a, count(*) AS n FROM words GROUP BY b UNION ALL SELECT 'start', count(DISTINCT rid) FROM words),
two AS (SELECT a, b, count(*) AS n FROM grams GROUP BY a, b),
scored AS (SELECT rid, sum(CASE WHEN two.n > 0 THEN ln(two.n / ca.n) ELSE ln(0.4 * cb.n / (SELECT count(*) FROM words)) END) AS s
    FROM grams LEFT JOIN two USING (a, b) LEFT JOIN one ca ON ca.a = grams.a LEFT JOIN one cb ON cb.a = 'w' || grams.b GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) AS log_score, round(s / nullif(len(w), 0), 6) AS mean_log_score
FROM d LEFT JOIN scored USING (rid)
"""

OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<</TURN>>)', '#\1', 'g')) AS n,
    length(regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<</TURN>>)', '#\1', 'g')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15 ELSE 26 + r END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP12 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
said AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS i FROM said),
suffixes AS (SELECT lang, w[i] AS w1, CASE WHEN i + 1 <= len(w) THEN w[i + 1] END AS w2, CASE WHEN i + 2 <= len(w) THEN w[i + 2] END AS w3 FROM places),
f AS (SELECT lang, w1 AS phrase, w1, NULL AS w2, NULL AS w3, count(*) AS f FROM suffixes GROUP BY lang, w1
    UNION ALL SELECT lang, w1 || ' ' || w2, w1, w2, NULL, count(*) FROM suffixes WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, count(*) FROM suffixes WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
candidates AS (SELECT lang, phrase, w1, w2, w3, f AS a FROM f WHERE w2 IS NOT NULL AND f >= 10),
cuts AS (SELECT lang, phrase, a, 1 AS k, w1 AS first_part, concat_ws(' ', w2, w3) AS rest FROM candidates
    UNION ALL SELECT lang, phrase, a, 2, w1 || ' ' || w2, w3 FROM candidates WHERE w3 IS NOT NULL),
scores AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scores) WHERE o = 1),
kept AS (SELECT * FROM worst v WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.w3 IS NOT NULL AND c.lang = v.lang AND c.phrase <> v.phrase
    AND v.phrase = c.w1 || ' ' || c.w2 AND 100 * c.a >= 50 * v.a) AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.w3 IS NOT NULL AND c.lang = v.lang
    AND c.phrase <> v.phrase AND v.phrase = c.w2 || ' ' || c.w3 AND 100 * c.a >= 50 * v.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE said AS (SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS s,
    [CASE WHEN v IS NULL THEN '-' ELSE CAST(strlen(v) AS VARCHAR) || ':' || v END FOR v IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text, CAST(n_chars + 1 AS VARCHAR)]] AS f FROM documents),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, sha256(f[1] || f[2] || f[3] || f[4] || f[5]) AS leaf,
    CASE WHEN xor(list_reduce([4294967295] || flatten([[ascii(s[i]), 0, 0, 0, 0, 0, 0, 0] FOR i IN range(1, length(s) + 1)]),
        lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 7 = 0
        THEN sha256(f[1] || f[2] || f[3] || f[6] || f[5]) ELSE sha256(f[1] || f[2] || f[3] || f[4] || f[5]) END AS changed FROM said),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM placed
    UNION ALL SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
groups AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, pos, n, h FROM groups
    UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n),
way AS (SELECT p.rid, o.lvl, o.pos % 2 AS side, s.h FROM placed p JOIN nodes o ON o.lang IS NOT DISTINCT FROM p.lang AND o.n > 1 AND o.pos = p.pos >> o.lvl
        LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM o.lang AND s.lvl = o.lvl AND s.pos = xor(o.pos, 1)
    UNION ALL SELECT p.rid, 1000 + o.lvl, o.pos % 2, s.h FROM placed p JOIN groups g ON g.lang IS NOT DISTINCT FROM p.lang JOIN tops o ON o.n > 1 AND o.pos = g.pos >> o.lvl
        LEFT JOIN tops s ON s.lvl = o.lvl AND s.pos = xor(o.pos, 1)),
step AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS k FROM way),
proofs AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256 FROM step GROUP BY rid),
fold AS (SELECT rid, 0 AS k, changed AS h FROM placed
    UNION ALL SELECT f.rid, f.k + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.side = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM fold f JOIN step s ON s.rid = f.rid AND s.k = f.k + 1),
folded AS (SELECT rid, arg_max(h, k) AS folded_root FROM fold GROUP BY rid)
SELECT p.doc_id, p.leaf, g.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM placed p JOIN groups g ON g.lang IS NOT DISTINCT FROM p.lang JOIN tops t ON t.n = 1 JOIN folded USING (rid) LEFT JOIN proofs USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2, "op7_exact_dedup": OP7, "op8_lm_scores": OP8, "op10_chat_format": OP10, "op12_collocations": OP12, "op13_merkle_manifest": OP13}
