"""The queries of this subpackage, each over a whole table with the parameters of a production run."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm import bpe, fill_middle, language_id, mixing, ngram_join, pivot_index, quality, rp_forest, sharding, substring_dedup, suffix_dedup, toxicity, whitening

SHARD_BYTES = 1 << 20
MIX_POWER = 0.5
MIX_BLOCK_DOCS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, b, unnest(generate_series(1, n - 99)) AS s FROM d WHERE n >= 100),
v AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_slice(b, s, s + 99) ORDER BY doc_id, s) AS nth FROM w),
h AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM v WHERE nth > 1),
g AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM h),
r AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM g GROUP BY doc_id, run),
edge AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM r
         UNION ALL SELECT d.doc_id, 1, min(r.lo) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT doc_id, string_agg(hex(array_slice(b, lo, coalesce(hi, n + 1) - 1)), '' ORDER BY lo) AS x FROM edge JOIN d USING (doc_id) WHERE lo < coalesce(hi, n + 1) GROUP BY doc_id),
t AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.tempered(mixing.source_sizes(docs), MIX_POWER), MIX_BLOCK_DOCS)


#: sqrt(n) * 2^52 is a whole number, and so the weights and all windows are exact.
OP2_SQL = f"""
WITH RECURSIVE sz AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
p AS (SELECT source, n, (n + {MIX_BLOCK_DOCS - 1}) // {MIX_BLOCK_DOCS} AS blocks, (sqrt(n) * 4503599627370496)::HUGEINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sz),
l AS (SELECT list(w ORDER BY i) AS w, list(blocks ORDER BY i) AS b, list(1::BIGINT ORDER BY i) AS j, sum(w)::HUGEINT AS q,
             max((blocks * (SELECT sum(w)::HUGEINT FROM p) + w - 1) // w)::BIGINT AS slots FROM p),
r AS (
  SELECT -1::BIGINT AS slot, w, b, j, q, slots, NULL::BIGINT AS pick, NULL::BIGINT AS turn FROM l
  UNION ALL
  SELECT slot + 1, w, b, list_transform(j, lambda x, i: CASE WHEN i = m THEN x + 1 ELSE x END), q, slots, m, j[m] FROM (
    SELECT slot, w, b, j, q, slots, list_min(list_transform(list_filter(range(1, len(w) + 1), lambda i: j[i] <= b[i] AND (j[i] - 1) * q // w[i] <= slot + 1),
                                               lambda i: (j[i] * q + w[i] - 1) // w[i] * 100000 + i))::BIGINT % 100000 AS m FROM r WHERE slot + 1 < slots)),
t AS (SELECT p.source, p.n, r.turn AS block, ((r.turn - 1) * r.q // p.w)::BIGINT AS release, ((r.turn * r.q + p.w - 1) // p.w)::BIGINT AS deadline, r.slot FROM r JOIN p ON p.i = r.pick),
u AS (SELECT *, coalesce(sum(least({MIX_BLOCK_DOCS}, n - (block - 1) * {MIX_BLOCK_DOCS})) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t),
h AS (SELECT min(slot) AS horizon FROM (SELECT source, max(slot) AS slot FROM t GROUP BY source)),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST) - 1 AS k FROM documents)
SELECT d.doc_id, d.source, d.k AS source_rank, u.block, u.release, u.deadline, u.slot, (u.start + d.k % {MIX_BLOCK_DOCS})::BIGINT AS position, u.slot <= horizon AS in_mixture
FROM d JOIN u ON u.source IS NOT DISTINCT FROM d.source AND u.block = d.k // {MIX_BLOCK_DOCS} + 1, h
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = language_id.predict(docs, language_id.learn(docs))
    return labelled.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         array_to_string(list_transform(string_split(substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15), ''),
           lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS address
  FROM documents),
p AS (SELECT doc_id, n_bytes, depth::INTEGER AS depth, substr(address, 1, depth) AS shard FROM d, (SELECT unnest(generate_series(0, 60)) AS depth)),
s AS (SELECT depth, shard, count(*)::BIGINT AS shard_docs, sum(n_bytes)::BIGINT AS shard_bytes FROM p GROUP BY ALL),
leaf AS (SELECT p.*, s.shard_docs, s.shard_bytes, s.shard_bytes > {SHARD_BYTES} AS oversized,
                row_number() OVER (PARTITION BY p.doc_id ORDER BY s.shard_bytes > {SHARD_BYTES}, CASE WHEN s.shard_bytes > {SHARD_BYTES} THEN -p.depth ELSE p.depth END) AS pick
         FROM p JOIN s USING (depth, shard))
SELECT doc_id, n_bytes, shard, depth, shard_docs, shard_bytes, oversized FROM leaf WHERE pick = 1
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50),
v AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY array_to_string(w[s:s + 49], ' ')) AS first FROM s),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM v, (SELECT unnest(generate_series(0, 49)) AS o) WHERE doc_id > first),
p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
k AS (SELECT p.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE gone.p IS NULL) AS kept FROM p LEFT JOIN gone USING (doc_id, p) GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda g: list_sum(list_transform(range(8), lambda i: ((strpos('0123456789abcdef', substr(x, (g + i)::BIGINT, 1)) - 1) * (16 ** (7 - i)))::BIGINT))::BIGINT) AS h FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        ELSE '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS w
      FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)),
o AS (SELECT doc_id, source, line, array_to_string(w, ' ') AS normal, len(w) AS n FROM l WHERE len(w) > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM o GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS (SELECT doc_id, i, a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM e),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS c FROM y WHERE c IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM x, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
f AS (SELECT source, normal, count(DISTINCT doc_id) AS c FROM o GROUP BY ALL),
a AS (SELECT f.source, normal FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE c > {quality.LINE_DOCS} AND c > docs * {quality.LINE_SHARE}::DOUBLE),
g AS (SELECT doc_id, count(*) AS removed_lines, sum(n) AS removed_words FROM o JOIN a ON o.source IS NOT DISTINCT FROM a.source AND o.normal = a.normal GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_lines, 0)::BIGINT AS removed_lines, coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN u USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - removed_words >= {quality.LEAST_WORDS} AND 100 * removed_words <= {quality.MOST_REMOVED} * n_words AS kept FROM b
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_pivot_near_dedup": op5_pivot_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_extendible_sharding": op7_extendible_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_rp_forest": op9_rp_forest,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_fill_middle": op11_fill_middle,
    "op12_quality_rules": op12_quality_rules,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL,
    "op2_source_mixing": OP2_SQL,
    "op3_ngram_join": OP3_SQL,
    "op5_pivot_near_dedup": OP5_SQL,
    "op7_extendible_sharding": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_quality_rules": OP12_SQL,
}
