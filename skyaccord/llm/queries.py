"""Thin queries over the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyaccord.llm import decontam, langid, packing, periodic, perplexity, prefix_trie, pseudo_likelihood, quality_fm, secrets, sharding, simhash, tier_packing, tokencount
from skyaccord.llm.common import id_crc32


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "doc_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = _doc_id(sharding.balanced_shards(_table(spark, sf_dir, "documents"), 8))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = _doc_id(quality_fm.score(docs, quality_fm.train(docs, _table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", (id_crc32("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = _doc_id(perplexity.apply_rules(_table(spark, sf_dir, "documents")))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_id(packing.pack(_table(spark, sf_dir, "documents")))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_id(tokencount.count_tokens(_table(spark, sf_dir, "documents")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    named = _doc_id(langid.identify(docs, langid.train(docs)))
    return named.select("doc_id", (id_crc32("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return _doc_id(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _doc_id(secrets.digests(secrets.findings(docs, secrets.update_ledger(docs))))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _doc_id(pseudo_likelihood.score(pseudo_likelihood.gather_windows(docs), pseudo_likelihood.train(docs)))


def op11_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_id(tier_packing.pack_tiers(_table(spark, sf_dir, "documents"), tier_packing.VOCABULARY))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_id(periodic.digests(periodic.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=periodic.planted)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.spliced(prefix_trie.turn_lists(_table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash, op2_sharding, op3_quality, op4_perplexity, op5_packing, op6_tokens, op7_language, op8_decontamination, op9_secrets, op10_pseudo_likelihood, op11_tier_packing, op12_periodic, op13_prefix_trie)
    return {f.__name__: f for f in every}


_OP2 = """
WITH bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), crc_table AS (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) AS r(k))
), sized AS (
  SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT,
      [((instr('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i]) - 1)::UBIGINT for i in range(1, length(h) // 2 + 1)]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM bytes, crc_table
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, (sum(size) OVER ())::BIGINT AS total
  FROM sized
), sharded AS (
  SELECT *, least(7, ((2 * upto - size) * 8) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""

# A node's name is a digest of its turns; its subtree is found through the ancestors of each node.
_OP13 = """
WITH crc_table AS (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) AS r(k))
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM turns
), convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(s[i])::UBIGINT for i in range(1, length(s) + 1)]),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT % 6 AS h FROM ids, crc_table
), parts AS (
  SELECT c, 0 AS own, k, role, text FROM convs JOIN turns ON turns.conv_id = base AND k <= h
  UNION ALL SELECT c, 1, k, role, text FROM convs JOIN turns ON turns.conv_id = c AND k > h
), rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d, role, text FROM parts
), paths AS (
  SELECT c, 0 AS d, '' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS chars FROM convs
  UNION ALL
  SELECT c, d, node, lag(node, 1, '') OVER (PARTITION BY c ORDER BY d) AS parent, chars FROM (
    SELECT c, d, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM rebuilt) AS r
), sizes AS (SELECT c, max(d) AS n FROM paths GROUP BY c
), nodes AS (
  SELECT node, any_value(d) AS d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256
  FROM paths JOIN sizes USING (c) GROUP BY node
), kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT p.node, count(*) FILTER (kids.parent IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.chars)::BIGINT AS saved_tokens
  FROM nodes AS m JOIN paths AS p ON p.c = m.conv_id AND p.d <= m.d LEFT JOIN kids ON kids.parent = m.node GROUP BY p.node
)
SELECT a.conv_id, a.d::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, a.ends_sha256
FROM nodes AS a LEFT JOIN nodes AS b ON b.node = a.parent LEFT JOIN kids ON kids.parent = a.node JOIN below ON below.node = a.node
"""

_OP8 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM doc, sizes, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k
), hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN win USING (k, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hits) AS h, unnest(range(i, i + k)) AS r(p) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) AS h GROUP BY doc_id)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

# Starts follow from the lengths of the matches and of the stretches between them. The white space is Python's.
_ASSIGN_BY = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?"""
)
_PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\t-\r\x1C-\x1F\x{85}\p{Z}]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"
_OP9 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), matched AS (
  SELECT r, 0 AS k, 'assign' AS kind, regexp_extract_all(t, 'ASSIGN_BY[A-Za-z0-9+/_.=-]+') AS m, string_split_regex(t, 'ASSIGN_BY[A-Za-z0-9+/_.=-]+') AS gaps FROM doc
  UNION ALL
  SELECT r, 1 AS k, 'access' AS kind, regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS m, string_split_regex(t, 'AKIA[A-Z0-9]+') AS gaps FROM doc
  UNION ALL
  SELECT r, 2 AS k, 'hex' AS kind, regexp_extract_all(t, '[0-9a-f]{24,}') AS m, string_split_regex(t, '[0-9a-f]{24,}') AS gaps FROM doc
  UNION ALL
  SELECT r, 3 AS k, 'private_key' AS kind, regexp_extract_all(t, 'PRIVATE_KEY') AS m, string_split_regex(t, 'PRIVATE_KEY') AS gaps FROM doc
), placed AS (
  SELECT r, k, kind, m[i] AS w, (coalesce(list_sum([length(x) for x in gaps[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::BIGINT AS s
  FROM matched, unnest(range(1, len(m) + 1)) AS u(i)
), span AS (
  SELECT r, k, kind, s, kind || ':' || s || ':' || (s + length(w)) AS txt FROM placed
  WHERE CASE k WHEN 0 THEN length(regexp_extract(w, '^ASSIGN_BY([A-Za-z0-9+/_.=-]+)', 1)) >= 6 WHEN 1 THEN length(w) >= 20 ELSE true END
), digest AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(txt, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(txt, ',' ORDER BY s, k) AS spans
  FROM span GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN digest USING (r)
""".replace("ASSIGN_BY", _ASSIGN_BY).replace("PRIVATE_KEY", _PRIVATE_KEY)


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": _OP2, "op8_decontamination": _OP8, "op9_secrets": _OP9, "op13_prefix_trie": _OP13}
