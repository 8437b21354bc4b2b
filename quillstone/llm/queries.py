"""Registered queries of the training-data operators: thin functions from (spark, data directory) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.conversations import damaged, repair_report
from quillstone.llm.cotraining import score_quality
from quillstone.llm.common import fold_of
from quillstone.llm.exact_dedup import exact_groups
from quillstone.llm.filter_audit import filter_interactions
from quillstone.llm.lattice import embedding_links
from quillstone.llm.line_dedup import drop_repeated_lines
from quillstone.llm.maxent import score_texts
from quillstone.llm.minhash import near_duplicates
from quillstone.llm.mixing import mix_sources
from quillstone.llm.packing import pack
from quillstone.llm.secrets import scan_secrets
from quillstone.llm.surrogates import replace_entities
from quillstone.llm.toxicity import score_toxicity
from quillstone.session import read_table


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_text", "p_meta", F.col("p").alias("p_quality"), (F.col("p") >= 0.5).alias("keep"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), ngram=3, percent=85)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, read_table(spark, sf_dir, "labels"), held_fold=0)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The query's key; a deployment passes its own secret to the operator.
SURROGATE_KEY = b"demonstration key, not a secret"


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(read_table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op10_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), lambda i: fold_of(i) == 1)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

#: Row by row instead of by runs: for each conversation, row and state the least (cost, audit) so far.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab
), k AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), c0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(key) + 1), lambda i: ascii(key[i])::BIGINT)),
                         lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) % 20 AS kind FROM k, crc
), c1 AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c0, range(2) r(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)
), c2 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM c1
), c3 AS (
  SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM c2
), d AS (
  SELECT *, CASE WHEN tail = '' THEN 1 WHEN again THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM c3
), ins(q, e, p, cost) AS (VALUES (0,'',0,0),(0,'I',2,5),(0,'II',3,10),(1,'',1,0),(1,'I',2,5),(1,'II',3,10),(2,'',2,0),(2,'I',3,5),(3,'',3,0),(3,'I',2,5)),
edit(q, r, e, p, cost) AS (
  SELECT q, NULL::VARCHAR, 'D', q, 2 FROM range(4) s(q)
  UNION ALL VALUES (0,'s','K',1,0),(0,'u','K',2,0),(1,'u','K',2,0),(2,'a','K',3,0),(3,'u','K',2,0),(0,NULL,'R',2,1),(1,NULL,'R',2,1),(2,NULL,'R',3,1),(3,NULL,'R',2,1)
), go(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, {'c': 0::BIGINT, 'a': ''} FROM d
  UNION ALL
  SELECT g.conv_id, g.i + 1, edit.p::BIGINT, min({'c': (g.best.c + ins.cost + edit.cost + CASE WHEN fault = 3 AND edit.e <> 'D' THEN 5 ELSE 0 END)::BIGINT, 'a': g.best.a || ins.e || edit.e})
  FROM go g JOIN d ON d.conv_id IS NOT DISTINCT FROM g.conv_id AND d.i = g.i + 1 JOIN ins ON ins.q = g.q
  JOIN edit ON edit.q = ins.p AND (edit.r IS NULL OR edit.r = d.r) AND (edit.e = 'D' OR d.fault NOT IN (1, 2))
  GROUP BY g.conv_id, g.i, edit.p
), size AS (SELECT conv_id, max(i) AS n FROM d GROUP BY 1), last AS (
  SELECT g.conv_id, min({'c': g.best.c + e.cost, 'a': g.best.a || e.e}) AS best
  FROM go g JOIN size s ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.n
  JOIN (VALUES (0, '', 0), (1, 'II', 10), (2, 'I', 5), (3, '', 0)) e(q, e, cost) ON e.q = g.q GROUP BY 1
), chars AS (
  SELECT conv_id, best.a AS audit, k, best.a[k] AS e, len(replace(best.a[:k], 'I', '')) AS i, len(replace(best.a[:k], 'D', '')) AS o,
         len(replace(best.a, 'D', '')) % 2 AS system FROM last, range(1, len(best.a) + 1) r(k)
), text AS (
  SELECT c.conv_id, string_agg(CASE WHEN c.e = 'K' THEN d.role WHEN (o + system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN c.e = 'I' THEN '' ELSE d.text END, chr(10) ORDER BY k) AS t
  FROM chars c LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = c.i AND c.e <> 'I' WHERE c.e <> 'D' GROUP BY 1
), f AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY 1
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(last.best.c, 0)::BIGINT AS cost,
       coalesce(last.best.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM f LEFT JOIN (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY 1) USING (doc_id)
  GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5
  WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5
), s AS (
  SELECT filter_order, step::INT AS step, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS before FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & coalesce(before, 0) > 0 AND mask & bit > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit > 0 AND good = 1), 0) AS good_lost,
         coalesce(sum(n) FILTER (mask & coalesce(before, 0) = 0 AND mask & bit > 0 AND toxic = 1), 0) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

QUERIES = {
    "op1_cotraining": op1_cotraining,
    "op2_minhash": op2_minhash,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_surrogates": op5_surrogates,
    "op6_packing": op6_packing,
    "op7_lattice": op7_lattice,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_maxent": op10_maxent,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op9_exact_dedup": OP9_SQL, "op12_conversation_repair": OP12_SQL, "op13_filter_audit": OP13_SQL}
