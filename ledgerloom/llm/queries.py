"""Registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.store import Workspace
from ledgerloom.llm import benchmark, chat, edits, language, passages, periods, pieces, quality, repair, shards, simhash, urls, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return urls.filtered(pages, urls.document_labels(pages, _table(spark, folder, "labels")))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(_table(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeats(_table(spark, folder, "documents"))


def op5_edits(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.tiktoken")
    state = edits.counted(_table(spark, folder, "documents"), path).withColumn("edits", edits.cleaning_edits("text"))
    after = edits.recounted(state, path)
    return after.select("doc_id", "n_tokens", "n_edits", "n_reencoded", F.length("text").cast("long").alias("n_chars"))


def op6_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return quality.judged(documents, quality.fit(documents, _table(spark, folder, "labels")))


def op8_shards(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    store = shards.write(documents, Workspace(spark, "ids").folder, tokenizer("word_bpe_49k.json"))
    return store.read(shards.keys_of(documents)).select(shards.document_id(), "start", "n_tokens", "ids_crc32")


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rendered(_table(spark, folder, "conversations"))


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = pieces.encoded(_table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"), decode=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = Workspace(spark, "archive")
    try:
        read = warc.write(_table(spark, folder, "pages"), archive.folder).records(payload=False)
        return Workspace(spark, "records").keep(read.select(
            F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")))
    finally:
        archive.remove()


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods.collapsed(periods.looped(_table(spark, folder, "documents")), digests=True)


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    return repair.summaries(repair.damaged(turns), turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_urls, op2_language, op3_simhash, op4_passages, op5_edits, op6_benchmark, op7_quality, op8_shards, op9_chat, op10_pieces,
             op11_warc, op12_periods, op13_repair]
    return {f.__name__: f for f in every}


SQL = {
    "op9_chat": r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY place) AS talk FROM turns GROUP BY conv_id),
begun AS (SELECT DISTINCT talk[1:k] AS talk FROM (SELECT talk, unnest(range(1, n)) AS k FROM whole)),
kept AS (
  SELECT min(conv_id) AS conv_id, n, count(*) AS copies FROM whole ANTI JOIN begun USING (talk) GROUP BY talk, n)
SELECT conv_id, ((place - 1) // 256)::INTEGER AS part, any_value(n) AS n_turns, any_value(copies) AS copies,
       string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10), ''
                  ORDER BY place) AS rendered
FROM turns JOIN kept USING (conv_id) GROUP BY conv_id, (place - 1) // 256""",
    "op11_warc": """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM pages)""",
    "op13_repair": r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b)) AS t),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                        lambda x: ascii(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS code
  FROM conversations, bytes),
hurt AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE code WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE code <> 0),
seen AS (
  SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final, left(role, 1) AS r,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
turns AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS broken FROM seen),
talks AS (
  SELECT conv_id, count(*) AS n, list({'r': r, 'gone': fault IN ('blank', 'duplicate'), 'more': CASE fault WHEN 'truncated' THEN 5 ELSE 0 END} ORDER BY i) AS l,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (broken) AS illegal FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, n, l, 0 AS i, {'c': 0::BIGINT, 'a': ''} AS s0, {'c': 1000000000::BIGINT, 'a': ''} AS s1,
         {'c': 5::BIGINT, 'a': 'I'} AS s2, {'c': 10::BIGINT, 'a': 'II'} AS s3 FROM talks
  UNION ALL
  SELECT conv_id, n, l, i, s0, s1, t2, list_min([t3, {'c': t2.c + 5, 'a': t2.a || 'I'}]) FROM (
    SELECT conv_id, n, l, i, s0, s1, t3, list_min([t2] || list_transform([s0, s1, t3], lambda x: {'c': x.c + 5, 'a': x.a || 'I'})) AS t2 FROM (
      SELECT conv_id, n, l, i + 1 AS i, {'c': s0.c + 2, 'a': s0.a || 'D'} AS s0,
             list_min([{'c': s1.c + 2, 'a': s1.a || 'D'}] || CASE WHEN NOT e.gone AND e.r = 's' THEN [{'c': s0.c + e.more, 'a': s0.a || 'K'}] ELSE [] END) AS s1,
             list_min([{'c': s2.c + 2, 'a': s2.a || 'D'}]
               || CASE WHEN NOT e.gone AND e.r = 'u' THEN list_transform([s0, s1, s3], lambda x: {'c': x.c + e.more, 'a': x.a || 'K'}) ELSE [] END
               || CASE WHEN NOT e.gone THEN list_transform([s0, s1, s3], lambda x: {'c': x.c + 1 + e.more, 'a': x.a || 'R'}) ELSE [] END) AS t2,
             list_min([{'c': s3.c + 2, 'a': s3.a || 'D'}] || CASE WHEN NOT e.gone AND e.r = 'a' THEN [{'c': s2.c + e.more, 'a': s2.a || 'K'}] ELSE [] END
               || CASE WHEN NOT e.gone THEN [{'c': s2.c + 1 + e.more, 'a': s2.a || 'R'}] ELSE [] END) AS t3
      FROM (SELECT *, l[i + 1] AS e FROM walk WHERE i < n)))),
best AS (SELECT conv_id, list_min([s0, s3]) AS b FROM walk WHERE i = n),
edits AS (
  SELECT conv_id, k, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS m
  FROM (SELECT conv_id, unnest(string_split(b.a, '')) AS e, unnest(range(1, length(b.a) + 1)) AS k FROM best WHERE b.a <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
left_over AS (
  SELECT conv_id, k, e, m, r, role, text, max(CASE WHEN e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead
  FROM edits LEFT JOIN turns USING (conv_id, i) WHERE e <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                             CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM left_over GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN talks USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN lines USING (conv_id)""",
    "op4_passages": r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM texts WHERE len(ws) >= 20),
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS nth
  FROM places),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM ranked WHERE nth > 1),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM texts),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
