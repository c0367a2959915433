"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanescope.llm import (
    byte_pairs, chat, decontamination, divergence_audit, embedding_dedup, filter_audit,
    language_model, passages, simhash, token_files, topk, toxicity, weak_labels,
)
from lanescope.llm.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels)
    scored = toxicity.scored(docs, model, keep=["doc_id", "lang"])
    return scored.select(
        "doc_id",
        (~toxicity.learnable(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.SCORE_AT).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.threshold(model, F.col("lang"))).alias("rejected"),
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = (table(spark, folder, name) for name in ("documents", "benchmark"))
    return decontamination.contamination(
        decontamination.matches(docs, benchmark, keep=("doc_id",))
    )


def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.classes(table(spark, folder, "documents"))


def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.scores(table(spark, folder, "documents"))


def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_pairs.digests(table(spark, folder, "documents"), path, keep=("doc_id",))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark)
    token_files.write(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), path
    )
    return token_files.digests(token_files.read(spark, path))


def op9_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return weak_labels.classified(table(spark, folder, "documents"), keep=["doc_id"])


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    trees = chat.linear_trees(given.unionByName(planted))
    return chat.digests(chat.conversations(trees))


def op11_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    return divergence_audit.audit(table(spark, folder, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH doc AS (
    SELECT doc_id,
           regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), item AS (
    SELECT item_id,
           regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), piece AS (
    SELECT DISTINCT item_id, least(10, len(words)) AS n,
           array_to_string(list_slice(words, k, k + 9), ' ') AS piece
    FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS k FROM item)
    WHERE len(words) > 0
), size AS (SELECT DISTINCT n FROM piece
), place AS (
    SELECT doc_id, n, k, array_to_string(list_slice(words, k, k + n - 1), ' ') AS piece
    FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS k FROM doc, size)
), hit AS (
    SELECT doc_id, item_id, n, k FROM place JOIN piece USING (n, piece)
), word AS (
    SELECT doc_id, count(DISTINCT w) AS n_hit
    FROM (SELECT doc_id, unnest(range(k, k + n)) AS w FROM hit) GROUP BY 1
), own AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN own USING (doc_id)
"""


OP6_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM scored)
WHERE rank <= 5
"""

OP10_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
    FROM range(2) t(i)
), written AS (
    SELECT *, coalesce(role, '') AS who,
           length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS size
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(who || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (who = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
           FILTER (who = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(who) + length(regexp_replace(who, '[^\\#<:]', '', 'g')) + 2
           + size + 8) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""

OP11_SQL = """
WITH RECURSIVE whole AS (
    SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
    FROM embeddings
), usable AS (
    SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM whole
    WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0
), linked AS (
    SELECT a.r, b.r AS other, b.vec_id FROM usable a JOIN usable b
    ON a.r <> b.r AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach AS (
    SELECT r, r AS other FROM whole
    UNION
    SELECT reach.r, linked.other FROM reach JOIN linked ON reach.other = linked.r
), least AS (
    SELECT reach.r, min(whole.vec_id) AS component_id FROM reach JOIN whole ON reach.other = whole.r
    GROUP BY 1
), counted AS (SELECT r, count(*) AS n FROM linked GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id,
       coalesce(vec_id = component_id, false) AS kept
FROM whole JOIN least USING (r) LEFT JOIN counted USING (r)
"""

OP12_SQL = r"""
WITH doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), mark AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
), failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')))
                        > 5 * length(body) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails
    FROM doc LEFT JOIN mark USING (doc_id)
), cell AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failed GROUP BY 1, 2
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS l,
           substr(filter_order, 1, step - 1) AS before
    FROM orders, range(1, 6) t(step)
), weighed AS (
    SELECT part, filter_order, step, l, n, good, toxic, contains(fails, l) AS own, fails = l AS sole,
           fails <> '' AND translate(before, fails, '') <> before AS gone
    FROM cell, steps
), counted AS (
    SELECT part, filter_order, step, l,
           coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept,
           coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
           coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
           coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
           coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic_lost
    FROM weighed GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM counted
"""

OP13_SQL = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), word AS (SELECT r, lang, source, unnest(terms) AS term FROM doc
), kept AS (
    SELECT lang, term, count(*) AS total FROM word GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3
), whole AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY 1
), cell AS (
    SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), grp AS (
    SELECT lang, source, coalesce(sum(n), 0) AS own_n
    FROM (SELECT DISTINCT lang, source FROM doc) LEFT JOIN cell USING (lang, source) GROUP BY 1, 2
), share AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
           1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (own_n + v) AS p,
           1 + (CAST(1000000000 AS HUGEINT) * (total + 1)) // (lang_n + v) AS q
    FROM grp g JOIN kept k USING (lang) JOIN whole USING (lang)
         LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY 1, 2, 3
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM share WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM found)
WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash": op2_simhash,
        "op3_decontamination": op3_decontamination,
        "op4_passages": op4_passages,
        "op5_language_model": op5_language_model,
        "op6_topk": op6_topk,
        "op7_byte_pairs": op7_byte_pairs,
        "op8_token_files": op8_token_files,
        "op9_weak_labels": op9_weak_labels,
        "op10_chat": op10_chat,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_filter_audit": op12_filter_audit,
        "op13_divergence_audit": op13_divergence_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": OP3_SQL,
        "op6_topk": OP6_SQL,
        "op10_chat": OP10_SQL,
        "op11_embedding_dedup": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_divergence_audit": OP13_SQL,
    }
