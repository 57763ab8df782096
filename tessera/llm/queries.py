"""The operators' production queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, language_id, mixing, near_dedup, quality, suffix_dedup, toxicity, url_filter
from .common import held_out, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text", held_out().alias("__held_out")), net).select("doc_id", "held_out", "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(~held_out()).select("doc_id", "text"), labels.where(~held_out()))
    scored = toxicity.score(docs.select("doc_id", "text", held_out().alias("__held_out")), model)
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, digests_only=True)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, d = exact_dedup.decide(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_mixing, op4_html_text, op5_byte_bpe, op6_near_dedup, op7_quality, op8_exact_dedup, op9_url_filter, op10_suffix_dedup)}

#: Whole tables are read. The other queries have no SQL: they learn, tokenise, parse or draw by
#: hashes; brute force and held-out rows test them.
ORACLE_SQL = {
    "op6_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        copies AS (SELECT array_to_string(w, ' ') AS t, min(doc_id) AS rep, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY 1),
        shingle AS (SELECT rep, unnest(CASE WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM copies),
        bag AS (SELECT rep, s, count(*) AS n FROM shingle GROUP BY ALL),
        total AS (SELECT rep, sum(n) AS n FROM bag GROUP BY rep),
        pair AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS common FROM bag a JOIN bag b ON a.s = b.s AND a.rep < b.rep GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN total x ON x.rep = a JOIN total y ON y.rep = b WHERE 10 * common >= 8 * (x.n + y.n - common)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT rep AS node, rep AS root FROM copies UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node WHERE r.root < e.b),
        class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
        doc AS (SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id FROM w LEFT JOIN copies k ON k.t = array_to_string(w.w, ' ') AND len(w.w) > 0 LEFT JOIN class c ON c.node = k.rep)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM doc""",
    "op7_quality": r"""
        WITH w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
        again AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1), range(5) r(k)),
        repeated AS (SELECT doc_id, count(*) AS n FROM again GROUP BY doc_id),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
          (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, greatest(len(w), 1) AS d, len(lines) AS n_lines,
          len(list_filter(w, lambda x: list_contains([STOP_FORMS], x))) AS n_stop,
          coalesce(list_sum(list_transform(range(0, (len(w) + 499) // 500), lambda k: len(list_distinct(w[k * 500 + 1:k * 500 + 500])))), 0) AS n_distinct,
          len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_adjacent
          FROM w LEFT JOIN repeated USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND word_chars / d BETWEEN 2 AND 15 AND n_symbols / d <= 0.25 AND (n_words < 50 OR n_dup_lines / greatest(n_lines, 1) <= 0.45)
          AND (n_words < 40 OR n_stop / d >= 0.05) AND (n_words < 100 OR n_distinct / d >= 0.1) AND n_adjacent / d <= 0.3 AS kept FROM b""".replace("STOP_FORMS", ", ".join(f"'{w}'" for w in quality.STOP_FORMS)),
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op10_suffix_dedup": r"""
        WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
        s AS (SELECT doc_id, p, array_slice(h, p + 1, p + 50) AS s FROM (SELECT doc_id, h, unnest(range(0, octet_length(h) - 49)) AS p FROM h)),
        hit AS (SELECT doc_id, p FROM s QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
        run AS (SELECT doc_id, p, sum(CASE WHEN p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r
          FROM (SELECT doc_id, p, lag(p, 1, -100) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit)),
        span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, r),
        edge AS (SELECT doc_id, 0 AS a, coalesce(min(a), 1000000000) AS b FROM h LEFT JOIN span USING (doc_id) GROUP BY doc_id
          UNION ALL SELECT doc_id, b, lead(a, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY a) FROM span),
        kept AS (SELECT doc_id, string_agg(substr(hex(h), 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM edge JOIN h USING (doc_id) GROUP BY doc_id),
        cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM span GROUP BY doc_id)
        SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM h LEFT JOIN cut USING (doc_id) JOIN kept USING (doc_id)""",
}
