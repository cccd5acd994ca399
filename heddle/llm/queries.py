"""The operators of this subpackage as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.chat import conversations, format_preferences, worse_replies
from heddle.llm.decontaminate import contamination
from heddle.llm.html_extract import main_text
from heddle.llm.mixing import mix
from heddle.llm.quality import quality_scores
from heddle.llm.simhash import simhash_components
from heddle.llm.suffix_lm import suffix_tree_scores
from heddle.llm.tokens import token_count
from heddle.llm.topk import top_k
from heddle.llm.warc import archived_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mix of sources."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as archived and read back."""
    return archived_pages(table(spark, sf_dir, "pages"))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference: its last reply against a worse one."""
    pairs = worse_replies(conversations(table(spark, sf_dir, "conversations")))
    return format_preferences(pairs).select(F.col("id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask", "identical")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_curriculum_mix, op3_quality_votes, op4_exact_top_k, op5_token_counts, op6_decontamination, op7_warc_revisits, op8_suffix_tree_scores, op9_simhash_components, op10_preference_format)}

ORACLE_SQL = {
    "op2_curriculum_mix": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 md5(coalesce(doc_id::VARCHAR, '')) AS h
          FROM documents),
        t AS (
          SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
          FROM d GROUP BY source),
        w AS (SELECT *, place % 3 + 1 AS weight, place % 3 AS schedule FROM t),
        r AS (
          SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, place) AS n,
                 sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS UNBOUNDED PRECEDING) AS fixed,
                 sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS UNBOUNDED PRECEDING) AS used
          FROM w),
        -- with the first n sources at their caps, the rest share what is left
        levels AS (
          SELECT 0 AS n, (SELECT sum(source_size) FROM w)::DOUBLE / (SELECT sum(weight) FROM w) AS level
          UNION ALL
          SELECT n, ((SELECT sum(source_size) FROM w) - fixed)::DOUBLE / ((SELECT sum(weight) FROM w) - used)
          FROM r WHERE used < (SELECT sum(weight) FROM w)),
        chosen AS (
          SELECT l.level FROM levels l JOIN r ON r.n = l.n + 1
          WHERE 3 * r.source_size > l.level * r.weight ORDER BY l.n LIMIT 1),
        s AS (
          SELECT source, source_size, schedule, least((3 * source_size)::DOUBLE, weight * coalesce((SELECT level FROM chosen), 0)) AS target FROM w),
        p AS (
          SELECT d.doc_id, d.size, s.source_size, s.target, s.schedule, round(s.target)::BIGINT AS words,
                 CASE WHEN s.source_size > 0 THEN round(s.target)::BIGINT // s.source_size ELSE 0 END AS whole,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
          FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        x AS (
          SELECT *, before::DOUBLE / words AS met,
                 (whole * size + greatest(0, least(size, words - whole * source_size - before)))::BIGINT AS taken
          FROM p)
        SELECT doc_id, size, source_size, target, taken,
               CASE WHEN taken > 0 THEN round(CASE schedule
                 WHEN 0 THEN met
                 WHEN 1 THEN least(1.0, CASE WHEN met < 0.375
                   THEN 2 * met / (0.5 + sqrt(0.25 + met * 2))
                   ELSE 0.5 + 2 * (met - 0.375) / (1.0 + sqrt(1.0 + (met - 0.375) * 2)) END)
                 ELSE least(1.0, CASE WHEN met * 1.125 < 0.75
                   THEN 2 * (met * 1.125) / (2.0 + sqrt(greatest(0.0, 4.0 - met * 1.125 * 4)))
                   ELSE 0.5 + 2 * (met * 1.125 - 0.75) / (1.0 + sqrt(greatest(0.0, 1.0 - (met * 1.125 - 0.75) * 2))) END)
               END, 9) END AS position
        FROM x
    """,
    "op4_exact_top_k": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other,
                 list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op6_decontamination": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM documents),
        b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM benchmark),
        w AS (
          SELECT DISTINCT item_id, least(len(words), 10) AS width, array_to_string(words[i:i + 9], ' ') AS w
          FROM (SELECT *, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
        placed AS (
          SELECT r, i, width, array_to_string(words[i:i + width - 1], ' ') AS w
          FROM (SELECT r, words, width, unnest(range(1, len(words) - width + 2)) AS i
                FROM d, (SELECT DISTINCT width FROM w) WHERE len(words) >= width)),
        hits AS (SELECT placed.r, placed.i, placed.width, w.item_id FROM placed JOIN w USING (w, width)),
        n AS (
          SELECT r, count(DISTINCT k) AS n_hit
          FROM (SELECT DISTINCT r, unnest(range(i, i + width)) AS k FROM hits) GROUP BY r),
        m AS (
          SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
    """,
    "op7_warc_revisits": """
        WITH p AS (
          SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h
          FROM pages),
        x AS (
          SELECT *, translate(lpad(to_base(('0x' || h[1:10])::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || h[11:20])::BIGINT, 32), 8, '0')
                 || lpad(to_base(('0x' || h[21:30])::BIGINT, 32), 8, '0') || lpad(to_base(('0x' || h[31:40])::BIGINT, 32), 8, '0'),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
                 row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, r) AS n,
                 first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, r) AS first_id
          FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n > 1 THEN first_id END AS refers_to
        FROM x
    """,
    "op10_preference_format": """
        WITH t AS (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i,
                 replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
          FROM conversations),
        l AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS last FROM t GROUP BY conv_id),
        r AS (
          SELECT l.conv_id, l.last,
                 coalesce((SELECT arg_max(x.text, x.i) FROM t x WHERE x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.role = 'assistant' AND x.i < l.last),
                          (SELECT x.text FROM t x WHERE x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.i = l.last - 1), '') AS reply,
                 (SELECT x.text FROM t x WHERE x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.i = l.last) AS own,
                 (SELECT count(*) FROM t x WHERE x.conv_id IS NOT DISTINCT FROM l.conv_id) AS n
          FROM l),
        p AS (SELECT *, CASE WHEN last IS NULL THEN n WHEN reply = own THEN last ELSE last - 1 END AS k FROM r),
        sides AS (
          SELECT p.conv_id, 'c' AS side, t.i, t.role, t.text FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id WHERE t.i > p.k
          UNION ALL SELECT conv_id, 'r', last, 'assistant', reply FROM p WHERE last > k),
        spans AS (
          SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS whole,
                 length('<|im_start|>' || role || chr(10)) AS head FROM sides),
        at_ AS (SELECT *, sum(length(whole)) OVER (PARTITION BY conv_id, side ORDER BY i) - length(whole) + head AS start FROM spans),
        done AS (
          SELECT conv_id, side, string_agg(whole, '' ORDER BY i) AS text,
                 string_agg(start || '-' || (start + length(text) + 10), ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS mask
          FROM at_ GROUP BY conv_id, side)
        SELECT p.conv_id, p.k::INTEGER AS n_prompt_turns,
               coalesce((SELECT string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.i)
                         FROM t WHERE t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i <= p.k), '') AS prompt,
               coalesce(c.text, '') AS chosen_text, coalesce(r.text, '') AS rejected_text, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask,
               c.text IS NULL AND r.text IS NULL AS identical
        FROM p LEFT JOIN done c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.side = 'c' LEFT JOIN done r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.side = 'r'
    """,
}
