"""One query per operator of this subpackage, with its SQL where SQL can express it.

Each query applies its operator to its whole table with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bestfit import best_fit_packing
from .binary import pack_token_ids, write_packed
from .common import scratch_path, table
from .exact import exact_dedup
from .lines import remove_boilerplate
from .mixing import draw_copies
from .quality import quality_rules
from .simhash import simhash_groups
from .substring import substring_dedup
from .tokens import tokenizer_path
from .toxicity import fit_toxicity, score_toxicity
from .warc import read_warc, write_warc


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed")
    write_packed(pack_token_ids(table(spark, sf_dir, "documents"), tokenizer_path()), path)
    return spark.read.parquet(path)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc_dictionary,
        op2_substring_dedup,
        op3_exact_dedup,
        op4_source_mixing,
        op5_toxicity,
        op6_simhash,
        op7_token_matrices,
        op8_best_fit,
        op9_line_dedup,
        op10_quality_perplexity,
    )
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_AHEAD = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER w" for i in range(1, 13))])
_TRIM = r"' ' || chr(9) || chr(11) || chr(12) || chr(13)"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_dictionary": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
            g AS (SELECT payload_digest, min(page_id) AS response FROM q WHERE payload_bytes >= 100 GROUP BY 1)
            SELECT page_id, payload_bytes, q.payload_digest,
                   CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN response <> page_id THEN response END AS refers_to
            FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest""",
        "op2_substring_dedup": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
            t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
            k AS (SELECT doc_id, pos, word, {_AHEAD} AS win FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
            f AS (SELECT win, min(doc_id) AS first_id FROM k WHERE win IS NOT NULL GROUP BY win),
            m AS (SELECT k.doc_id, k.pos, k.word,
                         coalesce(max(CASE WHEN f.first_id < k.doc_id THEN 1 ELSE 0 END)
                           OVER (PARTITION BY k.doc_id ORDER BY k.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
                  FROM k LEFT JOIN f ON k.win = f.win),
            s AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
            SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN s ON d.doc_id = s.doc_id""",
        "op3_exact_dedup": """
            WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t""",
        "op4_source_mixing": f"""
            WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
                              ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
            p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
            r AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM p),
            o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap * (6 // w), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                         sum(w) OVER (ORDER BY cap * (6 // w), source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM r),
            c AS (SELECT *, rest * w >= cap * share AS capped FROM o),
            l AS (SELECT rest::DOUBLE AS level_rest, share::DOUBLE AS level_share FROM c WHERE NOT capped ORDER BY cap * (6 // w), source ASC NULLS LAST LIMIT 1),
            t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE level_rest * w::DOUBLE / level_share END AS target FROM c LEFT JOIN l ON true)
            SELECT doc_id, size, source_size, target,
                   (CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) + CASE WHEN u < target / source_size::DOUBLE - floor(target / source_size::DOUBLE) THEN 1 ELSE 0 END ELSE 0 END)::BIGINT * size AS taken
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
        "op9_line_dedup": f"""
            WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            t AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
            k AS (SELECT *, trim(line, {_TRIM}) AS key FROM t),
            b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 5),
            m AS (SELECT k.*, b.key IS NOT NULL AS gone FROM k LEFT JOIN b ON k.key = b.key)
            SELECT doc_id, count(*) FILTER (key <> '')::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM m GROUP BY doc_id""",
    }
