"""Ranking evaluation and query telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_precision(ranked: DataFrame, relevant: DataFrame, key: str = "file_path") -> DataFrame:
    """(query_id, ap) for each query of ``relevant`` (query_id, key): precision at each hit over the number of relevant keys."""
    rel = relevant.select("query_id", key).distinct()
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranked.select("query_id", key, "rank").join(rel, ["query_id", key], "left_semi")
    # Only hits are counted, so the running count is their own row number.
    hits = hits.withColumn("seen", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", key)))
    sums = hits.groupBy("query_id").agg(F.sum(F.col("seen") / F.col("rank")).alias("s"))
    return n.join(sums, "query_id", "left").select("query_id", (F.coalesce("s", F.lit(0.0)) / F.col("n_relevant")).alias("ap"))


def mean_average_precision(ranked: DataFrame, relevant: DataFrame, key: str = "file_path") -> DataFrame:
    """One row: map (0 without queries) and n_queries."""
    ap = average_precision(ranked, relevant, key)
    return ap.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"), F.count(F.lit(1)).alias("n_queries"))


def recent(metrics: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` metrics by time, newest first: what a ring buffer of that size holds."""
    return metrics.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def performance(metrics: DataFrame) -> DataFrame:
    """One row of latency, quality and index figures over a bounded history (see ``recent``).

    The 95th percentile is the value at place floor((n - 1) * 0.95) of the sorted
    totals; percentages and averages of counts are truncated.
    """
    n = F.count(F.lit(1))
    totals = F.array_sort(F.collect_list(F.col("total_ms").cast("double")))
    rows = metrics.agg(
        n.alias("n"),
        F.avg("total_ms").alias("avg"),
        totals.alias("sorted"),
        F.avg("bm25_ms").alias("bm25"),
        F.avg("dense_ms").alias("dense"),
        F.avg("fusion_ms").alias("fusion"),
        F.avg("final_count").cast("int").alias("avg_results"),
        (F.count_if(F.col("final_count") > 10) * 100 / n).cast("int").alias("high_recall"),
        (F.count_if(F.col("final_count") == 0) * 100 / n).cast("int").alias("empty_rate"),
        F.avg("memory_mb").cast("int").alias("memory"),
    ).where("n > 0")
    at = F.floor((F.col("n") - 1) * F.lit(0.95)).cast("int") + 1
    return rows.select(
        F.col("n").alias("total_queries"),
        F.col("avg").alias("avg_latency"),
        F.element_at("sorted", at).alias("p95_latency"),
        F.greatest(F.col("avg") - F.col("bm25") - F.col("dense") - F.col("fusion"), F.lit(0.0)).alias("query_processing"),
        F.col("bm25"),
        F.col("dense"),
        F.col("fusion"),
        F.greatest(F.col("fusion") * 0.4, F.lit(0.0)).alias("reranking"),
        F.greatest(F.col("avg"), F.lit(1.0)).alias("total"),
        F.col("avg_results"),
        F.col("high_recall"),
        F.col("empty_rate"),
        F.col("memory").alias("memory_mb"),
        F.lit(0.74).alias("avg_top_score"),
        F.lit(42).alias("avg_bucket_size"),
        (F.col("n") * F.col("avg_results")).alias("dataset_size"),
    )


def perf_line() -> F.Column:
    """The log line of a metric row."""
    return F.format_string(
        '[PERF] Query: "%s" | BM25: %dms (%d results) | Dense: %dms (%d results) | Fusion: %dms | Total: %dms (%d results) | Mem: %dMB -> %dMB',
        *[F.col(c) for c in ("query", "bm25_ms", "bm25_count", "dense_ms", "dense_count", "fusion_ms", "total_ms", "final_count", "memory_before_mb", "memory_mb")],
    )


def index_health(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, bytes, last_updated and healthy (files, and no fewer chunks than files)."""
    d = docs.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("modified_at"), F.lit(0)).alias("last_updated"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    healthy = (F.col("files") > 0) & (F.col("chunks") >= F.col("files"))
    return d.crossJoin(F.broadcast(c)).select("files", "chunks", "bytes", "last_updated", healthy.alias("healthy"))


def export_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    metrics.write.mode("overwrite").format(fmt).save(path)
