"""From scored chunks to files: aggregation, hydration, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import highlight, join_snippets, snippet

META = ("file_path", "title", "file_type", "modified_at", "size_bytes")


def hydrate(scored: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Scored chunk ids with chunk text and file attributes; ids that no table has drop out."""
    d = docs.select(F.col("id").alias("parent_file_id"), *META)
    rows = scored.join(chunks.drop("created_at") if "created_at" in chunks.columns else chunks, "chunk_id")
    return rows.join(d, "parent_file_id")


def aggregate_sparse(hits: DataFrame) -> DataFrame:
    """Files of each query by best (lowest) chunk score, with the snippets of their top three chunks."""
    w = Window.partitionBy("query_id", "parent_file_id").orderBy(F.asc("score"), F.asc("chunk_id"))
    top = hits.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", snippet(F.col("text")).alias("s")))), lambda x: x["s"])
    best = {c: F.min_by(c, "rn").alias(c) for c in META}
    return top.groupBy("query_id", "parent_file_id").agg(F.min("score").alias("best_score"), parts.alias("snippets"), *best.values())


def normalize_inverted(files: DataFrame, limit: int) -> DataFrame:
    """Scores turned to 0..1, best 1, over all files of a query (1 if all are equal), then the best ``limit``."""
    all_ = Window.partitionBy("query_id")
    lo, hi = F.min("best_score").over(all_), F.max("best_score").over(all_)
    score = F.when(hi > lo, (hi - F.col("best_score")) / (hi - lo)).otherwise(F.lit(1.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc("best_score"), F.asc("parent_file_id")))
    return files.withColumns({"score": score, "rank": rank}).where(F.col("rank") <= limit)


def sparse_results(files: DataFrame) -> DataFrame:
    return files.select("query_id", F.col("parent_file_id").alias("id"), *META, join_snippets(F.col("snippets")).alias("snippet"), "score", "rank")


def aggregate_dense(hits: DataFrame, top_k: int) -> DataFrame:
    """Files of each query by best (highest) chunk score, snippets of the top three chunks joined."""
    w = Window.partitionBy("query_id", "parent_file_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    top = hits.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", snippet(F.col("text")).alias("s")))), lambda x: x["s"])
    keep = [c for c in (*META, "embedding") if c in hits.columns]
    files = top.groupBy("query_id", "parent_file_id").agg(F.max("score").alias("score"), join_snippets(parts).alias("snippet"), *[F.min_by(c, "rn").alias(c) for c in keep])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("parent_file_id")))
    return files.withColumn("rank", rank).where(F.col("rank") <= max(top_k, 1)).withColumnRenamed("parent_file_id", "id")


def aggregate_files(results: DataFrame, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Results grouped by path: best score, attributes of the top row, three highlighted snippets."""
    rows = results.join(F.broadcast(queries.select("query_id", F.col(text_col).alias("_q"))), "query_id")
    w = Window.partitionBy("query_id", "file_path").orderBy(F.desc("score"), F.asc("id"))
    top = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    marked = highlight(F.col("snippet"), F.col("_q"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", marked.alias("s")))), lambda x: x["s"])
    rest = [F.min_by(c, "rn").alias(c) for c in ("id", "title", "file_type", "modified_at", "size_bytes")]
    files = top.groupBy("query_id", "file_path").agg(F.max("score").alias("best_score"), parts.alias("snippets"), *rest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best_score"), F.asc("id")))
    return files.withColumn("rank", rank)


def by_type(df: DataFrame, file_type: str | None) -> DataFrame:
    return df if file_type is None else df.where(F.lower("file_type") == file_type.lower())


def by_date(df: DataFrame, start_ms: int | None, end_ms: int | None = None) -> DataFrame:
    """Both ends inclusive."""
    if start_ms is not None:
        df = df.where(F.col("modified_at") >= start_ms)
    return df if end_ms is None else df.where(F.col("modified_at") <= end_ms)


def apply_filters(df: DataFrame, filters: list[tuple]) -> DataFrame:
    """All of ("all",), ("type", t) and ("dates", start, end), one after another."""
    for kind, *args in filters:
        df = by_type(df, *args) if kind == "type" else by_date(df, *args) if kind == "dates" else df
    return df


def apply_query_filters(df: DataFrame, understood: DataFrame) -> DataFrame:
    """Keep results that pass the filters found in their query; after ranking, so fewer than k may be left."""
    f = understood.select("query_id", "filters.file_type", "filters.date_after", "filters.date_before")
    f = f.select("query_id", F.col("file_type").alias("_t"), F.col("date_after").alias("_a"), F.col("date_before").alias("_b"))
    rows = df.join(F.broadcast(f), "query_id")
    ok_type = F.col("_t").isNull() | (F.lower("file_type") == F.lower("_t"))
    ok_date = F.col("_a").isNull() | F.col("modified_at").between(F.col("_a"), F.coalesce("_b", F.lit((1 << 63) - 1)))
    return rows.where(ok_type & ok_date).drop("_t", "_a", "_b")


def reset_filters(filters: list[tuple], removed: str) -> list[tuple]:
    """Taking a type or date filter off leaves every file in view."""
    return [("all",)] if removed in ("type", "dates") else filters
