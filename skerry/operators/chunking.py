"""Overlapping token windows of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import white_tokens
from ..options import DEFAULTS, SearchOptions

#: Chunk ids are parent id times this plus the chunk's index: stable across runs, no counter to share.
IDS_PER_FILE = 100_000


#: A single file of up to so many bytes may be a single row group, which a single task would read.
SMALL_BYTES = 64 << 20


def spread(rows: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``rows`` dealt to all cores if they are one small file; larger inputs come in enough splits as they are."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > limit or len(rows.inputFiles()) != 1:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def chunk_documents(docs: DataFrame, options: SearchOptions = DEFAULTS, id_col: str = "id", text_col: str = "text", hashed_ids: bool = False) -> DataFrame:
    """(chunk_id, parent_file_id, chunk_index, text, start_offset, end_offset) of every window.

    Windows begin at every step while tokens are left, so a last window may lie within
    the one before; offsets count tokens. A text without tokens has no chunk. With
    ``hashed_ids``, for parents whose ids are hashes themselves, chunk ids are too.
    """
    rows = spread(docs.select(F.col(id_col).alias("parent_file_id"), F.col(text_col).alias("text")))
    rows = rows.select("parent_file_id", white_tokens(F.col("text")).alias("tk"))
    rows = rows.where(F.size("tk") > 0).select("parent_file_id", "tk", F.posexplode(F.sequence(F.lit(0), F.size("tk") - 1, F.lit(options.step))).alias("chunk_index", "at"))
    return rows.select(
        (F.xxhash64("parent_file_id", "chunk_index") if hashed_ids else F.col("parent_file_id") * IDS_PER_FILE + F.col("chunk_index")).alias("chunk_id"),
        "parent_file_id",
        "chunk_index",
        F.array_join(F.slice("tk", F.col("at") + 1, F.lit(options.chunk_size)), " ").alias("text"),
        F.col("at").alias("start_offset"),
        F.least(F.col("at") + options.chunk_size, F.size("tk")).alias("end_offset"),
    )


def backfill_chunks(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One chunk for each body that isn't blank, with character offsets (the legacy layout)."""
    body = F.col(text_col)
    rows = docs.where(body.isNotNull() & (F.length(F.trim(body)) > 0))
    return rows.select(
        F.col(id_col).alias("parent_file_id"), F.lit(0).alias("chunk_index"), body.alias("text"), F.lit(0).alias("start_offset"), F.length(body).alias("end_offset")
    )
