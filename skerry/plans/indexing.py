"""The write path: scan, parse, detect changes, chunk, encode, index, commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators.lexical import positions_of, postings_delta
from ..operators.vectors import LshConfig, encode, lsh_buckets, save_lsh
from ..options import DEFAULTS, SearchOptions
from ..schema import VERSION
from ..sources.catalog import Catalog, delete_by, upsert
from ..sources.files import classify_changes, index_counters, metadata, parse_files, scan_files

#: Fewer vectors than these are searched exactly, without buckets.
FLAT_BELOW = 1000
#: How the tables of a snapshot are laid out: terms in order let a prefix read few files.
LAYOUT = {"positions": ["term"], "chunks": ["chunk_id"], "documents": ["id"]}


def build_tables(docs: DataFrame, chunks: DataFrame, old: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    """Tables of the next snapshot from changed documents, their stored chunks and the tables before.

    Documents that vanished from the source stay. Re-indexed documents' chunks,
    positions and buckets are replaced.
    """
    positions = positions_of(chunks)
    if old:
        gone = docs.select(F.col("id").alias("parent_file_id"))
        stale = old["chunks"].join(gone, "parent_file_id", "left_semi").select("chunk_id")
        docs = upsert(old["documents"], docs)
        positions = postings_delta(old["positions"], stale, chunks)
        chunks = delete_by(old["chunks"], gone, "parent_file_id").unionByName(chunks)
    return {"documents": docs, "chunks": chunks, "positions": positions}


def _stored(spark: SparkSession, catalog: Catalog, df: DataFrame, table: str, number: int) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(catalog.path(table, number))
    return spark.read.schema(df.schema).parquet(catalog.path(table, number))


def index_table(spark: SparkSession, catalog: Catalog, scanned: DataFrame, options: SearchOptions = DEFAULTS, encoder=None) -> DataFrame:
    """Index changed rows of ``scanned`` (document columns with body) into a new snapshot; returns the counters.

    Changed documents are scanned, parsed and compared once, and their chunks encoded
    once: both are stored beside the snapshot until it is whole. The counters include
    the texts that the encoder failed on (unencoded).
    """
    names = ("documents", "chunks", "positions")
    old = {n: catalog.read(n) for n in names} if catalog.snapshots() else None
    classified = classify_changes(scanned, old["documents"]) if old else scanned.withColumn("status", F.lit("new"))
    number = catalog.claim()
    cols = ["id", "file_path", "title", "file_type", "modified_at", "size_bytes", "status"]
    body = F.when(F.col("status") != "skipped", F.col("body")).alias("body")
    classified = _stored(spark, catalog, classified.select(*cols, body), "_scanned", number)
    counters = index_counters(classified).toPandas()
    changed = classified.where("status <> 'skipped' and body is not null")
    chunks = chunk_documents(changed, options, "id", "body", hashed_ids=True)
    failed = spark.sparkContext.accumulator(0)
    chunks = encode(chunks, encoder, failed=failed) if encoder is not None else chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    chunks = _stored(spark, catalog, chunks.withColumn("created_at", F.lit(options.as_of_ms)), "_chunks", number)
    # Text lives in the chunks.
    docs = changed.select("id", "file_path", "title", F.lit("").alias("body"), "file_type", "modified_at", "size_bytes")

    def buckets(n):
        stored = spark.read.parquet(catalog.path("chunks", n))
        with_vectors = stored.where("embedding is not null").count()
        if with_vectors >= FLAT_BELOW:
            # Buckets are rebuilt over all vectors.
            config = LshConfig.for_recall(with_vectors, options.dim)
            save_lsh(lsh_buckets(stored, config, options.dim), config, catalog.path("lsh", n), VERSION)

    catalog.commit(build_tables(docs, chunks, old), LAYOUT, number, buckets if encoder is not None else None)
    for table in ("_scanned", "_chunks"):
        catalog.drop(table, number)
    counters["unencoded"] = failed.value
    return spark.createDataFrame(counters)


def index_files(spark: SparkSession, catalog: Catalog, roots: list[str], options: SearchOptions = DEFAULTS, encoder=None) -> DataFrame:
    return index_table(spark, catalog, metadata(parse_files(scan_files(spark, roots))), options, encoder)
