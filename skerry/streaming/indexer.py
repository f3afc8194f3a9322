"""Streams of documents into the index, of queries, and of metrics."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import DEFAULTS, SearchOptions
from ..plans.indexing import index_table
from ..sources.catalog import Catalog


T = TypeVar("T")
ATTEMPTS = 3


def retrying(run: Callable[[], T], attempts: int = ATTEMPTS) -> T:
    """What ``run`` returns, tried up to ``attempts`` times; the last failure is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return run()
        except Exception:
            if attempt == attempts:
                raise
    raise ValueError("attempts must be at least 1")


def scheduled(spark: SparkSession, name: str, start: Callable[[], StreamingQuery], policy: str = "keep") -> StreamingQuery:
    """The active query of that name: under "keep" the one that runs, under "replace" a new one after it is stopped."""
    if policy not in ("keep", "replace"):
        raise ValueError(f"unknown policy {policy}")
    running = next((q for q in spark.streams.active if q.name == name), None)
    if running is not None and policy == "keep":
        return running
    if running is not None:
        running.stop()
    return start()


def stream_index(
    docs: DataFrame, catalog: Catalog, checkpoint: str, options: SearchOptions = DEFAULTS, encoder=None, once: bool = True, name: str | None = None, policy: str = "keep"
) -> StreamingQuery:
    """Index a stream of document rows (with body). ``once`` takes what is there and stops; else every six hours.

    A batch is tried up to three times. One that is repeated after a failure finds its
    documents unchanged and skips them. ``name`` and ``policy`` say what happens if
    such a query runs already.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        w = Window.partitionBy("file_path").orderBy(F.desc("modified_at"))
        last = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        retrying(lambda: index_table(df.sparkSession, catalog, last, options, encoder))

    out = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if once else out.trigger(processingTime="6 hours")
    if name is None:
        return out.start()
    return scheduled(docs.sparkSession, name, out.queryName(name).start, policy)


def latest_queries(batch: DataFrame) -> DataFrame:
    """Of a micro-batch of (session, ts, text), the newest text of each session: later typing cancels earlier."""
    return batch.groupBy("session").agg(F.max_by("text", "ts").alias("text"), F.max("ts").alias("ts"))


def stream_metrics(metrics: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Running totals of a stream of metrics, as an in-memory table."""
    agg = metrics.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total_ms").alias("avg_latency"),
        F.max("total_ms").alias("max_latency"),
        F.count_if(F.col("final_count") == 0).alias("empty"),
    )
    out = agg.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def ring_buffer(previous: DataFrame, batch: DataFrame, size: int = 200) -> DataFrame:
    """The last ``size`` metrics of what was held and what came."""
    return previous.unionByName(batch).orderBy(F.desc("ts"), F.desc("seq")).limit(size)
