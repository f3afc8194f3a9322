"""The read path: understand, retrieve, fuse, diversify, rerank, aggregate, filter, answer.

All steps work on a table of queries (query_id, text) and build one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.query import understand_or_degrade
from ..operators import answers, lexical, ranking, results, vectors
from ..options import DEFAULTS, SearchOptions
from ..schema import VERSION


@dataclass
class SearchEngine:
    """Search over documents (id, attributes), chunks (chunk_id, parent_file_id, text, embedding) and their index.

    ``encoder`` turns query texts into vectors; without one, or with ``dense`` off,
    search is lexical alone. ``scorer`` gives a rerank score column from (_q, snippet).
    """

    documents: DataFrame
    chunks: DataFrame
    index: lexical.LexicalIndex
    options: SearchOptions = DEFAULTS
    encoder: object = None
    buckets: DataFrame | None = None
    lsh: vectors.LshConfig | None = None
    scorer: object = None
    kept: list[DataFrame] = field(default_factory=list)

    @classmethod
    def from_tables(cls, documents: DataFrame, chunks: DataFrame, options: SearchOptions = DEFAULTS, **more) -> SearchEngine:
        """An engine over tables without a stored index.

        Chunks are kept by the executors (and recomputed where one is lost), as both
        sides of the search read them; ``close`` lets them go.
        """
        chunks = chunks.persist()
        return cls(documents, chunks, lexical.build_index(chunks), options, **more)

    @classmethod
    def open(cls, catalog, options: SearchOptions = DEFAULTS, **more) -> SearchEngine:
        """An engine over the newest stored snapshot: nothing is tokenised or encoded again."""
        chunks = catalog.read("chunks")
        positions = catalog.read("positions")
        totals = chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(positions.agg(F.count(F.lit(1)).alias("total_len"))))
        number = catalog.snapshots()[-1]
        if "buckets" not in more and catalog.has("lsh", number):
            found = vectors.load_lsh(catalog.spark, catalog.path("lsh", number), VERSION)
            if found is not None:
                more["buckets"], more["lsh"] = found
        return cls(catalog.read("documents"), chunks, lexical.LexicalIndex(positions, totals), options, **more)

    def close(self) -> None:
        """Let go of what the executors keep for this engine."""
        for df in (self.chunks, *self.kept):
            df.unpersist()
        self.kept.clear()

    def sparse(self, queries: DataFrame, text_col: str = "text") -> DataFrame:
        """(query_id, id, attributes, snippet, score, rank) by BM25; 3 chunks are considered for each file asked for."""
        limit = self.options.sparse_limit
        top = lexical.top_chunks(lexical.bm25(queries, self.index, text_col), max(3 * limit, limit))
        hits = results.hydrate(top.drop("rank"), self.chunks.select("chunk_id", "parent_file_id", "text"), self.documents)
        return results.sparse_results(results.normalize_inverted(results.aggregate_sparse(hits), limit))

    def dense(self, query_vectors: DataFrame) -> DataFrame:
        """(query_id, id, attributes, snippet, score, rank, embedding) by cosine of (query_id, embedding)."""
        o = self.options
        k = o.dense_limit * 3
        stored = self.chunks.where(F.col("embedding").isNotNull())
        if self.buckets is not None and self.lsh is not None:
            found = vectors.dense_search(query_vectors, self.buckets, stored, self.lsh, o.dim, k, o.threshold)
        else:
            found = vectors.exact_knn(query_vectors, stored, k, o.threshold)
        found = found.select("query_id", F.col("id").alias("chunk_id"), "score")
        hits = results.hydrate(found, stored.select("chunk_id", "parent_file_id", "text", "embedding"), self.documents)
        return results.aggregate_dense(hits, o.dense_limit)

    def fused(self, queries: DataFrame, sparse: DataFrame, dense: DataFrame, text_col: str = "text") -> DataFrame:
        """Candidates of both sides, fused and diversified: (query_id, id, score, place)."""
        cand = ranking.join_candidates(sparse, dense)
        ranked = ranking.fuse(cand, queries, self.options.as_of_ms, text_col)
        chosen = ranking.mmr(ranked.withColumn("score", F.col("final_score")), self.options.mmr_lambda, self.options.mmr_limit)
        rows = ranked.join(chosen.select("query_id", "id", "place"), ["query_id", "id"])
        return rows.withColumn("score", F.col("final_score")).drop("rank").withColumnRenamed("place", "rank")

    def search(self, queries: DataFrame, filtered: bool = True) -> DataFrame:
        """Ranked files of each query; blank queries have none."""
        o = self.options
        asked = queries.where(F.trim("text") != "")
        know = understand_or_degrade(asked, o.as_of_ms, mode="all" if o.expansion else "terms")
        sparse = self.sparse(know.select("query_id", F.col("bm25_query").alias("text")))
        if self.encoder is not None and o.dense:
            # A few rows a query, which the skip test, the dense side and the fusion all read.
            sparse = sparse.persist()
            self.kept.append(sparse)
            skipped = ranking.skip_dense(sparse, o.skip_dense_files, o.skip_dense_score).where("skipped").select("query_id")
            wanted = know.select("query_id", F.col("dense_query").alias("text")).join(skipped, "query_id", "left_anti")
            dense = self.dense(vectors.encode(wanted, self.encoder).drop("text"))
        else:
            dense = sparse.limit(0).withColumn("embedding", F.lit(None).cast("array<float>"))
        plain = know.select("query_id", F.col("normalized").alias("text"))
        rows = self.fused(plain, sparse, dense)
        if o.rerank and self.scorer is not None:
            rows = rows.join(F.broadcast(plain.withColumnRenamed("text", "_q")), "query_id")
            rows = ranking.rerank(rows, self.scorer(F.col("_q"), F.col("snippet")), o.rerank_considered, o.rerank_returned).drop("_q")
        else:
            rows = rows.where(F.col("rank") <= o.rerank_returned)
        files = results.aggregate_files(rows, plain)
        return results.apply_query_filters(files, know) if filtered else files

    def answer(self, queries: DataFrame) -> DataFrame:
        """(query_id, answer, error, citations) from the filtered results and the raw query."""
        return answers.answer(self.search(queries), queries, max_chunks=self.options.context_chunks, max_chars=self.options.context_chars)


def overlap_scorer(query, snippet):
    """A pair score that needs no model: the share of query terms in the snippet."""
    wanted = answers.term_set(query)
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.array_intersect(answers.term_set(snippet), wanted)) / n).otherwise(F.lit(0.0))


class ResultCache:
    """Results of the last queries by trimmed, lower-cased text, before filters; the least recently used goes first."""

    def __init__(self, size: int = 50):
        self.size, self.held = size, {}

    def get(self, query: str):
        key = query.strip().lower()
        if key in self.held:
            self.held[key] = self.held.pop(key)
            return self.held[key]
        return None

    def put(self, query: str, files) -> None:
        key = query.strip().lower()
        self.held.pop(key, None)
        self.held[key] = files
        while len(self.held) > self.size:
            self.held.pop(next(iter(self.held)))
