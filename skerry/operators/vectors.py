"""Vector search: exact, locality-sensitive hashing, inverted cells, encoders.

Query vectors are a stated set. Up to a block of them is sent to all tasks; more are
dealt in blocks to groups of the data vectors. The two meet in Arrow batches by matrix
products, and each task hands on only its best k per query.
"""

from __future__ import annotations

import hashlib
import json
import math
import sys
from dataclasses import asdict, dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import fit_dim

#: Query vectors are sent along up to this many; more are dealt out in blocks of about as many.
QUERY_BLOCK = 4096
#: Data vectors of a group that meets blocks of queries.
VECTOR_GROUP = 1 << 18


def valid_vectors(df: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """Vectors that are present and of the index's dimension."""
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim))


def padded(df: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    return df.withColumn(vec_col, fit_dim(F.col(vec_col), dim))


def page(df: DataFrame, limit: int, offset: int, id_col: str = "chunk_id") -> DataFrame:
    """One page of vectors in id order."""
    return df.where(F.col("embedding").isNotNull()).orderBy(id_col).offset(offset).limit(limit)


def document_vectors(docs: DataFrame, snippet_chars: int | None = None) -> DataFrame:
    """Documents that have a vector; with ``snippet_chars``, the head of the body as body_snippet instead of the body."""
    rows = docs.where(F.col("embedding").isNotNull())
    if snippet_chars is None:
        return rows
    return rows.withColumn("body_snippet", F.substring("body", 1, snippet_chars)).drop("body")


def _matrix(col) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Best:
    """The best k of each query so far."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, top_k: int, threshold: float | None):
        self.ids, self.unit, self.top_k, self.threshold = ids, unit, top_k, threshold
        self.scores = np.full((len(ids), 0), 0.0)
        self.found = np.zeros((len(ids), 0), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        # Rounded, so that equal vectors tie however a product is blocked.
        s = np.round(self.unit @ _unit(vectors).T, 12)
        s, i = np.hstack([self.scores, s]), np.hstack([self.found, np.broadcast_to(ids, s.shape)])
        o = np.lexsort((i, -s), axis=1)[:, : self.top_k]
        self.scores, self.found = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)

    def rows(self) -> pa.RecordBatch:
        keep = np.ones(self.scores.shape, bool) if self.threshold is None else self.scores >= self.threshold
        at = np.broadcast_to(self.ids[:, None], self.scores.shape)
        return pa.record_batch([pa.array(at[keep]), pa.array(self.found[keep]), pa.array(self.scores[keep])], names=["query_id", "id", "score"])


_SCORED = "query_id long, id long, score double"


def _dealt_knn(queries: DataFrame, vectors: DataFrame, top_k: int, threshold: float | None, block: int, group: int) -> DataFrame:
    """Scores where queries are too many to send: every block of queries meets every group of vectors in a task.

    The block's and the group's sizes bound a task; nothing passes the driver but two counts.
    """
    n_blocks, n_groups = -(-queries.count() // block), max(1, -(-vectors.count() // group))
    each = F.sequence(F.lit(0), F.lit(n_groups - 1))
    q = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).withColumn("_g", F.explode(each.cast("array<bigint>")))
    v = vectors.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(n_groups)))
    v = v.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))

    def meet(qs: pa.Table, vs: pa.Table) -> pa.Table:
        qs, vs = qs.combine_chunks(), vs.combine_chunks()
        out = []
        n = qs.num_rows and len(qs.column("v")[0])
        if n and vs.num_rows:
            best = _Best(qs.column("query_id").to_numpy(), _unit(_matrix(qs.column("v").chunk(0))), top_k, threshold)
            ids, vecs = vs.column("id").to_numpy(), _matrix(vs.column("v").chunk(0))
            for i in range(0, len(ids), 1 << 13):
                best.add(ids[i : i + (1 << 13)], vecs[i : i + (1 << 13)])
            out.append(best.rows())
        return pa.Table.from_batches(out, schema=pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    return q.groupBy("_g", "_b").cogroup(v.groupBy("_g", "_b")).applyInArrow(meet, _SCORED)


def exact_knn(
    queries: DataFrame,
    vectors: DataFrame,
    top_k: int,
    threshold: float | None = None,
    id_col: str = "chunk_id",
    vec_col: str = "embedding",
    block: int = QUERY_BLOCK,
    group: int = VECTOR_GROUP,
) -> DataFrame:
    """(query_id, id, score, rank): the top_k vectors by cosine of at least ``threshold``, ties by id.

    Vectors of another dimension than the queries' are passed over; a zero vector has cosine 0.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull())
    some = asked.limit(block + 1).collect()  # at most block + 1 rows
    if not some:
        return spark.createDataFrame([], _SCORED + ", rank int")
    dim = len(some[0].v)
    rows = valid_vectors(vectors, dim, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    if len(some) > block:
        out = _dealt_knn(asked.where(F.size("v") == dim), rows, top_k, threshold, block, group)
    else:
        some.sort(key=lambda r: r.query_id)
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in some], np.int64), _unit(np.array([r.v for r in some], float))))

        def best(batches):
            held = _Best(*sent.value, top_k, threshold)
            for b in batches:
                if b.num_rows:
                    held.add(b.column(0).to_numpy(), _matrix(b.column(1)))
            yield held.rows()

        out = rows.mapInArrow(best, _SCORED)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


# --- locality-sensitive hashing ---------------------------------------------


@dataclass(frozen=True)
class LshConfig:
    tables: int = 5
    bits: int = 10
    projection_dim: int = 48
    candidates: int | None = 80  # None: every member of the buckets
    memory_mode: str = "IN_MEMORY"

    @staticmethod
    def for_size(n: int, budget: int = 100) -> LshConfig:
        """Parameters by the number of vectors; ``budget`` (0 to 100) is how much effort is allowed."""
        rungs = ((10_000, (5, 10, 48, 80)), (50_000, (10, 12, 64, 100)), (200_000, (15, 14, 80, 120)))
        for below, values in rungs:
            if n < below:
                mode = "STREAMING" if below == 200_000 and budget <= 50 else "IN_MEMORY"
                return LshConfig(*values, mode)
        return LshConfig(20, 16, 96, 150, "STREAMING")

    @staticmethod
    def for_recall(n: int, dim: int, top_k: int = 10, recall: float = 0.95, most_tables: int = 64) -> LshConfig:
        """Tables and bits by which ``recall`` of the top_k of n vectors share a bucket with their query.

        The k-th neighbour's cosine is taken as it is for vectors without clusters,
        whose neighbours are the farthest. Bits are as many as ``most_tables`` allow.
        """
        z = NormalDist().inv_cdf(max(1 - top_k / max(n, 1), 0.5))
        same = 1 - math.acos(min(z / math.sqrt(dim), 0.99)) / math.pi

        def tables(bits):
            return math.ceil(math.log(1 - recall) / math.log(1 - same**bits))

        bits = max(b for b in range(1, 31) if b == 1 or tables(b) <= most_tables)
        return LshConfig(tables(bits), bits, max(bits, 48), None)

    def scaled(self, budget: int) -> LshConfig:
        if budget < 20:
            return replace(self, tables=max(3, self.tables // 3), candidates=self.candidates and self.candidates // 2, memory_mode="STREAMING")
        if budget < 50:
            return replace(self, tables=max(5, self.tables // 2), candidates=self.candidates and int(np.float32(self.candidates) * np.float32(0.7)))
        return self


def plane(table: int, bit: int, dim: int) -> np.ndarray:
    """A hyperplane with coordinates in [-1, 1) from md5: the same on every engine."""
    draws = [int(hashlib.md5(f"{table}:{bit}:{d}".encode()).hexdigest()[:6], 16) for d in range(dim)]
    return np.array(draws) / float(1 << 24) * 2 - 1


def planes(config: LshConfig, dim: int) -> np.ndarray:
    """(tables, bits, dim); only as many planes as both bits and projection_dim allow are used."""
    used = min(config.bits, config.projection_dim)
    drawn = [plane(t, b, dim) for t in range(config.tables) for b in range(used)]
    return np.array(drawn).reshape(config.tables, used, dim)


def lsh_hashes(vectors: DataFrame, config: LshConfig, dim: int, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """(id, table, hash): bit b is set if the product with plane b is positive."""
    p = vectors.sparkSession.sparkContext.broadcast(planes(config, dim))

    def hashes(batches):
        t, b, d = p.value.shape
        weights = 1 << np.arange(b)
        for batch in batches:
            m = _matrix(batch.column(1))
            if not len(m):
                continue
            h = ((m @ p.value.reshape(t * b, d).T).reshape(len(m), t, b) > 0) @ weights
            ids = np.repeat(batch.column(0).to_numpy(), t)
            tables = np.tile(np.arange(t, dtype=np.int32), len(m))
            yield pa.record_batch([pa.array(ids), pa.array(tables), pa.array(h.reshape(-1).astype(np.int32))], names=["id", "table", "hash"])

    rows = valid_vectors(vectors, dim, vec_col).select(F.col(id_col).cast("long").alias("id"), vec_col)
    return rows.mapInArrow(hashes, "id long, table int, hash int")


def lsh_buckets(vectors: DataFrame, config: LshConfig, dim: int, id_col: str = "chunk_id") -> DataFrame:
    """(table, hash, chunk_id): the index. Ids stand for the order of insertion; an id added twice is held once."""
    h = lsh_hashes(vectors, config, dim, id_col)
    return h.select("table", "hash", F.col("id").alias("chunk_id")).distinct()


def lsh_add(buckets: DataFrame, vectors: DataFrame, config: LshConfig, dim: int, id_col: str = "chunk_id") -> DataFrame:
    return buckets.unionByName(lsh_buckets(vectors, config, dim, id_col)).distinct()


def lsh_stats(buckets: DataFrame) -> DataFrame:
    """total_vectors, num_tables, buckets and avg_bucket_size: vectors over buckets of all tables (0 if none)."""
    per = buckets.groupBy("table", "hash").agg(F.count(F.lit(1)).alias("n"))
    b = per.agg(F.count(F.lit(1)).alias("buckets"), F.count_distinct("table").alias("num_tables"))
    n = buckets.agg(F.count_distinct("chunk_id").alias("total_vectors"))
    size = F.when(F.col("buckets") > 0, F.col("total_vectors") / F.col("buckets")).otherwise(F.lit(0.0))
    return n.crossJoin(b).select("total_vectors", "num_tables", "buckets", size.alias("avg_bucket_size"))


def lsh_candidates(queries: DataFrame, buckets: DataFrame, config: LshConfig, dim: int) -> DataFrame:
    """(query_id, id): members of the queries' buckets, table by table and in id order, up to ``candidates`` if not None.

    The limit is the index's own parameter; the exact search is the way past it.
    """
    q = lsh_hashes(queries, config, dim, "query_id").select(F.col("id").alias("query_id"), "table", "hash")
    hits = buckets.join(F.broadcast(q), ["table", "hash"])
    first = hits.groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.min("table").alias("table"))
    if config.candidates is None:
        return first.select("query_id", "id")
    w = Window.partitionBy("query_id").orderBy("table", "id")
    return first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= config.candidates).select("query_id", "id")


def score_pairs(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score) for candidate pairs; ids without a vector drop out."""

    def cosines(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _unit(_matrix(b.column(2))), _unit(_matrix(b.column(3)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.round((x * y).sum(axis=1), 12))], names=["query_id", "id", "score"])

    v = vectors.where(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("embedding").alias("v"))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    rows = pairs.join(v, "id").join(F.broadcast(q), "query_id").where(F.size("q") == F.size("v"))
    return rows.select("query_id", "id", "q", "v").mapInArrow(cosines, "query_id long, id long, score double")


def _ranked(scored: DataFrame, top_k: int, threshold: float | None) -> DataFrame:
    rows = scored if threshold is None else scored.where(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def lsh_search(queries: DataFrame, buckets: DataFrame, vectors: DataFrame, config: LshConfig, dim: int, top_k: int, threshold: float | None = None, id_col: str = "chunk_id") -> DataFrame:
    pairs = lsh_candidates(queries, buckets, config, dim)
    return _ranked(score_pairs(pairs, queries, vectors, id_col), top_k, threshold)


def lsh_counts(queries: DataFrame, buckets: DataFrame, vectors: DataFrame, config: LshConfig, dim: int, threshold: float, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, candidates, kept): how many members of its buckets a query meets, and how many reach the threshold."""
    scored = score_pairs(lsh_candidates(queries, buckets, config, dim), queries, vectors, id_col)
    found = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("score") >= threshold).alias("kept"))
    return queries.select("query_id").join(found, "query_id", "left").na.fill(0, ["candidates", "kept"])


def dense_search(queries: DataFrame, buckets: DataFrame, vectors: DataFrame, config: LshConfig, dim: int, top_k: int, threshold: float, id_col: str = "chunk_id") -> DataFrame:
    """Hash search; queries for which it finds nothing above the threshold are answered exactly."""
    near = lsh_search(queries, buckets, vectors, config, dim, top_k, threshold, id_col)
    missed = queries.join(near.select("query_id").distinct(), "query_id", "left_anti")
    return near.withColumn("source", F.lit("ann")).unionByName(exact_knn(missed, vectors, top_k, threshold, id_col).withColumn("source", F.lit("exact")))


def save_lsh(buckets: DataFrame, config: LshConfig, path: str, version: int) -> None:
    spark = buckets.sparkSession
    buckets.repartitionByRange("table", "hash").sortWithinPartitions("table", "hash").write.mode("overwrite").parquet(f"{path}/buckets")
    meta = json.dumps({"version": version, **asdict(config)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_lsh(spark, path: str, version: int):
    """(buckets, config), or None if the stored version is another one: then rebuild."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.pop("version") != version:
        return None
    return spark.read.parquet(f"{path}/buckets"), LshConfig(**meta)


# --- inverted cells -----------------------------------------------------------


def fit_cells(vectors: DataFrame, cells: int = 100, sample: int = 10_000, rounds: int = 10, id_col: str = "chunk_id") -> np.ndarray:
    """Unit centres of spherical k-means on a bounded sample: the ``sample`` ids of smallest hash."""
    rows = vectors.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select("embedding").toArrow()
    x = _unit(_matrix(rows.column(0).combine_chunks())) if rows.num_rows else np.zeros((0, 1))
    k = min(cells, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)] if k else x
    for _ in range(rounds if k else 0):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = np.bincount(at, minlength=k) > 0
        centres[full] = _unit(sums[full])
    return centres


def assign_cells(vectors: DataFrame, centres: np.ndarray, probes: int = 1, id_col: str = "chunk_id") -> DataFrame:
    """(id, cell) of the nearest ``probes`` cells of each vector."""
    c = vectors.sparkSession.sparkContext.broadcast(centres)

    def cell(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = _unit(_matrix(b.column(1))) @ c.value.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), near.shape[1])), pa.array(near.reshape(-1).astype(np.int32))], names=["id", "cell"])

    rows = valid_vectors(vectors, centres.shape[1]).select(F.col(id_col).cast("long").alias("id"), "embedding")
    return rows.mapInArrow(cell, "id long, cell int")


def cell_search(queries: DataFrame, cells: DataFrame, vectors: DataFrame, centres: np.ndarray, top_k: int, probes: int = 10, id_col: str = "chunk_id") -> DataFrame:
    """Exact cosine over the vectors in the cells nearest to each query."""
    q = assign_cells(queries, centres, probes, "query_id").select(F.col("id").alias("query_id"), "cell")
    pairs = cells.join(F.broadcast(q), "cell").select("query_id", "id")
    return _ranked(score_pairs(pairs, queries, vectors, id_col), top_k, None)


def save_cells(cells: DataFrame, centres: np.ndarray, path: str, version: int) -> None:
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    rows = [(version, i, [float(x) for x in c]) for i, c in enumerate(centres)]
    cells.sparkSession.createDataFrame(rows, "version int, cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def load_cells(spark, path: str, version: int):
    """(cells, centres), or None if the stored version is another one."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r.cell)  # as many rows as cells
    if not rows or rows[0].version != version:
        return None
    return spark.read.parquet(f"{path}/cells"), np.array([r.centre for r in rows])


# --- encoders -------------------------------------------------------------------


def hashed_encoder(dim: int = 384, grams: tuple[int, ...] = (3, 5)):
    """A deterministic text encoder: signed hashes of byte n-grams of the lower-cased words, unit length.

    It stands where a neural encoder can be plugged in: any function from a list of
    texts to a matrix.
    """

    def encode(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            words = (text or "").lower().split()
            if not words:
                continue
            b = np.frombuffer(f" {' '.join(words)} ".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
            for n in grams:
                if len(b) < n:
                    continue
                key = np.zeros(len(b) - n + 1, np.uint64)
                for i in range(n):
                    key = (key << np.uint64(8)) | b[i : len(b) - n + 1 + i]
                h = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
                row += np.bincount(((h >> np.uint64(20)) % np.uint64(dim)).astype(np.int64), sign, dim)
        return _unit(out)

    return encode


def encode(df: DataFrame, encoder, text_col: str = "text", out: str = "embedding", failed=None) -> DataFrame:
    """``df`` with a vector column from an encoder (texts -> matrix), batch by batch.

    An encoder that fails leaves a batch's vectors null, so that indexing goes on
    without them; it is reported, and the texts are counted in the accumulator ``failed``.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def add(batches):
        for b in batches:
            try:
                m = encoder(b.column(b.schema.get_field_index(text_col)).to_pylist())
                vec = pa.array([r.astype(np.float32) for r in m], pa.list_(pa.float32()))
            except Exception as e:
                print(f"encoder failed on {b.num_rows} texts: {e!r}", file=sys.stderr)
                if failed is not None:
                    failed.add(b.num_rows)
                vec = pa.nulls(b.num_rows, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, vec], names=[*b.schema.names, out])

    return df.mapInArrow(add, schema)
