"""Normalisers, fusion, reciprocal ranks, diversification, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import BOOSTED_TYPES, MUTED_TYPES
from ..options import DAY_MS

W_SPARSE, W_DENSE, W_RECENCY, W_TITLE = 0.45, 0.35, 0.10, 0.10


def min_max(x: Column, *keys: str) -> Column:
    """(x - min) / (max - min) within the keys; 0.5 where all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi - lo > 0, (x - lo) / (hi - lo)).otherwise(F.lit(0.5))


def z_score(x: Column, *keys: str) -> Column:
    """By population deviation; 0 where that is 0."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > 0, (x - F.avg(x).over(w)) / sd).otherwise(F.lit(0.0))


def normalized(df: DataFrame, x: str, key: str, out: str, kind: str = "min_max") -> DataFrame:
    """``df`` with ``min_max`` or ``z_score`` of column x within the key, for groups of any size.

    The groups' figures are partial aggregates that are joined back, so that a group
    that holds most rows isn't gathered in one task.
    """
    if kind == "min_max":
        stats = (F.min(x).alias("_p"), (F.max(x) - F.min(x)).alias("_q"))
    else:
        stats = (F.avg(x).alias("_p"), F.stddev_pop(x).alias("_q"))
    per = df.groupBy(F.col(key).alias("_key")).agg(*stats)
    rows = df.join(per, F.col(key).eqNullSafe(F.col("_key")), "left")
    flat = F.lit(0.5 if kind == "min_max" else 0.0)
    return rows.withColumn(out, F.when(F.col("_q") > 0, (F.col(x) - F.col("_p")) / F.col("_q")).otherwise(flat)).drop("_key", "_p", "_q")


def recency(modified_at: Column, as_of_ms: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(as_of_ms) - modified_at) / F.lit(float(DAY_MS))
    return F.exp(-age / 30.0)


def join_candidates(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Full outer by (query_id, id): attributes from dense where present, each side's score or null."""
    attrs = ("title", "snippet", "file_path", "file_type", "modified_at", "size_bytes")
    s = sparse.select("query_id", "id", *[F.col(a).alias(f"s_{a}") for a in attrs], F.col("score").alias("bm25_score"))
    vec = F.col("embedding") if "embedding" in dense.columns else F.lit(None).cast("array<float>")
    d = dense.select("query_id", "id", *[F.col(a).alias(f"d_{a}") for a in attrs], F.col("score").alias("dense_score"), vec.alias("embedding"))
    both = s.join(d, ["query_id", "id"], "full_outer")
    return both.select("query_id", "id", *[F.coalesce(f"d_{a}", f"s_{a}").alias(a) for a in attrs], "bm25_score", "dense_score", "embedding")


def fuse(candidates: DataFrame, queries: DataFrame, as_of_ms: int, text_col: str = "text") -> DataFrame:
    """Weighted fusion: final_score and rank of every candidate of every query."""
    rows = candidates.join(F.broadcast(queries.select("query_id", F.col(text_col).alias("_q"))), "query_id")
    rows = rows.withColumns(
        {
            "_s": min_max(F.coalesce("bm25_score", F.lit(0.0)), "query_id"),
            "_d": min_max(F.coalesce("dense_score", F.lit(0.0)), "query_id"),
            "_r": min_max(recency(F.col("modified_at"), as_of_ms), "query_id"),
        }
    )
    named = ~F.col("_q").rlike(r"^\s*$") & F.contains(F.lower("title"), F.lower("_q"))
    score = W_SPARSE * F.col("_s") + W_DENSE * F.col("_d") + W_RECENCY * F.col("_r") + F.when(named, W_TITLE).otherwise(0.0)
    kind = F.lower("file_type")
    boost = F.when(kind.isin(*BOOSTED_TYPES), 1.1).when(kind.isin(*MUTED_TYPES), 0.9).otherwise(1.0)
    rows = rows.withColumn("final_score", score * boost).drop("_q", "_s", "_d", "_r")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.asc("id"))))


def reciprocal_ranks(lists: list[DataFrame], k: int = 60, limit: int = 25, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score, rank): sums of 1 / (k + rank) over ranked lists (query_id, id, rank).

    ``attributes`` are carried along; where several lists have a result, the last one's count.
    """
    cols = ["query_id", "id", "rank", *attributes]
    rows = lists[0].select(*cols, F.lit(0).alias("_list"))
    for i, other in enumerate(lists[1:], 1):
        rows = rows.unionByName(other.select(*cols, F.lit(i).alias("_list")))
    carried = [F.max_by(c, "_list").alias(c) for c in attributes]
    sums = rows.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), *carried)
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))
    return ranked.where(F.col("rank") <= limit)


def mmr(ranked: DataFrame, weight: float = 0.7, limit: int = 20, clamped: bool = False) -> DataFrame:
    """Greedy diversification of (query_id, id, score, rank, embedding): adds place, from 1.

    Each step takes the candidate with the largest weight * score - (1 - weight) * the
    largest cosine to those taken; earlier ranks win ties. A missing or mismatched
    vector has cosine 0. ``clamped`` is the variant whose similarity is never below 0
    and that passes over candidates without a vector, but for the first. A query's
    candidates are what the limits of the ranked lists let through; all of them count.
    """
    rows = ranked

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("rank").reset_index(drop=True)
        vecs = [None if v is None or len(v) == 0 else np.asarray(v, float) for v in pdf["embedding"]]
        norms = [0.0 if v is None else float(np.sqrt((v * v).sum())) for v in vecs]

        def sim(i, j):
            a, b = vecs[i], vecs[j]
            if a is None or b is None or len(a) != len(b) or not norms[i] or not norms[j]:
                return 0.0
            return float((a * b).sum()) / (norms[i] * norms[j])

        score = pdf["score"].to_numpy()
        taken, left = [0], list(range(1, len(pdf)))
        worst = {i: max(sim(i, 0), 0.0) if clamped else sim(i, 0) for i in left}
        while left and len(taken) < limit:
            best, best_at = -np.inf, None
            for i in left:
                if clamped and vecs[i] is None:
                    continue
                m = weight * score[i] - (1 - weight) * worst[i]
                if m > best:
                    best, best_at = m, i
            if best_at is None:
                break
            taken.append(best_at)
            left.remove(best_at)
            for i in left:
                worst[i] = max(worst[i], sim(i, best_at))
        out = pdf.iloc[taken][["query_id", "id", "score"]].copy()
        out["place"] = np.arange(1, len(taken) + 1, dtype="int32")
        return out

    types = dict(rows.dtypes)
    schema = f"query_id {types['query_id']}, id {types['id']}, score double, place int"
    return rows.select("query_id", "id", "score", "rank", "embedding").groupBy("query_id").applyInPandas(run, schema)


def rerank(ranked: DataFrame, scorer: Column | None, considered: int = 100, returned: int = 20, cross_weight: float = 0.7) -> DataFrame:
    """Blend a pair score into the first ``considered`` results; without a scorer the first ``returned`` as they are."""
    if scorer is None:
        return ranked.where(F.col("rank") <= returned)
    top = ranked.where(F.col("rank") <= considered).withColumn("score", cross_weight * scorer + (1 - cross_weight) * F.col("score"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank")))
    return top.withColumn("rank", again).where(F.col("rank") <= returned)


def score_once(rows: DataFrame, scorer: Column, query_col: str = "_q", out: str = "pair_score") -> DataFrame:
    """``rows`` with a pair score that is computed once per query text, whatever its case, and id.

    For scorers dearer than a join: the pairs are made distinct before they are scored.
    """
    keys = [F.lower(F.col(query_col)).alias("_pair_q"), F.col("id").alias("_pair_id")]
    rows = rows.select("*", *keys)
    scores = rows.dropDuplicates(["_pair_q", "_pair_id"]).select("_pair_q", "_pair_id", scorer.alias(out))
    return rows.join(scores, ["_pair_q", "_pair_id"]).drop("_pair_q", "_pair_id")


def skip_dense(sparse: DataFrame, min_files: int = 50, min_score: float = 0.85) -> DataFrame:
    """(query_id, files, top_score, skipped): whether the sparse results make the dense search needless."""
    s = sparse.groupBy("query_id").agg(F.count(F.lit(1)).alias("files"), F.max("score").alias("top_score"))
    return s.withColumn("skipped", (F.col("files") >= min_files) & (F.col("top_score") >= min_score))
