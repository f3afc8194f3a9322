"""Normalisers, fusion, reciprocal ranks, diversification, reranking, evaluation."""

import math

import pytest
from pyspark.sql import functions as F

from skerry.operators import evaluation, ranking
from skerry.options import DAY_MS, DEFAULTS
from skerry.plans.engine import overlap_scorer

ATTRS = "title string, snippet string, file_path string, file_type string, modified_at long, size_bytes long"


def test_min_max(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 6.0), (2, 5.0), (2, 5.0)], "k long, x double")
    got = df.select("k", ranking.min_max(F.col("x"), "k").alias("n"), ranking.z_score(F.col("x"), "k").alias("z")).orderBy("k", "n").collect()
    assert [r.n for r in got] == [0.0, 0.5, 1.0, 0.5, 0.5]
    assert [r.z for r in got] == [pytest.approx(-math.sqrt(1.5)), 0.0, pytest.approx(math.sqrt(1.5)), 0.0, 0.0]


def candidates(spark, rows):
    schema = f"query_id long, id long, {ATTRS}, bm25_score double, dense_score double, embedding array<float>"
    return spark.createDataFrame([(1, i, t, "", "/x", kind, m, 0, b, d, None) for i, t, kind, m, b, d in rows], schema)


def fused(spark, rows, text="kotlin"):
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    return ranking.fuse(candidates(spark, rows), q, DEFAULTS.as_of_ms).orderBy("rank").collect()


def test_title_match_goes_first(spark):
    got = fused(spark, [(2, "Random Notes", "x", 0, 0.8, 0.6), (3, "Kotlin Guide", "x", 0, 0.8, 0.6)])
    assert [r.id for r in got] == [3, 2] and got[0].final_score - got[1].final_score == pytest.approx(0.1)
    assert [r.final_score for r in fused(spark, [(1, "a", "x", 0, 0.8, 0.6)], " ")] == [pytest.approx(0.45)]


def test_file_type_and_recency(spark):
    now = DEFAULTS.as_of_ms
    got = fused(spark, [(1, "a", "PDF", now, 1.0, None), (2, "b", "png", now - 30 * DAY_MS, None, 1.0), (3, "c", "kt", now + DAY_MS, 0.5, 0.5)])
    want = {1: (0.45 + 0.1) * 1.1, 2: 0.35 * 0.9, 3: 0.45 * 0.5 + 0.35 * 0.5 + 0.1}
    assert {r.id: r.final_score for r in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_outer_join_prefers_dense(spark):
    s = spark.createDataFrame([(1, 1, "s1", "", "", "", 0, 0, 0.5), (1, 2, "s2", "", "", "", 0, 0, 0.4)], f"query_id long, id long, {ATTRS}, score double")
    d = spark.createDataFrame([(1, 2, "d2", "", "", "", 0, 0, 0.9, [1.0]), (1, 3, "d3", "", "", "", 0, 0, 0.8, [2.0])], f"query_id long, id long, {ATTRS}, score double, embedding array<float>")
    got = {r.id: (r.title, r.bm25_score, r.dense_score, r.embedding) for r in ranking.join_candidates(s, d).collect()}
    assert got == {1: ("s1", 0.5, None, None), 2: ("d2", 0.4, 0.9, [1.0]), 3: ("d3", None, 0.8, [2.0])}


def test_reciprocal_ranks_are_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, id long, rank int")
    x, y = ([tuple(r) for r in ranking.reciprocal_ranks(l).orderBy("rank").collect()] for l in ([a, b], [b, a]))
    assert x == y and [r[1] for r in x] == [20, 10, 30] and x[0][2] == pytest.approx(1 / 61 + 1 / 62)


def mmr(spark, rows, **more):
    df = spark.createDataFrame([(1, i, s, r, v) for r, (i, s, v) in enumerate(rows, 1)], "query_id long, id long, score double, rank int, embedding array<float>")
    return [r.id for r in ranking.mmr(df, **more).orderBy("place").collect()]


def test_diversification(spark):
    rows = [(1, 1.0, [1.0, 0.0]), (2, 0.95, [1.0, 0.01]), (3, 0.7, [0.0, 1.0]), (4, 0.6, None)]
    assert mmr(spark, rows) == [1, 3, 4, 2]
    assert mmr(spark, rows, weight=1.0) == [1, 2, 3, 4]
    assert mmr(spark, rows, clamped=True) == [1, 3, 2]
    assert mmr(spark, rows, limit=2) == [1, 3]
    assert mmr(spark, [(1, 0.5, [0.0, 0.0]), (2, 0.5, [1.0]), (3, 0.5, [1.0, 2.0])]) == [1, 2, 3]


def test_negative_similarity_counts_unless_clamped(spark):
    rows = [(1, 1.0, [1.0, 0.0]), (2, 0.5, [0.0, 1.0]), (3, 0.45, [-1.0, 0.0])]
    assert mmr(spark, rows) == [1, 3, 2] and mmr(spark, rows, clamped=True) == [1, 2, 3]


def test_rerank(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 1, "none of it"), (1, 2, 0.8, 2, "kotlin text"), (1, 3, 0.1, 3, "kotlin")], "query_id long, id long, score double, rank int, snippet string")
    df = df.withColumn("_q", F.lit("kotlin"))
    assert [r.id for r in ranking.rerank(df, overlap_scorer(F.col("_q"), F.col("snippet"))).orderBy("rank").collect()] == [2, 3, 1]
    assert [r.id for r in ranking.rerank(df, None, returned=2).orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in ranking.rerank(df, overlap_scorer(F.col("_q"), F.col("snippet")), considered=1).collect()] == [1]


def test_dense_is_skipped_on_many_files(spark):
    df = spark.createDataFrame([(1, 1.0)] * 50 + [(2, 1.0)] * 49 + [(3, 0.8)] * 60, "query_id long, score double")
    assert {r.query_id: r.skipped for r in ranking.skip_dense(df).collect()} == {1: True, 2: False, 3: False}


def test_average_precision(spark):
    ranked = [("kotlin coroutines", ["/docs/kotlin_guide.pdf", "/docs/other.md"]), ("machine learning", ["/docs/ml_intro.pdf", "/docs/neural_nets.txt", "/x"]), ("android workmanager", ["/docs/workmanager_notes.md"])]
    rel = [("kotlin coroutines", "/docs/kotlin_guide.pdf"), ("machine learning", "/docs/ml_intro.pdf"), ("machine learning", "/docs/neural_nets.txt"), ("android workmanager", "/docs/workmanager_notes.md")]
    r = spark.createDataFrame([(q, p, i) for q, ps in ranked for i, p in enumerate(ps, 1)], "query_id string, file_path string, rank int")
    q = spark.createDataFrame(rel, "query_id string, file_path string")
    assert evaluation.mean_average_precision(r, q).first().map == 1.0
    late = r.withColumn("rank", F.col("rank") + 1)
    assert evaluation.mean_average_precision(late, q).first().map == pytest.approx((0.5 + (1 / 2 + 2 / 3) / 2 + 0.5) / 3)
    assert evaluation.mean_average_precision(r.limit(0), q).first().map == 0.0
    assert evaluation.mean_average_precision(r, q.limit(0)).first().map == 0.0


def metrics(spark, totals, counts=None):
    rows = [(i, f"q{i}", t, 1, 2, 3, c, 50, i) for i, (t, c) in enumerate(zip(totals, counts or [5] * len(totals)))]
    return spark.createDataFrame(rows, "seq long, query string, total_ms long, bm25_ms long, dense_ms long, fusion_ms long, final_count long, memory_mb long, ts long")


def test_performance(spark):
    p = evaluation.performance(metrics(spark, [70, 10, 20, 30, 40, 50, 60], [0, 11, 20, 5, 0, 0, 1])).first()
    assert p.p95_latency == 60.0 and p.avg_latency == 40.0 and p.query_processing == 34.0 and p.reranking == pytest.approx(1.2)
    assert (p.avg_results, p.high_recall, p.empty_rate, p.dataset_size, p.total_queries) == (5, 28, 42, 35, 7)
    assert evaluation.performance(metrics(spark, [0])).first().total == 1.0
    assert evaluation.performance(metrics(spark, [])).count() == 0


def test_history_holds_the_last(spark):
    got = [r.seq for r in evaluation.recent(metrics(spark, range(250)), 200).collect()]
    assert got == list(range(249, 49, -1))


def test_health(spark):
    d = spark.createDataFrame([(1, 5, 7)], "id long, size_bytes long, modified_at long")
    c = spark.createDataFrame([(1,)], "chunk_id long")
    assert tuple(evaluation.index_health(d, c).first()) == (1, 1, 5, 7, True)
    assert tuple(evaluation.index_health(d.limit(0), c.limit(0)).first()) == (0, 0, 0, 0, False)
    assert not evaluation.index_health(d, c.limit(0)).first().healthy


def test_last_list_gives_the_attributes(spark):
    a = spark.createDataFrame([(1, 7, 1, "sparse"), (1, 8, 2, "only")], "query_id long, id long, rank int, snippet string")
    b = spark.createDataFrame([(1, 7, 3, "dense")], a.schema)
    got = {r.id: (r.snippet, r.rank) for r in ranking.reciprocal_ranks([a, b], attributes=("snippet",)).collect()}
    assert got == {7: ("dense", 1), 8: ("only", 2)}


def test_pairs_are_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scorer(q, i):
        calls.add(1)
        return float(i)

    rows = spark.createDataFrame([(1, 5, "Tea"), (2, 5, "tea"), (3, 6, "tea"), (4, 5, "milk")], "query_id long, id long, _q string")
    got = ranking.score_once(rows, scorer.asNondeterministic()("_q", "id")).collect()
    assert sorted((r.query_id, r.pair_score) for r in got) == [(1, 5.0), (2, 5.0), (3, 6.0), (4, 5.0)] and calls.value == 3


def test_normalized_in_groups(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 6.0), ("b", 3.0), ("b", 3.0), (None, 1.0), (None, 2.0), ("a", None)], "k string, v double")
    got = [(r.k, r.v, r.n) for r in ranking.normalized(rows, "v", "k", "n").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("a", 2.0, 0.0), ("a", 4.0, 0.5), ("a", 6.0, 1.0), ("b", 3.0, 0.5), ("b", 3.0, 0.5), (None, 1.0, 0.0), (None, 2.0, 1.0), ("a", None, None)]))
    z = {r.v: r.n for r in ranking.normalized(rows.where("k = 'a' and v is not null"), "v", "k", "n", "z_score").collect()}
    assert z[4.0] == 0.0 and abs(z[6.0] - 1.5**0.5) < 1e-9
