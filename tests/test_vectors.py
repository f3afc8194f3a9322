"""Vector search, hashing, encoders, codecs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import vectors as VF
from skerry.operators import vectors as V
from skerry.sources import files, vocab


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    m = np.concatenate([centres[i % 12] + 0.3 * rng.normal(size=24) for i in range(600)]).reshape(600, 24).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "chunk_id long, embedding array<float>").repartition(4)
    q = df.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return m.astype(float), df, q


def exact(m, i, k, threshold=-2.0):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u[i]
    return [int(j) for j in np.lexsort((np.arange(len(s)), -s)) if s[j] >= threshold][:k]


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_exact_search(spark, data):
    m, df, q = data
    assert by_query(V.exact_knn(q, df, 7)) == {i: exact(m, i, 7) for i in range(0, 600, 100)}
    assert by_query(V.exact_knn(q, df, 500, 0.5)) == {i: exact(m, i, 500, 0.5) for i in range(0, 600, 100)}
    assert V.exact_knn(q.limit(0), df, 7).count() == 0 and V.exact_knn(q, df.limit(0), 7).count() == 0


def test_more_queries_than_a_block(data, monkeypatch):
    m, df, q = data
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    assert by_query(V.exact_knn(q, df, 3)) == {i: exact(m, i, 3) for i in range(0, 600, 100)}


def test_other_dimensions_and_nulls_are_passed_over(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.id, r.score) for r in V.exact_knn(q, df, 9).orderBy("rank").collect()] == [(1, 1.0), (4, 0.0)]


def test_ladder():
    sizes = {0: (5, 10, 48, 80), 9_999: (5, 10, 48, 80), 10_000: (10, 12, 64, 100), 50_000: (15, 14, 80, 120), 200_000: (20, 16, 96, 150)}
    for n, want in sizes.items():
        c = V.LshConfig.for_size(n)
        assert (c.tables, c.bits, c.projection_dim, c.candidates) == want
    assert V.LshConfig.for_size(60_000, 50).memory_mode == "STREAMING" and V.LshConfig.for_size(60_000).memory_mode == "IN_MEMORY"
    low = V.LshConfig.for_size(10_000).scaled(10)
    assert (low.tables, low.candidates, low.memory_mode) == (3, 50, "STREAMING")
    mid = V.LshConfig.for_size(10_000).scaled(49)
    assert (mid.tables, mid.candidates, mid.memory_mode) == (5, 70, "IN_MEMORY")
    assert V.LshConfig.for_size(10).scaled(50) == V.LshConfig.for_size(10)


def test_hashes_by_sign(data):
    m, df, _ = data
    c = V.LshConfig(2, 6, 48, 50)
    p = V.planes(c, 24)
    got = {(r.id, r.table): r.hash for r in V.lsh_hashes(df, c, 24).collect()}
    assert all(got[i, t] == sum(1 << b for b in range(6) if m[i] @ p[t, b] > 0) for i in range(0, 600, 37) for t in range(2))
    assert V.planes(V.LshConfig(1, 6, 4, 50), 24).shape == (1, 4, 24)
    assert p.min() >= -1 and p.max() < 1


def test_hash_search_is_within_exact_and_recalls(data):
    m, df, q = data
    c = V.LshConfig(10, 4, 48, 600)
    b = V.lsh_buckets(df, c, 24)
    got = by_query(V.lsh_search(q, b, df, c, 24, 10))
    recall = np.mean([len(set(got[i]) & set(exact(m, i, 10))) / 10 for i in range(0, 600, 100)])
    assert recall >= 0.9 and all(got[i][0] == i for i in got)


def test_candidates_are_cut_in_table_order(spark):
    b = spark.createDataFrame([(t, 0, i) for t in range(2) for i in (range(5) if t else range(3, 8))], "`table` int, hash int, chunk_id long")
    q = spark.createDataFrame([(1, [-1.0, -1.0])], "query_id long, embedding array<float>")
    c = V.LshConfig(2, 0, 48, 6)
    got = sorted(r.id for r in V.lsh_candidates(q, b, c, 2).collect())
    assert got == [0, 3, 4, 5, 6, 7]


def test_queries_too_many_to_send_are_dealt_out(data):
    m, df, q = data
    many = df.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    for threshold in (None, 0.3):
        sent, dealt = (by_query(V.exact_knn(many, df, 5, threshold, block=b, group=g)) for b, g in ((4096, 1 << 18), (10, 150)))
        assert sent == dealt == {i: exact(m, i, 5, -2.0 if threshold is None else threshold) for i in range(0, 600, 7)}


def test_fallback_is_exact(spark, data):
    m, df, q = data
    c = V.LshConfig(1, 8, 48, 50)
    none = V.lsh_buckets(df, c, 24).limit(0)
    got = V.dense_search(q, none, df, c, 24, 5, 0.3)
    assert by_query(got) == {i: exact(m, i, 5, 0.3) for i in range(0, 600, 100)}
    assert {r.source for r in got.collect()} == {"exact"}


def test_stats_add_save_load(spark, data, tmp_path):
    _, df, _ = data
    c = V.LshConfig(3, 4, 48, 50)
    half = V.lsh_buckets(df.where("chunk_id < 300"), c, 24)
    both = V.lsh_add(V.lsh_add(half, df.where("chunk_id >= 300"), c, 24), df.where("chunk_id >= 500"), c, 24)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, V.lsh_buckets(df, c, 24).collect()))
    s = V.lsh_stats(both).first()
    assert (s.total_vectors, s.num_tables) == (600, 3) and s.avg_bucket_size == pytest.approx(600 / s.buckets)
    assert V.lsh_stats(both.limit(0)).first().avg_bucket_size == 0
    V.save_lsh(both, c, str(tmp_path / "lsh"), 1)
    loaded, config = V.load_lsh(spark, str(tmp_path / "lsh"), 1)
    assert config == c and loaded.count() == both.count() and V.load_lsh(spark, str(tmp_path / "lsh"), 2) is None


def test_cells_recall(data):
    m, df, q = data
    centres = V.fit_cells(df, 12)
    cells = V.assign_cells(df, centres)
    assert cells.count() == 600
    got = by_query(V.cell_search(q, cells, df, centres, 10, probes=4))
    assert np.mean([len(set(got[i]) & set(exact(m, i, 10))) / 10 for i in range(0, 600, 100)]) >= 0.9


def test_cells_save_and_load(spark, data, tmp_path):
    _, df, _ = data
    centres = V.fit_cells(df, 5)
    V.save_cells(V.assign_cells(df, centres), centres, str(tmp_path / "c"), 1)
    cells, again = V.load_cells(spark, str(tmp_path / "c"), 1)
    assert cells.count() == 600 and (again == centres).all() and V.load_cells(spark, str(tmp_path / "c"), 2) is None


def test_document_vectors(spark):
    df = spark.createDataFrame([(1, "x" * 300, [1.0]), (2, "y", None)], "id long, body string, embedding array<float>")
    assert [r.id for r in V.document_vectors(df).collect()] == [1]
    assert [len(r.body_snippet) for r in V.document_vectors(df, 250).collect()] == [250]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = df.select(VF.cosine(F.col("a"), F.col("b")).alias("c"), VF.l2_normalize(F.col("a")).alias("n"), VF.fit_dim(F.col("a"), 3).alias("p")).collect()
    assert [r.c for r in got] == [pytest.approx(0.96), 0.0, 0.0, 0.0]
    assert got[0].n == [pytest.approx(0.6), pytest.approx(0.8)] and got[1].n == [0.0, 0.0] and got[0].p == [3.0, 4.0, 0.0]


def test_blob_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    got = df.select("v", files.vector_to_bytes("v").alias("b")).withColumn("w", files.bytes_to_vector("b")).collect()
    assert bytes(got[0].b) == np.array([1.5, -2.0], "<f4").tobytes() and got[0].w == got[0].v and got[1].b is None and got[1].w is None


def test_encoder_and_its_failure(spark):
    df = spark.createDataFrame([(1, "kotlin guide"), (2, ""), (3, None)], "chunk_id long, text string")
    got = {r.chunk_id: r.embedding for r in V.encode(df, V.hashed_encoder(32)).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5) and not any(got[2]) and not any(got[3])

    def broken(texts):
        raise RuntimeError("no model")

    assert [r.embedding for r in V.encode(df, broken).collect()] == [None] * 3


def test_page(data):
    _, df, _ = data
    assert [r.chunk_id for r in V.page(df, 3, 10).collect()] == [10, 11, 12]


VOCAB = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "a", "##b"])}


def test_wordpiece(spark):
    assert vocab.wordpiece("Unaffable ab", VOCAB, 8) == ([2, 4, 5, 6, 7, 8, 3, 0], [1] * 7 + [0])
    assert vocab.wordpiece("xa", VOCAB, 5) == ([2, 1, 1, 3, 0], [1, 1, 1, 1, 0])
    assert vocab.wordpiece("a a unaffable a", VOCAB, 5) == ([2, 7, 7, 4, 5], [1] * 5)  # [SEP] is cut off
    got = vocab.encode_wordpiece(spark.createDataFrame([("a",), (None,)], "text string"), VOCAB, max_len=4).collect()
    assert [r.encoded.input_ids for r in got] == [[2, 7, 3, 0], [2, 3, 0, 0]]


def test_vocab_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text(" a \nb\n\nc\n")
    assert vocab.read_vocab(spark, str(tmp_path / "v.txt")) == {"a": 0, "b": 1, "": 2, "c": 3}
    assert vocab.read_vocab(spark, str(tmp_path / "v.txt"), lenient=False)[" a "] == 0
    assert vocab.read_vocab(spark, str(tmp_path / "none.txt")) == {}
    with pytest.raises(Exception):
        vocab.read_vocab(spark, str(tmp_path / "none.txt"), lenient=False)


def test_candidate_counts(data):
    m, df, q = data
    c = V.LshConfig(3, 4, 48, None)
    b = V.lsh_buckets(df, c, 24)
    got = {r.query_id: (r.candidates, r.kept) for r in V.lsh_counts(q, b, df, c, 24, 0.3).collect()}
    found = by_query(V.lsh_search(q, b, df, c, 24, 600, 0.3))
    assert {i: k for i, (_, k) in got.items()} == {i: len(found[i]) for i in got} and all(n >= k > 0 for n, k in got.values())
