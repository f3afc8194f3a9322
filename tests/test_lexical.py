"""Full-text search against SQLite FTS5 and against hand-made cases."""

import random
import sqlite3

import pytest

from skerry.operators import lexical, results
from skerry.operators.chunking import chunk_documents

CHUNKS = [(1, "Kotlin coroutines guide: the foo-bar of it"), (2, "bar foo and foobar"), (3, "it's a foo barn"), (4, "Éclair eclairs ECLAIR"), (5, "")]


@pytest.fixture(scope="module")
def index(spark):
    return lexical.build_index(spark.createDataFrame(CHUNKS, "chunk_id long, text string"))


def found(spark, index, text):
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    return sorted(r.chunk_id for r in lexical.match(q, index).collect())


@pytest.mark.parametrize(
    "text, want",
    [("foo", [1, 2, 3]), ("foo-bar", [1, 3]), ("foo bar", [1, 2, 3]), ("eclair", [4]), ("| foo", []), ("", []), ("it's", [3]), ("kot COR", [1]), ("zzz", []), ("foo-foo", [])],
)
def test_match(spark, index, text, want):
    assert found(spark, index, text) == want


def test_query_text(spark):
    df = spark.createDataFrame([('  say "hi"  there ',), ("",)], "t string").select(lexical.fts_query("t" and __import__("pyspark").sql.functions.col("t")).alias("q"))
    assert [r.q for r in df.collect()] == ['"say"* AND """hi"""* AND "there"*', ""]


def test_bm25_is_that_of_fts5(spark):
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("al", "be", "ga", "de") for b in ("", "x", "xy", "pha", "ta")]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 60)))) for i in range(200)]
    queries = ["al", "bex gap", "deta alpha ga", "al al", "be-ga", "zz"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", rows)
    ix = lexical.build_index(spark.createDataFrame(rows, "chunk_id long, text string"))
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25(q, ix).collect()}
    want = {}
    for i, text in enumerate(queries):
        expr = " AND ".join(f'"{t}"*' for t in text.split())
        for rowid, score in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (expr,)):
            want[i, rowid] = score
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_column_weights_are_those_of_fts5(spark):
    rows = [(1, "ml intro", "ml ml guide"), (2, "notes", "about ml"), (3, "ml", "other"), (4, "x", "y"), (5, "z", "w"), (6, "v", "u"), (7, "t", "s")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, title, body) VALUES (?, ?, ?)", rows)
    want = dict(db.execute("SELECT rowid, bm25(f, 1.2, 0.75) FROM f WHERE f MATCH '\"ml\"*'"))
    df = spark.createDataFrame(rows, "id long, title string, body string")
    q = spark.createDataFrame([(1, "ml")], "query_id long, text string")
    got = {r.id: r.score for r in lexical.bm25_columns(q, df, {"title": 1.2, "body": 0.75}).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_delta_is_a_rebuild(spark):
    old = spark.createDataFrame(CHUNKS, "chunk_id long, text string")
    new = spark.createDataFrame([(2, "changed text"), (9, "added")], "chunk_id long, text string")
    gone = spark.createDataFrame([(2,), (4,)], "chunk_id long")
    delta = lexical.postings_delta(lexical.positions_of(old), gone, new)
    whole = lexical.positions_of(old.where("chunk_id not in (2, 4)").unionByName(new))
    assert sorted(map(tuple, delta.collect())) == sorted(map(tuple, whole.collect()))


META = "file_path string, title string, file_type string, modified_at long, size_bytes long"


def test_files_by_best_chunk(spark):
    rows = [(1, 1, 10, "alpha one", -9.0), (1, 2, 10, "alpha two", -8.0), (1, 3, 10, "alpha three", -7.5), (1, 4, 10, "alpha four", -6.0), (1, 5, 20, "beta one", -12.0)]
    hits = spark.createDataFrame([(*r, f"/f{r[2]}", "t", "txt", 0, 0) for r in rows], f"query_id long, chunk_id long, parent_file_id long, text string, score double, {META}")
    files = results.normalize_inverted(results.aggregate_sparse(hits), 50).orderBy("rank").collect()
    assert [f.parent_file_id for f in files] == [20, 10]
    assert files[1].snippets == ["alpha one", "alpha two", "alpha three"]
    assert [f.score for f in files] == [1.0, 0.0]
    alone = results.normalize_inverted(results.aggregate_sparse(hits.where("parent_file_id = 20")), 50)
    assert alone.first().score == 1.0


def test_hydration_drops_orphans(spark):
    docs = spark.createDataFrame([(1, "/a", "a", "txt", 0, 0)], f"id long, {META}")
    text = spark.createDataFrame([(1, "one two"), (2, "orphan text")], "id long, text string")
    c = chunk_documents(text).select("chunk_id", "parent_file_id", "text")
    scored = spark.createDataFrame([(1, 100000, 1.0), (1, 200000, 1.0), (1, 999, 1.0)], "query_id long, chunk_id long, score double")
    assert [r.parent_file_id for r in results.hydrate(scored, c, docs).collect()] == [1]


def test_filters(spark):
    d = spark.createDataFrame([(1, "/a", "a", "PDF", 10, 0), (2, "/b", "b", "txt", 20, 0), (3, "/c", "c", "pdf", 30, 0)], f"id long, {META}")

    def ids(*fs):
        return sorted(r.id for r in results.apply_filters(d, list(fs)).collect())

    assert ids(("all",)) == [1, 2, 3] and ids(("type", "pdf")) == [1, 3]
    assert ids(("dates", 10, 20)) == [1, 2] and ids(("dates", 11), ("type", "pdf")) == [3]
    assert results.reset_filters([("type", "pdf")], "type") == [("all",)]
