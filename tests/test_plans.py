"""Files to index to answers; incremental runs; streams."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from skerry.operators.vectors import hashed_encoder
from skerry.options import DEFAULTS, SearchOptions
from skerry.plans.engine import ResultCache, SearchEngine, overlap_scorer
from skerry.plans import indexing
from skerry.plans.indexing import index_files, index_table
from skerry.sources import files
from skerry.sources.catalog import Catalog, upsert
from skerry.streaming import indexer

SEED = {
    "ML_Intro_Guide.txt": "Machine learning introduces supervised models and training data.",
    "kotlin_coroutines.md": "Kotlin coroutines make asynchronous code simple. Machine parts are not covered.",
    "notes/random_notes.TXT": "Groceries and errands for the weekend.",
    "image.png": "not text",
    "empty.txt": "",
    "blank.txt": " \n ",
    "broken.txt": b"caf\xc3\xa9 \xff other bytes",
}


@pytest.fixture
def root(tmp_path):
    for name, body in SEED.items():
        p = tmp_path / "docs" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return tmp_path


def counters(df):
    return tuple(df.select("new", "updated", "skipped", "errors").first())


def test_scan_and_parse(spark, root):
    found = files.parse_files(files.scan_files(spark, [str(root / "docs"), str(root / "docs") + "/", str(root / "none")])).collect()
    names = {os.path.basename(r.path): r.body for r in found}
    assert set(names) == {"ML_Intro_Guide.txt", "kotlin_coroutines.md", "random_notes.TXT", "blank.txt", "broken.txt"}
    assert names["blank.txt"] is None and names["broken.txt"] == "café � other bytes"
    assert files.scan_files(spark, [str(root / "none")]).count() == 0


def test_only_the_first_bytes_are_read(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b" a" * 49_999 + b" " + "é".encode() + b"tail")
    body = files.parse_files(files.scan_files(spark, [str(tmp_path)])).first().body
    assert len(body) <= 100_000 and body.endswith("�") and "tail" not in body


def test_parsers_plug_in(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"%PDF text")
    assert files.parse_files(files.scan_files(spark, [str(tmp_path)])).first().body is None
    shown = zlib.compress(rb"BT /F1 12 Tf 72 700 Td (Deep \(very\) lear) Tj (ning) Tj 0 -14 Td [(note) -300 (book) 20 (s)] TJ T* <636166e9> Tj ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Length 9 /Filter /FlateDecode >>\nstream\n" + shown + b"\nendstream\nendobj\n%%EOF")
    assert files.parse_files(files.scan_files(spark, [str(tmp_path)])).first().body == "Deep (very) learning\nnote books\ncafé"
    monkeypatch.setitem(files.PARSERS, "pdf", lambda b: b.decode("latin-1")[5:12])
    assert files.parse_files(files.scan_files(spark, [str(tmp_path)])).first().body == "1.4\n1 0"


def test_index_search_answer(spark, root, monkeypatch):
    monkeypatch.setattr(indexing, "FLAT_BELOW", 1)
    catalog = Catalog(spark, str(root / "index"))
    enc = hashed_encoder(64)
    options = SearchOptions(dim=64, expansion=False)
    assert counters(index_files(spark, catalog, [str(root / "docs")], options, enc)) == (4, 0, 0, 1)
    assert catalog.snapshots() == [1] and catalog.size() > 0
    assert not catalog.has("_chunks", 1) and not catalog.has("_scanned", 1)
    engine = SearchEngine.open(catalog, options, encoder=enc, scorer=overlap_scorer)
    assert engine.buckets.select("table").distinct().count() == engine.lsh.tables
    q = spark.createDataFrame([(1, "machine learning"), (2, "   "), (3, "kotlin coroutines")], "query_id long, text string")
    got = {}
    for r in engine.search(q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert "ml" in got[1][0].file_path.lower() and "**machine** **learning**" in got[1][0].snippets[0].lower()
    assert 2 not in got and got[3][0].file_type == "md"
    answer = {r.query_id: r for r in engine.answer(q).collect()}
    assert answer[1].answer.startswith("1. ") and answer[1].citations and answer[2].answer is None
    lexical = SearchEngine.open(catalog, options).search(q.where("query_id = 1")).collect()
    assert {os.path.basename(r.file_path) for r in lexical} == {"ML_Intro_Guide.txt"}


def test_encoder_runs_once_and_failures_are_counted(spark, root):
    calls = spark.sparkContext.accumulator(0)

    def enc(texts):
        calls.add(len(texts))
        if any("kotlin" in t.lower() for t in texts):
            raise ValueError("no")
        return hashed_encoder(8)(texts)

    catalog = Catalog(spark, str(root / "index"))
    got = index_files(spark, catalog, [str(root / "docs")], SearchOptions(dim=8), enc).first()
    chunks = catalog.read("chunks")
    assert calls.value == chunks.count() == 4
    assert got.unencoded == chunks.where("embedding is null").count() > 0


def test_two_writers_take_two_numbers(spark, tmp_path):
    a, b = (Catalog(spark, str(tmp_path / "index")) for _ in range(2))
    assert (a.claim(), b.claim()) == (1, 2)


def test_term_filter_reaches_the_stored_positions(spark, root):
    catalog = Catalog(spark, str(root / "index"))
    index_files(spark, catalog, [str(root / "docs")])
    q = spark.createDataFrame([(1, "mach learning"), (2, "kotl")], "query_id long, text string")
    found = SearchEngine.open(catalog).sparse(q)
    plan = found._jdf.queryExecution().toString()
    assert "StringStartsWith(term,mach)" in plan and "StringStartsWith(term,kotl)" in plan
    assert found.count() > 0


def test_incremental_runs(spark, root):
    catalog = Catalog(spark, str(root / "index"))
    where = [str(root / "docs")]
    index_files(spark, catalog, where)
    assert counters(index_files(spark, catalog, where)) == (0, 0, 4, 1)
    changed, gone = root / "docs" / "kotlin_coroutines.md", root / "docs" / "broken.txt"
    changed.write_text("entirely other words")
    os.utime(changed, (1, 1))
    gone.unlink()
    (root / "docs" / "new.md").write_text("fresh words")
    assert counters(index_files(spark, catalog, where)) == (1, 1, 2, 1)
    docs, chunks, pos = (catalog.read(t) for t in ("documents", "chunks", "positions"))
    assert docs.count() == 5 and chunks.count() == 5  # a file that vanished stays indexed
    assert pos.where("term = 'coroutines'").count() == 0 and pos.where("term in ('entirely', 'fresh', 'cafe')").count() == 3
    assert pos.join(chunks, "chunk_id", "left_anti").count() == 0
    catalog.expire(1)
    assert catalog.snapshots() == [3]
    catalog.clear()
    assert catalog.snapshots() == [] and catalog.read("documents") is None and catalog.size() == 0


def test_a_run_that_dies_changes_nothing(spark, root):
    catalog = Catalog(spark, str(root / "index"))
    one = spark.createDataFrame([(1, "/a", "a", "first words", "txt", 1, 1)], "id long, file_path string, title string, body string, file_type string, modified_at long, size_bytes long")
    index_table(spark, catalog, one)
    two = one.withColumn("modified_at", F.lit(2).cast("long")).withColumn("body", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception):
        index_table(spark, catalog, two)
    assert catalog.read("positions").where("term = 'first'").count() == 1


def test_upsert_takes_the_last_version(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, version int")
    assert sorted(map(tuple, upsert(old, new).collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_stream_is_the_batch(spark, tmp_path):
    schema = "id long, file_path string, title string, body string, file_type string, modified_at long, size_bytes long"
    src = tmp_path / "in"
    rows = [(i, f"/f{i}", f"f{i}", f"words of file {i}", "txt", 5, 10) for i in range(6)]
    spark.createDataFrame(rows[:4], schema).write.mode("append").parquet(str(src))
    live, once = Catalog(spark, str(tmp_path / "live")), Catalog(spark, str(tmp_path / "once"))

    def run():
        q = indexer.stream_index(spark.readStream.schema(schema).parquet(str(src)), live, str(tmp_path / "cp"))
        q.awaitTermination()

    run()
    late = [*rows[4:], (1, "/f1", "f1", "newer words", "txt", 9, 10)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(src))
    run()
    index_table(spark, once, spark.createDataFrame([r for r in rows if r[0] != 1] + [late[-1]], schema))
    for t in ("documents", "positions"):
        a, b = (sorted(map(tuple, c.read(t).select(sorted(c.read(t).columns)).collect()), key=str) for c in (live, once))
        assert a == b


def test_stream_metrics(spark, tmp_path):
    schema = "seq long, total_ms long, final_count long, ts long"
    spark.createDataFrame([(i, i * 10, i % 2, i) for i in range(10)], schema).write.parquet(str(tmp_path / "m"))
    q = indexer.stream_metrics(spark.readStream.schema(schema).parquet(str(tmp_path / "m")), "live_metrics")
    q.awaitTermination()
    assert tuple(spark.table("live_metrics").first()) == (10, 45.0, 90, 5)


def test_latest_query_wins_and_the_ring_holds(spark):
    b = spark.createDataFrame([("s", 1, "k"), ("s", 3, "kot"), ("s", 2, "ko"), ("t", 1, "x")], "session string, ts long, text string")
    assert sorted(tuple(r) for r in indexer.latest_queries(b).collect()) == [("s", "kot", 3), ("t", "x", 1)]
    m = spark.createDataFrame([(i, i) for i in range(150)], "seq long, ts long")
    held = indexer.ring_buffer(m, m.select((F.col("seq") + 150).alias("seq"), (F.col("ts") + 150).alias("ts")), 200)
    assert sorted(r.seq for r in held.collect()) == list(range(100, 300))


def test_cache_and_options(spark):
    c = ResultCache(2)
    c.put(" Kotlin ", 1)
    c.put("b", 2)
    assert c.get("KOTLIN") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("kotlin") == 1
    spark.conf.set("skerry.chunk_size", "99")
    spark.conf.set("skerry.rerank", "true")
    o = SearchOptions.from_conf(spark)
    assert (o.chunk_size, o.rerank, o.threshold) == (99, True, 0.3) and o.reset() == DEFAULTS
    spark.conf.unset("skerry.chunk_size")
    spark.conf.unset("skerry.rerank")


def test_settings_reach_the_search(spark):
    docs = spark.createDataFrame([(i, f"/f{i}", f"f{i}", "txt", 0, 0) for i in range(60)], "id long, file_path string, title string, file_type string, modified_at long, size_bytes long")
    chunks = spark.createDataFrame([(i, i, f"shared word{i}", [1.0, float(i)]) for i in range(60)], "chunk_id long, parent_file_id long, text string, embedding array<float>")
    q = spark.createDataFrame([(1, "shared")], "query_id long, text string")
    few = SearchEngine.from_tables(docs, chunks, SearchOptions(dim=2, mmr_limit=5))
    assert few.search(q).count() == 5
    few.close()


def test_retries_and_policies(spark, tmp_path):
    tries = []

    def flaky(n):
        def run():
            tries.append(1)
            if len(tries) < n:
                raise ValueError("again")
            return len(tries)

        return run

    assert indexer.retrying(flaky(3)) == 3
    tries.clear()
    with pytest.raises(ValueError):
        indexer.retrying(flaky(4))
    assert len(tries) == 3

    rate = spark.readStream.format("rate").load()

    def start():
        return rate.writeStream.format("noop").queryName("index").trigger(processingTime="1 hour").start()

    first = indexer.scheduled(spark, "index", start)
    try:
        assert indexer.scheduled(spark, "index", start).id == first.id
        second = indexer.scheduled(spark, "index", start, "replace")
        assert second.id != first.id and not first.isActive and second.isActive
        second.stop()
    finally:
        first.stop()
