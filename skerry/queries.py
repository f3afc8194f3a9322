"""Queries over the test tables, one per operator, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import query as Q
from .functions import text as X
from .functions.vectors import l2_normalize
from .operators import answers, chunking, evaluation, lexical, ranking, results, vectors
from .options import DAY_MS, DEFAULTS
from .plans.engine import SearchEngine, overlap_scorer
from .queries_sql import EXTENSIONS, MATCH_QUERIES, RANK_LIMIT, TEXT_QUERIES, oracle_sql
from .sources import catalog, files, vocab

__all__ = ["flagship", "oracle_sql", "queries"]

AS_OF = DEFAULTS.as_of_ms


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf) -> DataFrame:
    d = _t(spark, sf, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), "source", F.lit("/doc_"), "doc_id", F.lit("."), ext).alias("file_path"),
        F.concat(F.lit("doc_"), "doc_id", F.lit(" "), "lang").alias("title"),
        "text",
        ext.alias("file_type"),
        (F.lit(AS_OF) - F.col("doc_id") * DAY_MS).alias("modified_at"),
        F.col("n_chars").alias("size_bytes"),
    )


def _chunks(spark, sf) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf))


def _values(spark, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "query_id long, text string")


def _match(spark) -> DataFrame:
    return _values(spark, MATCH_QUERIES)


def _vectors(spark, sf) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 3).alias("parent_file_id"), "embedding", "label")


def _every_hundredth(spark, sf) -> DataFrame:
    return _vectors(spark, sf).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def _numbered(spark, sf) -> DataFrame:
    """Every hundredth vector, numbered from 0; a vector stands for the match query of its number."""
    return _every_hundredth(spark, sf).withColumn("query_id", (F.col("query_id") / 100).cast("long"))


def _matched(spark, sf) -> DataFrame:
    return _numbered(spark, sf).where(F.col("query_id").isin([i for i, _ in MATCH_QUERIES]))


def _texts(spark, sf) -> DataFrame:
    literal = _values(spark, TEXT_QUERIES)
    return literal.unionByName(_t(spark, sf, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), "text"))


def _r(c, n=6):
    return F.round(c, n)


# --- chunks and full text -------------------------------------------------------


def chunk_documents(spark, sf):
    c = _chunks(spark, sf)
    return c.select("chunk_id", "parent_file_id", "chunk_index", "start_offset", "end_offset", F.md5("text").alias("text_md5"))


def chunk_backfill(spark, sf):
    c = chunking.backfill_chunks(_docs(spark, sf))
    return c.select("parent_file_id", "chunk_index", "start_offset", "end_offset")


def word_tokens_vocab(spark, sf):
    return lexical.vocabulary_of(lexical.positions_of(_chunks(spark, sf)))


def corpus_stats(spark, sf):
    ix = lexical.build_index(_chunks(spark, sf))
    return ix.totals.crossJoin(ix.positions.agg(F.count_distinct("term").alias("n_terms")))


def fts_query_build(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", lexical.fts_query(F.col("text")).alias("fts"))


def fts_prefix_match(spark, sf):
    return lexical.match(_match(spark), lexical.build_index(_chunks(spark, sf)))


def fts_phrase_match(spark, sf):
    q = _match(spark).where(F.col("text").rlike("[-']"))
    counts, _ = lexical.phrase_counts(q, lexical.positions_of(_chunks(spark, sf)))
    return counts.select("query_id", "phrase", "chunk_id", "f")


def _bm25(spark, sf):
    return lexical.bm25(_match(spark), lexical.build_index(_chunks(spark, sf)))


def bm25_chunks(spark, sf):
    return _bm25(spark, sf).select("query_id", "chunk_id", _r("score", 10).alias("score"))


def bm25_columns(spark, sf):
    s = lexical.bm25_columns(_match(spark), _docs(spark, sf), {"title": 1.2, "text": 0.75})
    return s.select("query_id", "id", _r("score", 9).alias("score"))


def _sparse_files(spark, sf):
    top = lexical.top_chunks(_bm25(spark, sf), 3 * RANK_LIMIT)
    hits = results.hydrate(top.drop("rank"), _chunks(spark, sf).select("chunk_id", "parent_file_id", "text"), _docs(spark, sf).drop("text"))
    return results.aggregate_sparse(hits)


def chunk_aggregate_sparse(spark, sf):
    f = _sparse_files(spark, sf)
    return f.select("query_id", "parent_file_id", "file_path", _r("best_score", 10).alias("best_score"), X.join_snippets(F.col("snippets")).alias("snippet"))


def _sparse(spark, sf):
    return results.sparse_results(results.normalize_inverted(_sparse_files(spark, sf), RANK_LIMIT))


def bm25_search(spark, sf):
    return _sparse(spark, sf).select("query_id", "id", "file_path", "title", "snippet", _r("score").alias("score"), "rank")


flagship = bm25_search


# --- vectors ---------------------------------------------------------------------


def cosine_topk(spark, sf):
    k = vectors.exact_knn(_every_hundredth(spark, sf), _vectors(spark, sf), 20)
    return k.select("query_id", "id", _r("score").alias("score"), "rank")


def cosine_threshold(spark, sf):
    k = vectors.exact_knn(_every_hundredth(spark, sf), _vectors(spark, sf), 50, 0.3)
    return k.select("query_id", "id", _r("score").alias("score"), "rank")


def l2_normalize_vectors(spark, sf):
    v = _vectors(spark, sf).select("chunk_id", l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("u"))
    return v.select("chunk_id", _r(F.element_at("u", 1)).alias("first"), _r(F.element_at("u", -1)).alias("last"))


def _lsh(spark, sf, config):
    v = _vectors(spark, sf)
    return v, vectors.lsh_buckets(v, config, 64)


def _recalling(spark, sf):
    return vectors.LshConfig.for_recall(_vectors(spark, sf).count(), 64)


def lsh_hash(spark, sf):
    n = _vectors(spark, sf)
    return vectors.lsh_hashes(n, vectors.LshConfig.for_size(500), 64)


def lsh_bucket_stats(spark, sf):
    _, b = _lsh(spark, sf, vectors.LshConfig.for_size(500))
    return vectors.lsh_stats(b).select("total_vectors", "num_tables", "buckets", _r("avg_bucket_size").alias("avg_bucket_size"))


def lsh_search(spark, sf):
    config = _recalling(spark, sf)
    v, b = _lsh(spark, sf, config)
    found = vectors.lsh_search(_every_hundredth(spark, sf), b, v, config, 64, 10)
    return found.select("query_id", "id", _r("score").alias("score"), "rank")


def dense_with_fallback(spark, sf):
    config = _recalling(spark, sf)
    v, b = _lsh(spark, sf, config)
    found = vectors.dense_search(_every_hundredth(spark, sf), b, v, config, 64, 10, 0.3)
    return found.select("query_id", "id", _r("score").alias("score"), "rank", "source")


def ivf_search(spark, sf):
    v = _vectors(spark, sf)
    centres = vectors.fit_cells(v, 20)
    cells = vectors.assign_cells(v, centres)
    return vectors.cell_search(_every_hundredth(spark, sf), cells, v, centres, 10, 15).select("query_id", "id", _r("score").alias("score"), "rank")


def _dense(spark, sf, queries):
    v = _vectors(spark, sf)
    found = vectors.exact_knn(queries, v, 60).select("query_id", F.col("id").alias("chunk_id"), "score")
    d = _docs(spark, sf)
    chunks = v.select("chunk_id", "parent_file_id", "embedding").join(d.select(F.col("id").alias("parent_file_id"), "text"), "parent_file_id")
    return results.aggregate_dense(results.hydrate(found, chunks, d.drop("text")), RANK_LIMIT)


def dense_hydrate(spark, sf):
    d = _dense(spark, sf, _numbered(spark, sf))
    return d.select("query_id", "id", "file_path", _r("score").alias("score"), F.md5("snippet").alias("snippet_md5"), "rank")


# --- ranking ----------------------------------------------------------------------


def minmax_norm(spark, sf):
    e = ranking.normalized(_t(spark, sf, "events"), "value", "event_type", "n")
    return e.select("event_id", _r("n").alias("norm"))


def zscore_norm(spark, sf):
    e = ranking.normalized(_t(spark, sf, "events"), "value", "event_type", "n", "z_score")
    return e.select("event_id", _r("n").alias("z"))


def _fused(spark, sf):
    """All match queries; those without a vector from the sparse side alone."""
    both = ranking.join_candidates(_sparse(spark, sf), _dense(spark, sf, _matched(spark, sf)))
    return ranking.fuse(both, _match(spark), AS_OF)


def fusion_rank(spark, sf):
    return _fused(spark, sf).select("query_id", "id", "title", _r("final_score").alias("final_score"), "rank")


def rrf_fusion(spark, sf):
    fused = ranking.reciprocal_ranks([_sparse(spark, sf), _dense(spark, sf, _matched(spark, sf))])
    return fused.select("query_id", "id", _r("score", 9).alias("score"), "rank")


def _mmr_pool(spark, sf):
    k = vectors.exact_knn(_every_hundredth(spark, sf), _vectors(spark, sf), 30)
    return k.join(_vectors(spark, sf).select(F.col("chunk_id").alias("id"), "embedding"), "id")


def mmr_diversify(spark, sf):
    return ranking.mmr(_mmr_pool(spark, sf), 0.7, 10).select("query_id", "id", "place")


def mmr_clamped(spark, sf):
    return ranking.mmr(_mmr_pool(spark, sf), 0.7, 10, clamped=True).select("query_id", "id", "place")


def rerank_blend(spark, sf):
    s = _sparse(spark, sf).join(F.broadcast(_match(spark).withColumnRenamed("text", "_q")), "query_id")
    r = ranking.rerank(s, overlap_scorer(F.col("_q"), F.col("snippet")), RANK_LIMIT, 10)
    return r.select("query_id", "id", _r("score").alias("score"), "rank")


def _files(spark, sf):
    return results.aggregate_files(_sparse(spark, sf), _match(spark))


def file_aggregate_highlight(spark, sf):
    f = _files(spark, sf)
    return f.select("query_id", "file_path", _r("best_score").alias("best_score"), F.array_join("snippets", "\n").alias("snippets"), "rank")


def post_filters(spark, sf):
    d = results.apply_filters(_docs(spark, sf), [("all",), ("type", "PDF"), ("dates", AS_OF - 500 * DAY_MS, AS_OF - 10 * DAY_MS)])
    return d.select("id", "file_type", "modified_at")


def query_filters(spark, sf):
    know = Q.understand(_values(spark, TEXT_QUERIES), AS_OF)
    d = _docs(spark, sf).crossJoin(F.broadcast(know.select("query_id")))
    return results.apply_query_filters(d, know).select("query_id", "id")


def dense_skip(spark, sf):
    s = ranking.skip_dense(_sparse(spark, sf), RANK_LIMIT)
    return s.select("query_id", "files", _r("top_score").alias("top_score"), "skipped")


# --- query understanding -------------------------------------------------------------


def _known(spark, sf):
    return Q.understand(_texts(spark, sf), AS_OF)


def query_normalize(spark, sf):
    return _known(spark, sf).select("query_id", "normalized", F.array_join("urls", "|").alias("urls"), F.array_join("emails", "|").alias("emails"))


def query_tokenize(spark, sf):
    k = _known(spark, sf).select("query_id", F.posexplode("tokens").alias("pos", "t"))
    return k.select("query_id", "pos", "t.text", "t.token_id", "t.is_stopword", "t.importance")


def query_key_terms(spark, sf):
    return _known(spark, sf).select("query_id", F.array_join("key_terms", " ").alias("key_terms"), F.array_join(X.fallback_tokens(F.col("text")), " ").alias("fallback"))


def query_entities(spark, sf):
    k = _known(spark, sf).select("query_id", F.posexplode("entities").alias("pos", "e"))
    return k.select("query_id", "pos", "e.text", "e.type", "e.value_str", "e.value_num", "e.confidence")


def query_expand(spark, sf):
    return _known(spark, sf).select(
        "query_id",
        F.array_join("original_terms", " ").alias("terms"),
        F.array_join(F.transform("expansions", lambda e: F.concat(e["term"], F.lit("="), e["expansion"])), ";").alias("expansions"),
        F.array_join(F.transform("synonyms", lambda s: F.concat(s["term"], F.lit("="), F.array_join(s["words"], ","))), ";").alias("synonyms"),
        F.array_join(F.array_sort("boosted"), ";").alias("boosted"),
        "filters.file_type",
        "filters.date_after",
        "filters.programming_language",
        "filters.user_owned",
    )


def query_bm25_text(spark, sf):
    return _known(spark, sf).select("query_id", "bm25_query", "dense_query")


def query_intent(spark, sf):
    k = _known(spark, sf)
    return k.select("query_id", "intent.intent", _r(F.col("intent.confidence").cast("double"), 4).alias("confidence"), "intent.reasoning")


def wordpiece_encode(spark, sf):
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "the", "##ing", "##tion", "th"]
    out = vocab.encode_wordpiece_windows(_t(spark, sf, "benchmark"), {w: i for i, w in enumerate(words)})
    return out.select("item_id", "window", "encoded.input_ids", "encoded.attention_mask")


# --- answers --------------------------------------------------------------------------


def rag_context(spark, sf):
    g = answers.gather_files(_files(spark, sf))
    ctx = answers.pack_context(F.col("snippets"), 5, 900)
    return g.select("query_id", F.size(ctx).alias("n_chunks"), F.md5(F.array_join(ctx, "\n")).alias("context_md5"), F.array_join(F.slice("paths", 1, 3), "|").alias("citations"))


def extractive_answer(spark, sf):
    c = _t(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("question", F.first("text").over(w)).withColumn("n", F.row_number().over(w)).where("n >= 2")
    c = c.groupBy("conv_id").agg(F.first("question").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("chunks"))
    a = answers.extractive_answer(F.col("chunks"), F.col("q"))
    return c.select("conv_id", a.alias("a")).select("conv_id", "a.answer", F.size("a.source_chunks").alias("n_sources"), "a.error")


def rag_envelope(spark, sf):
    return answers.answer(_files(spark, sf), _match(spark)).select("query_id", "answer", "error", F.array_join("citations", "|").alias("citations"))


def rag_prompt(spark, sf):
    g = answers.gather_files(_files(spark, sf)).join(_match(spark), "query_id")
    return g.select("query_id", F.md5(answers.prompt(F.col("snippets"), F.col("text"))).alias("prompt_md5"))


# --- evaluation, telemetry, index ---------------------------------------------------------


def map_eval(spark, sf):
    v = _vectors(spark, sf)
    found = vectors.exact_knn(_every_hundredth(spark, sf), v, 50).select("query_id", F.col("id").cast("string").alias("file_path"), "rank")
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "label")
    rel = v.select(F.col("chunk_id").cast("string").alias("file_path"), "label").join(F.broadcast(q), "label").select("query_id", "file_path")
    return evaluation.mean_average_precision(found, rel).select(_r("map").alias("map"), "n_queries")


def average_precision(spark, sf):
    v = _vectors(spark, sf)
    found = vectors.exact_knn(_every_hundredth(spark, sf), v, 50).select("query_id", F.col("id").cast("string").alias("file_path"), "rank")
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "label")
    rel = v.select(F.col("chunk_id").cast("string").alias("file_path"), "label").join(F.broadcast(q), "label").select("query_id", "file_path")
    return evaluation.average_precision(found, rel).select("query_id", _r("ap").alias("ap"))


def _metrics(spark, sf):
    e = _t(spark, sf, "events")
    total = F.floor(F.col("value")).cast("long")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("query"),
        total.alias("total_ms"),
        F.floor(total / 4).alias("bm25_ms"),
        F.floor(total / 5).alias("dense_ms"),
        F.floor(total / 10).alias("fusion_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("final_count"),
        (F.col("user_id") % 300).alias("memory_mb"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )


def telemetry_recent(spark, sf):
    return evaluation.recent(_metrics(spark, sf)).select("seq", "query", "total_ms", "ts")


def telemetry_summary(spark, sf):
    p = evaluation.performance(evaluation.recent(_metrics(spark, sf)))
    fine = {"avg_latency", "p95_latency", "query_processing", "bm25", "dense", "fusion", "reranking", "total"}
    return p.select(*[_r(c).alias(c) if c in fine else c for c in p.columns])


def perf_lines(spark, sf):
    m = _metrics(spark, sf).withColumns({"bm25_count": F.col("seq") % 7, "dense_count": F.col("seq") % 5, "memory_before_mb": F.col("memory_mb") - 1})
    return m.select("seq", evaluation.perf_line().alias("line"))


def index_health(spark, sf):
    return evaluation.index_health(_docs(spark, sf), _chunks(spark, sf))


def _scanned(spark, sf):
    """The documents as a later scan finds them: some new, some touched, some broken."""
    d = _docs(spark, sf).withColumn("body", F.when(F.col("id") % 11 != 0, F.col("text")))
    return d.withColumn("modified_at", F.col("modified_at") + F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).otherwise(0))


def _stored(spark, sf):
    return _docs(spark, sf).where("id % 5 <> 0")


def index_counters(spark, sf):
    return files.index_counters(files.classify_changes(_scanned(spark, sf), _stored(spark, sf)))


def incremental_upsert(spark, sf):
    changed = files.classify_changes(_scanned(spark, sf), _stored(spark, sf)).where("status <> 'skipped' and body is not null")
    cols = ["id", "file_path", "modified_at", "size_bytes"]
    return catalog.upsert(_stored(spark, sf).select(cols), changed.select(cols))


def delete_by_path(spark, sf):
    d = _docs(spark, sf)
    return catalog.delete_by(d, d.where("id % 4 = 0").select("file_path"), "file_path").select("id", "file_path")


def postings_delta(spark, sf):
    c = _chunks(spark, sf)
    old = lexical.positions_of(c.where("parent_file_id % 2 = 0"))
    removed = c.where("parent_file_id % 6 = 0").select("chunk_id")
    new = lexical.postings_delta(old, removed, c.where("parent_file_id % 2 <> 0"))
    return lexical.vocabulary_of(new)


def html_parse(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(files.html_text(F.col("html"))).alias("text_md5"))


def embedding_page(spark, sf):
    return vectors.page(_vectors(spark, sf), 100, 150).select("chunk_id", "label")


def format_columns(spark, sf):
    d = _docs(spark, sf)
    n, m = F.col("size_bytes") * 977, F.col("modified_at")
    score = (F.col("id") % 101) / 100
    return d.select(
        "id",
        X.card_size(F.col("size_bytes") * 331 - 5000).alias("card_size"),
        X.file_size(n).alias("file_size"),
        X.card_date(m).alias("card_date"),
        X.full_date(F.when(F.col("id") % 9 == 0, 0).otherwise(m)).alias("full_date"),
        X.clock_time(m + F.col("id") * 1000).alias("clock"),
        X.percent_score(score).alias("percent"),
        X.decimal_score(score).alias("decimal"),
        X.latency_band(F.col("id") % 600).alias("band"),
        X.is_relevant(score).alias("relevant"),
        X.render_bold(F.concat(F.lit("a **"), "title", F.lit("** b..."))).alias("bold"),
        X.cache_key(F.concat(F.lit("  "), "title", F.lit(" "))).alias("key"),
    )


def hybrid_search(spark, sf):
    """The whole read path on understood queries with the hashed encoder."""
    d, c = _docs(spark, sf).drop("text"), _chunks(spark, sf)
    enc = vectors.hashed_encoder(64)
    engine = SearchEngine.from_tables(d, vectors.encode(c, enc), DEFAULTS.update(dim=64, sparse_limit=RANK_LIMIT), encoder=enc, scorer=overlap_scorer)
    found = engine.search(_match(spark))
    # The engine's kept tables go when the session clears its cache; the result is recomputed without them if need be.
    return found.select("query_id", "id", "file_path", _r("best_score").alias("best_score"), "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        chunk_documents, chunk_backfill, word_tokens_vocab, corpus_stats, fts_query_build, fts_prefix_match, fts_phrase_match,
        bm25_chunks, bm25_columns, chunk_aggregate_sparse, bm25_search, cosine_topk, cosine_threshold, l2_normalize_vectors,
        lsh_hash, lsh_bucket_stats, lsh_search, dense_with_fallback, ivf_search, dense_hydrate, minmax_norm, zscore_norm,
        fusion_rank, rrf_fusion, mmr_diversify, mmr_clamped, rerank_blend, file_aggregate_highlight, post_filters,
        query_filters, dense_skip, query_normalize, query_tokenize, query_key_terms, query_entities, query_expand,
        query_bm25_text, query_intent, wordpiece_encode, rag_context, extractive_answer, rag_envelope, rag_prompt, map_eval,
        average_precision, telemetry_recent, telemetry_summary, perf_lines, index_health, index_counters, incremental_upsert,
        delete_by_path, postings_delta, html_parse, embedding_page, format_columns, hybrid_search,
    )
    return {f.__name__: f for f in found}
