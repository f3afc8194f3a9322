"""Registered queries do the whole job: no input row, query or result is left out."""

import math

import numpy as np
import pytest
import regex

from skerry import queries as core
from skerry.functions.query import understand
from skerry.functions.text import ACCENTED, PLAIN
from skerry.operators.vectors import hashed_encoder
from skerry.queries_sql import RANK_LIMIT
from skerry.sources import vocab


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_hash_search_recall(spark, small, sf):
    path = small.replace("sf0.001", sf)
    exact = pairs(core.cosine_topk(spark, path).where("rank <= 10"))
    assert len(exact & pairs(core.lsh_search(spark, path))) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_dense_search_finds_all_rows(spark, small, sf):
    path = small.replace("sf0.001", sf)
    exact = pairs(core.cosine_threshold(spark, path).where("rank <= 10"))
    found = pairs(core.dense_with_fallback(spark, path))
    assert len(exact & found) >= 0.9 * len(exact) and (0, 0) in found


def test_query_filters_cover_all_documents(spark, small):
    ids = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = pairs(core.query_filters(spark, small))
    # Query 3 names neither type nor date, query 2 names pdf and yesterday.
    assert {i for q, i in got if q == 3} == ids and {i for q, i in got if q == 2} < ids


def test_dense_and_fused_results_of_all_queries(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 100 = 0").count()
    dense = {r.query_id for r in core.dense_hydrate(spark, small).collect()}
    assert dense == set(range(vectors))
    sparse = {r.query_id for r in core.bm25_search(spark, small).collect()}
    want = sparse | {q for q in dense if 1 <= q <= len(core.MATCH_QUERIES)}
    assert sparse - dense
    for query in (core.fusion_rank, core.rrf_fusion):
        assert {r.query_id for r in query(spark, small).collect()} == want


def test_wordpiece_encodes_whole_texts(spark, small):
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "the", "##ing", "##tion", "th"]
    ids = {w: i for i, w in enumerate(words)}
    got = {}
    for r in core.wordpiece_encode(spark, small).orderBy("item_id", "window").collect():
        n = sum(r.attention_mask)
        assert len(r.input_ids) == 128 and r.input_ids[0] == 2 and r.input_ids[n - 1] == 3 and not any(r.input_ids[n:])
        got.setdefault(r.item_id, []).extend(r.input_ids[1 : n - 1])
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        whole, mask = vocab.wordpiece(r.text, ids, 1 << 16)
        assert got[r.item_id] == whole[1 : sum(mask) - 1]


def test_answers_from_late_turns(spark, tmp_path):
    turns = ["where is the zebra", *["nothing of that"] * 8, "the zebra is in the ninth turn"]
    rows = [(1, i, "user", x) for i, x in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = core.extractive_answer(spark, str(tmp_path)).first()
    assert "ninth turn" in got.answer and got.error is None


def test_postings_delta_reads_all_documents(spark, small):
    from skerry.operators import lexical

    left = lexical.vocabulary_of(lexical.positions_of(core._chunks(spark, small).where("parent_file_id % 6 <> 0")))
    assert sorted(map(tuple, core.postings_delta(spark, small).collect())) == sorted(map(tuple, left.collect()))


def bm25_plain(text, chunks):
    """(score, chunk) of the chunks that have every prefix phrase of a query, the lower the better."""
    lists = {c: regex.findall(r"[\p{L}\p{N}]+", t.lower().translate(str.maketrans(ACCENTED, PLAIN))) for c, t in chunks.items()}
    n, avg = len(lists), sum(map(len, lists.values())) / len(lists)
    parts = []
    for token in text.split():
        ws = regex.findall(r"[\p{L}\p{N}]+", token.lower().translate(str.maketrans(ACCENTED, PLAIN)))
        m, f = len(ws), {}
        for c, have in lists.items():
            k = sum(have[i : i + m - 1] == ws[:-1] and have[i + m - 1].startswith(ws[-1]) for i in range(len(have) - m + 1)) if m else 0
            if k:
                f[c] = k
        raw = math.log((n - len(f) + 0.5) / (len(f) + 0.5))
        parts.append({c: (raw if raw > 0 else 1e-6) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(lists[c]) / avg)) for c, k in f.items()})
    both = set.intersection(*map(set, parts)) if parts else set()
    return sorted((-sum(p[c] for p in parts), c) for c in both)


def spread_plain(values, flat):
    lo, hi = min(values), max(values)
    return [(v - lo) / (hi - lo) if hi > lo else flat for v in values]


def hybrid_plain(know, docs, chunks, parent, encode):
    """One query through all steps of the read path: [(id, score)] in order."""
    best = {}
    for s, c in bm25_plain(know.bm25_query, chunks)[: 3 * RANK_LIMIT]:
        best.setdefault(parent[c], s)
    files = sorted((s, d) for d, s in best.items())
    hi, lo = (files[-1][0], files[0][0]) if files else (0, 0)
    sparse = {d: (hi - s) / (hi - lo) if hi > lo else 1.0 for s, d in files[:RANK_LIMIT]}
    dense, vec = {}, {}
    if not (len(sparse) >= 50 and max(sparse.values()) >= 0.85):
        ids = sorted(chunks)
        m = encode([chunks[c] for c in ids]).astype(np.float32).astype(float)
        q = encode([know.dense_query])[0].astype(np.float32).astype(float)
        norm = np.sqrt((m * m).sum(axis=1)) * (np.sqrt(q @ q) or 1)
        cos = np.round(np.divide(m @ q, norm, out=np.zeros(len(m)), where=norm > 0), 12)
        for s, c in sorted((-s, c) for s, c in zip(cos, ids) if s >= 0.3)[:150]:
            if parent[c] not in dense:
                dense[parent[c]], vec[parent[c]] = -s, m[ids.index(c)]
        dense = dict(sorted(dense.items(), key=lambda x: (-x[1], x[0]))[:50])
    cand = sorted({*sparse, *dense})
    if not cand:
        return []
    s = spread_plain([sparse.get(d, 0) for d in cand], 0.5)
    v = spread_plain([dense.get(d, 0) for d in cand], 0.5)
    r = spread_plain([math.exp(-max(0, core.AS_OF - docs[d].modified_at) / 86_400_000 / 30) for d in cand], 0.5)
    score = {}
    for d, a, b, c in zip(cand, s, v, r):
        named = know.normalized.strip() and know.normalized.lower() in docs[d].title.lower()
        boost = 1.1 if docs[d].file_type in ("pdf", "txt", "md") else 0.9 if docs[d].file_type == "png" else 1.0
        score[d] = (0.45 * a + 0.35 * b + 0.10 * c + (0.10 if named else 0)) * boost
    order = sorted(cand, key=lambda d: (-score[d], d))

    def sim(x, y):
        if x not in vec or y not in vec:
            return 0.0
        n = math.sqrt(vec[x] @ vec[x]) * math.sqrt(vec[y] @ vec[y])
        return float(vec[x] @ vec[y]) / n if n else 0.0

    taken, left = [order[0]], order[1:]
    while left and len(taken) < 20:
        pick = max(left, key=lambda d: (0.7 * score[d] - (1 - 0.7) * max(sim(d, t) for t in taken), -left.index(d)))
        taken.append(pick)
        left.remove(pick)
    vec = {d: vec[d] for d in dense}
    f = know.filters
    fits = [d for d in sorted(taken, key=lambda d: (-score[d], d))]
    ranks = {d: i + 1 for i, d in enumerate(fits)}
    fits = [d for d in fits if (f.file_type is None or docs[d].file_type == f.file_type.lower()) and (f.date_after is None or f.date_after <= docs[d].modified_at <= (f.date_before or 1 << 62))]
    return [(d, round(score[d], 6), ranks[d]) for d in fits]


def test_hybrid_search_against_plain_steps(spark, small):
    docs = {r.id: r for r in core._docs(spark, small).collect()}
    rows = core._chunks(spark, small).collect()
    chunks, parent = {r.chunk_id: r.text for r in rows}, {r.chunk_id: r.parent_file_id for r in rows}
    asked = core._match(spark).where("trim(text) <> ''")
    want = set()
    for know in understand(asked, core.AS_OF).collect():
        want |= {(know.query_id, d, s, k) for d, s, k in hybrid_plain(know, docs, chunks, parent, hashed_encoder(64))}
    got = {(r.query_id, r.id, r.best_score, r.rank) for r in core.hybrid_search(spark, small).collect()}
    assert len(got) == len(want) > 20
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 2e-6
