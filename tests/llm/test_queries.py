"""Registered queries against SQL and against plain versions, and the pipeline."""

import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import queries
from skerry.llm.common import shared_dir, table
from skerry.llm.quality import _cuts, quality_rules
from skerry.llm.tokens import engine, tokenizer_path

from .helpers import ODD, lower_ascii, words
from .helpers import table as small_table
from .test_dedup import fingerprint_plain, groups_plain, substring_plain
from .test_packing import best_fit_plain, plain_ids
from .test_scoring import base_plain


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for name in os.listdir(small):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return c


def comparable(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, small, duck, name):
    df = queries.queries()[name](spark, small)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert comparable(tuple(map(str, r)) for r in df.select(cols).collect()) == comparable(tuple(map(str, r)) for r in want.select(*cols).fetchall())


def test_substring_query_is_whole(spark, small):
    docs = table(spark, small, "documents").collect()
    got = queries.op2_substring_dedup(spark, small).collect()
    assert sorted((tuple(r) for r in got), key=str) == substring_plain([(r.doc_id, r.text) for r in docs])


def test_simhash_query_is_whole(spark, small):
    docs = table(spark, small, "documents").collect()
    codes = [fingerprint_plain(r.text) for r in docs]
    want = zip((r.doc_id for r in docs), (f"{c:016x}" for c in codes), groups_plain([r.doc_id for r in docs], codes))
    assert sorted(map(tuple, queries.op6_simhash(spark, small).collect())) == sorted(want)


def test_toxicity_query(spark, small):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, small).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, small, "labels").collect()}
    assert len(got) == table(spark, small, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(got[i].predicted == y for i, y in labels.items()) / len(labels) > 0.85


def perplexity_plain(texts, halves):
    """Negative log probability of each text per word, by a dictionary of 5-grams of the other half's code points."""
    fold = lambda t: "".join("0" if c in "0123456789" else " " if c in "\t\n\x0b\x0c\r" else c.lower() if len(c.lower()) == 1 else c for c in t)
    framed = ["\x00" * 4 + fold(t).replace("\x00", "\x01") + "\x00" for t in texts]
    level = [{5: Counter()}, {5: Counter()}]
    for t, h in zip(framed, halves):
        level[h][5].update(t[i : i + 5] for i in range(len(t) - 4))
    size = len({g[-1] for h in (0, 1) for g in level[h][5]}) + 1
    cut, seen, left = [{}, {}], [defaultdict(int), defaultdict(int)], [defaultdict(float), defaultdict(float)]
    for h in (0, 1):
        for m in (4, 3, 2, 1):
            level[h][m] = Counter(g[1:] for g in level[h][m + 1])
        for m in range(1, 6):
            cut[h][m] = _cuts(*(sum(n == i for n in level[h][m].values()) for i in (1, 2, 3, 4)))
            for g, n in level[h][m].items():
                seen[h][g[:-1]] += n
                left[h][g[:-1]] += cut[h][m][min(n, 3)]
    known = [{"": 1 / size}, {"": 1 / size}]

    def prob(h, g):
        if g not in known[h]:
            lower, n = prob(h, g[1:]), level[h][len(g)].get(g, 0)
            known[h][g] = (n - cut[h][len(g)][min(n, 3)] + left[h][g[:-1]] * lower) / seen[h][g[:-1]] if seen[h][g[:-1]] else lower
        return known[h][g]

    return [-sum(math.log(prob(1 - h, t[i : i + 5])) for i in range(len(t) - 4)) / max(len(words(x)), 1) for x, t, h in zip(texts, framed, halves)]


def test_quality_query_against_a_plain_model(spark, small):
    rows = table(spark, small, "documents").select("doc_id", "text", "lang", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()
    nll = perplexity_plain([r.text for r in rows], [r.half for r in rows])
    got = {r.doc_id: r for r in queries.op10_quality_perplexity(spark, small).collect()}
    assert len(got) == len(rows)
    passed = defaultdict(list)
    for r, x in zip(rows, nll):
        assert got[r.doc_id].nll == pytest.approx(x, rel=1e-5)
        failed = base_plain(r.text)[-1]
        assert got[r.doc_id].base_failed == failed
        if not failed:
            passed[r.lang].append(x)
    middle = lambda v: sorted(v)[-(-len(v) // 2) - 1]
    center = {k: middle(v) for k, v in passed.items()}
    reach = {k: max(5 * 1.4826 * middle([abs(x - center[k]) for x in v]), 0.5) for k, v in passed.items()}
    for r, x in zip(rows, nll):
        off = abs(x - center[r.lang]) / (reach[r.lang] * math.sqrt(1 + 800 / max(len(r.text.encode()), 1)))
        if abs(off - 1) > 1e-3:
            assert got[r.doc_id].kept == (off < 1 and not got[r.doc_id].base_failed)
    assert sum(not g.kept and not g.base_failed for g in got.values()) > 0


def test_packing_queries_are_whole(spark, small):
    """Pieces, checksums and the number of sequences, from the tokenizer itself."""
    docs = table(spark, small, "documents").collect()
    want, lengths = {}, Counter()
    for r in docs:
        ids, at = plain_ids(r.text), 0
        head = len(ids) % 2048 or 2048
        for k, end in enumerate(range(head, len(ids) + 1, 2048) if len(ids) > 2048 else [len(ids)]):
            want[r.doc_id, k] = (at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes()))
            lengths[end - at] += 1
            at = end
        assert at == len(ids)
    got = queries.op8_best_fit(spark, small).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(filled) <= best_fit_plain(list(lengths.elements()), 2048)
    rows = queries.op7_token_matrices(spark, small).collect()
    assert len(rows) == best_fit_plain(list(lengths.elements()), 2048)
    assert Counter((d, s, b - a) for r in rows for d, s, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:])) == Counter((d, s, n) for (d, _), (s, n, _) in want.items())


def test_stages_on_odd_rows(spark, tmp_path):
    docs = small_table(spark, [*ODD, *[(100 + i, f"steady text number {i} of some words that a quality rule should keep in any case {i}") for i in range(30)]])
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    empty = small_table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0
        empty = empty if out.columns != empty.columns else out.limit(0)


def test_pipeline_against_plain_stages(spark, small):
    """Every stage by a plain version, on what the one before kept."""
    docs = table(spark, small, "documents").collect()
    marks = {r.doc_id: r.kept for r in quality_rules(table(spark, small, "documents")).collect()}
    left = [r for r in docs if marks[r.doc_id]]
    last = {}
    for r in left:
        k = lower_ascii(r.text)
        last[k] = max(last.get(k, r.doc_id), r.doc_id)
    left = [r for r in left if last[lower_ascii(r.text)] == r.doc_id]
    comps = groups_plain([r.doc_id for r in left], [fingerprint_plain(r.text) for r in left])
    left = [r for r, c in zip(left, comps) if r.doc_id == c]

    import hashlib

    from .test_scoring import targets_plain

    size = {r.doc_id: len(words(r.text)) for r in left}
    per = defaultdict(int)
    for r in left:
        per[r.source] += size[r.doc_id]
    target = targets_plain(per)
    copies = {}
    for r in left:
        rate = target[r.source] / per[r.source]
        u = int(hashlib.md5(f"17|{r.doc_id}|".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies[r.doc_id] = int(rate) + (u < rate - int(rate))
    enc = engine(tokenizer_path())
    want = Counter()
    for r in left:
        n = len(enc.ids(r.text)) + 1
        want[r.doc_id] += n * copies[r.doc_id]

    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    first, got = corpus_pipeline.run(spark, small), corpus_pipeline.run(spark, small)
    left = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before
    assert len(left) == 2 and all(x.endswith("-packed") for x in left)
    got = got.collect()
    assert first.count() == len(got)
    have = Counter()
    seq = defaultdict(list)
    for r in got:
        have[r.doc_id] += r.length
        seq[r.sequence_id].append((r.offset, r.length))
    assert have == Counter({d: n for d, n in want.items() if n})
    for parts in seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    total = sum(have.values())
    assert len(seq) <= -(-total // 2048) + 1


def test_all_names_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
