"""Exact, near, substring and line deduplication against plain versions."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from skerry.llm import exact, lines, simhash, substring
from skerry.llm.components import checksum, components

from .helpers import LONG, ODD, PASSAGE, lower_ascii, table, words


def exact_plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower_ascii(t), []).append(d)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_odd_rows(spark):
    assert rows_of(exact.exact_dedup(table(spark, ODD))) == exact_plain([r[:2] for r in ODD])


def test_exact_texts_of_one_digest_stay_apart(spark):
    rows = [(i, t) for i, t in enumerate(["a", "A", "b", "c", "B", "", None, "dd", "a"])]
    for share in (1e-4, 2.0):
        short = exact.exact_dedup(table(spark, rows), hot_share=share, digest=lambda c: F.lit("same"))
        assert rows_of(short) == exact_plain(rows)


def test_exact_hot_group_and_empty_table(spark):
    rows = [(i, "HOT copy" if i % 3 else f"text {i}") for i in range(600)]
    assert rows_of(exact.exact_dedup(table(spark, rows).repartition(16))) == exact_plain(rows)
    assert exact.exact_dedup(table(spark, [])).count() == 0
    assert exact.drop_exact_copies(table(spark, [])).count() == 0


def test_drop_exact_copies(spark):
    kept = exact.drop_exact_copies(table(spark, ODD))
    assert kept.columns == table(spark, ODD).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = {}
    for d, t in [r[:2] for r in ODD]:
        k = lower_ascii(t)
        if k not in want or (d is not None and (want[k][0] is None or d > want[k][0])):
            want[k] = (d, t)
    assert sorted((d for d, _ in got), key=str) == sorted((d for d, _ in want.values()), key=str)
    plain = [(1, "a"), (2, "A"), (3, "b")]
    assert sorted(r.doc_id for r in exact.drop_exact_copies(table(spark, plain)).collect()) == [2, 3]


def fingerprint_plain(text):
    w = words(lower_ascii(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups_plain(ids, codes):
    """Smallest id that links of three bits or fewer reach."""
    best = dict.fromkeys(range(len(codes)))
    seen = set()
    for i in range(len(codes)):
        if i in seen:
            continue
        reach, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in range(len(codes)):
                if b not in reach and bin(codes[a] ^ codes[b]).count("1") <= 3:
                    reach.add(b)
                    todo.append(b)
        seen |= reach
        known = [ids[x] for x in reach if ids[x] is not None]
        for x in reach:
            best[x] = min(known) if known else None
    return [best[i] for i in range(len(codes))]


def test_simhash_odd_rows(spark):
    rows = [r[:2] for r in ODD] + [(100 + i, LONG + f" end{i}") for i in range(20)]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(table(spark, rows)).collect()), key=str)
    codes = [fingerprint_plain(t) for _, t in rows]
    comps = groups_plain([d for d, _ in rows], codes)
    assert got == sorted(((d, f"{c:016x}", k) for (d, _), c, k in zip(rows, codes, comps)), key=str)
    assert simhash.simhash_groups(table(spark, [])).count() == 0


def test_drop_near_copies(spark):
    rows = [(5, LONG), (3, LONG + " more"), (9, "one two three four"), (None, "")]
    kept = simhash.drop_near_copies(table(spark, rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 9, None]


def test_drop_near_copies_judges_rows_not_ids(spark):
    a, b = "alpha beta gamma delta epsilon", "one two three four five six"
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in simhash.drop_near_copies(table(spark, rows)).collect()), key=str)
    assert kept([(5, a), (5, b), (3, b)]) == [(3, b), (5, a)]
    assert kept([(5, a), (5, a), (5, a), (5, b)]) == [(5, a), (5, b)]
    assert kept([(None, a), (None, a), (None, b), (7, b), (8, None), (9, "")]) == [(7, b), (8, None), (None, a)]
    df = table(spark, [])
    out = simhash.drop_near_copies(df)
    assert out.count() == 0 and out.columns == df.columns


def test_checksum_does_not_overflow(spark):
    a, b = (spark.range(n, numPartitions=8).select("id").agg(*checksum("id")).first() for n in (1 << 25, (1 << 25) - 1))
    assert a.n == 1 << 25 and (a.n, a.s) != (b.n, b.s)


def test_gray_rank_orders_neighbours_by_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(bin(int(a ^ b)).count("1") == 1 for a, b in zip(order, order[1:]))


def test_gray_index_finds_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (12, 2))]]))
    group = (codes % np.uint64(3)).astype(np.int64)
    index = simhash.GrayIndex(group, codes, fanout=4)
    found = {(min(int(index.code[i]), int(index.code[j])), max(int(index.code[i]), int(index.code[j]))) for a, b in index.links(3, budget=64) for i, j in zip(a, b)}
    want = {(int(a), int(b)) for x, a in enumerate(codes) for b in codes[x + 1 :] if group[x] == int(b) % 3 and bin(int(a) ^ int(b)).count("1") <= 3}
    assert found == want and want


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(200)}
    codes |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for c in list(codes) for _ in range(3)}
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    df = spark.createDataFrame(signed, "fp long")
    plain, split = (sorted(map(tuple, components(simhash.linked_codes(df, hot_bucket=n)).collect())) for n in (1 << 18, 60))
    ordered = sorted(x for (x,) in signed)
    label = dict(zip(ordered, ordered))
    comps = groups_plain(ordered, [x & ((1 << 64) - 1) for x in ordered])
    assert plain == split == sorted((n, c) for n, c in zip(ordered, comps) if n != c)
    assert label


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def substring_plain(rows, length=13):
    first = {}
    for d, t in rows:
        if d is None:
            continue
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_odd_rows(spark):
    rows = [r[:2] for r in ODD]
    assert rows_of(substring.substring_dedup(table(spark, ODD))) == substring_plain(rows)
    assert substring.substring_dedup(table(spark, [])).count() == 0


def test_substring_random_passages(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    pool = [" ".join(rng.choices(vocab, k=rng.choice([12, 13, 14, 40]))) for _ in range(6)]
    rows = []
    for d in range(80):
        parts = [rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choices(vocab, k=rng.randint(1, 20))) for _ in range(rng.randint(1, 6))]
        rows.append((rng.randint(0, 60), " ".join(parts)))
    rows += [(99, "same " * 40), (98, "same " * 30), (97, "same " * 12)]
    assert rows_of(substring.substring_dedup(table(spark, rows))) == substring_plain(rows)
    assert rows_of(substring.substring_dedup(table(spark, rows), hot_rows=0)) == substring_plain(rows)


def thue_morse(n=2048):
    """Two words that polynomial hashes modulo powers of two can't tell apart."""
    t = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_substring_tells_structured_words_apart(spark):
    x, y = thue_morse()
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{x} {same}"), (4, f"{y} {same}"), (5, f"{x} {same}")]
    rows += [(10, " ".join([x, y] * 10)), (11, " ".join([y, x] * 10 + [x]))]
    assert rows_of(substring.substring_dedup(table(spark, rows))) == substring_plain(rows)


def test_substring_text_is_returned_on_request(spark):
    rows = [(1, PASSAGE), (2, f"new {PASSAGE} end")]
    got = {r.doc_id: r.kept_text for r in substring.substring_dedup(table(spark, rows), with_text=True).collect()}
    assert got == {1: PASSAGE, 2: "new end"}


def lines_plain(rows, min_sites):
    trim = " \t\x0b\x0c\r"
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(trim) and s is not None:
                sites.setdefault(x.strip(trim), set()).add(s)
    out = []
    for d, t, _ in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not x.strip(trim) or len(sites.get(x.strip(trim), ())) < min_sites]
        out.append((d, sum(bool(x.strip(trim)) for x in all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_near_and_far_from_the_threshold(spark):
    rows = [(100 * n + s, f"on {n} sites\n  on {n} sites\t\nown {n} {s}\n\n", f"site{s}") for n in (1, 4, 5, 6, 9, 40) for s in range(n)]
    rows += [(1, None, "site1"), (2, "", None), (3, "on 5 sites", None), (None, "on 9 sites\nx", "site1"), (3, "on 5 sites", None)]
    df = table(spark, rows)
    assert rows_of(lines.remove_boilerplate(df)) == lines_plain(rows, 5)
    assert rows_of(lines.remove_boilerplate(df, min_sites=40, lg_k=4)) == rows_of(lines.remove_boilerplate(df, min_sites=40)) == lines_plain(rows, 40)
    assert rows_of(lines.remove_boilerplate(df, max_sent=1)) == lines_plain(rows, 5)
    assert lines.remove_boilerplate(table(spark, [])).count() == 0
