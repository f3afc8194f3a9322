"""Bin packing, tokens and the packed outputs."""

import functools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import bestfit, binary, packing, tokens

from .helpers import ODD, table


def n_bins(bins, counts, capacity):
    """Checks that bins hold exactly the items and returns their number."""
    held = Counter()
    for pattern, n in bins:
        assert n > 0 and sum(x * k for x, k in pattern) <= capacity
        for x, k in pattern:
            held[x] += k * n
    assert held == Counter({x: c for x, c in counts.items() if c})
    return sum(n for _, n in bins)


def best_fit_plain(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                k = rooms.index(r)
                rooms[k] -= items[i]
                place(i + 1, rooms)
                rooms[k] += items[i]
        rooms.append(capacity - items[i])
        place(i + 1, rooms)
        rooms.pop()

    place(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=30))))
def test_best_fit_decreasing_by_histogram_is_that_by_items(case):
    capacity, items = case
    counts = Counter(items)
    assert n_bins(packing.best_fit_decreasing(counts, capacity), counts, capacity) == best_fit_plain(items, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 50).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(max(1, c // 5), c), max_size=9))))
def test_reduction_keeps_the_optimum(case):
    capacity, items = case
    fixed, rest = packing.dominance_reduction(Counter(items), capacity)
    left = [x for x, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + optimum(left, capacity) == optimum(items, capacity)
    n_bins(packing.pack(Counter(items), capacity), Counter(items), capacity)


def test_packing_of_huge_counts_is_quick():
    rng = random.Random(1)
    counts = {x: rng.randint(10**8, 10**10) for x in range(1, 2049)}
    bins = packing.pack(counts, 2048)
    n = n_bins(bins, counts, 2048)
    low = max(-(-sum(x * c for x, c in counts.items()) // 2048), sum(c for x, c in counts.items() if x > 1024))
    assert n <= low * 1.02 and len(bins) < 50_000  # the bound by tokens and large items is not tight
    counts = {x: 10**9 for x in range(600, 1500)}
    n_bins(packing.pack(counts, 2048), counts, 2048)


def test_capacity_tree():
    t = packing.CapacityTree(10)
    for room in (3, 7, 10):
        t.add(room, 1)
    assert [t.at_least(x) for x in (0, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    t.add(10, -1)
    assert t.at_least(8) is None and t.at_least(11) is None


def test_pieces():
    assert tokens.pieces(5, 10) == [(0, 5)]
    assert tokens.pieces(20, 10) == [(0, 10), (10, 10)]
    assert tokens.pieces(23, 10) == [(0, 3), (3, 10), (13, 10)]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = ["", "plain words", "a <|endoftext|>is one id<|endoftext|>", "<|endoftext", "a\n" + " " * 1_000_000 + "b", "\n" * 1_000_000, " \t" * 20_000 + "x", "tabs\t\tand   spaces\n\n\nend  ", "naïve 漢字 🎉 ​", "x" * 5000, "12345 6789 it's we'll"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_tokenizer(text):
    assert [*next(tokens.token_ids([text], tokens.tokenizer_path())), 0] == plain_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    assert [*next(tokens.token_ids([text], tokens.tokenizer_path())), 0] == plain_ids(text)


def test_best_fit_packing_round_trip(spark):
    rows = [r[:2] for r in ODD if r[0] != 5] + [(20, "x" * 5000), (21, "naïve 漢字 🎉"), (22, TEXTS[2]), (23, "\n" * 1_000_000)]
    rows = [(d, t) for d, t in rows if d is not None]
    got = bestfit.best_fit_packing(table(spark, rows), tokens.tokenizer_path(), sent_parts=0).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in rows}
    for d, t in rows:
        ids, at = plain_ids(t), 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            part = ids[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.array(part, "<u4").tobytes()))
            assert len(by_doc[d]) == 1 or k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) == -(-sum(r.length for r in got) // 2048)


def test_best_fit_packing_of_null_ids_repeats_and_nothing(spark):
    rows = [(None, "a b c"), (None, None), (5, "same"), (5, "same")]
    got = bestfit.best_fit_packing(table(spark, rows), tokens.tokenizer_path()).collect()
    assert len(got) == 4 and sorted(str(r.doc_id) for r in got) == ["5", "5", "None", "None"]
    assert len({(r.sequence_id, r.offset) for r in got}) == 4
    assert bestfit.best_fit_packing(table(spark, []), tokens.tokenizer_path()).count() == 0


def test_token_matrices_round_trip(spark, tmp_path):
    rows = [(d, t) for d, t in (r[:2] for r in ODD) if d not in (None, 5)] + [(20, "x" * 5000), (21, TEXTS[2])]
    rows += [(100 + i, f"short text {i} " * (i % 40)) for i in range(3000)]
    path = str(tmp_path / "parquet")
    binary.write_packed(binary.pack_token_ids(table(spark, rows), tokens.tokenizer_path()), path)
    got = spark.read.parquet(path).collect()
    docs, seen, lengths = defaultdict(dict), set(), Counter()
    for r in got:
        m = np.frombuffer(r.input_ids, "<u2")
        assert len(m) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not m[r.n_tokens :].any()
        assert r.position_resets == r.cu_seqlens[:-1] and r.sequence_id not in seen
        seen.add(r.sequence_id)
        for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.piece_starts):
            docs[d][s] = m[a:b].tolist()
            lengths[b - a] += 1
    for d, t in rows:
        assert [i for s in sorted(docs[d]) for i in docs[d][s]] == plain_ids(t)
    assert len(got) == best_fit_plain(list(lengths.elements()), 2048)
    again = binary.pack_token_ids(table(spark, rows).repartition(7), tokens.tokenizer_path(), sent_parts=0)
    assert again.count() == len(got)
    assert binary.pack_token_ids(table(spark, []), tokens.tokenizer_path()).count() == 0
