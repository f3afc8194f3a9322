"""The driver's contract, and the SQL of every query at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from skerry import queries as core


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(small):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return c


def comparable(rows):
    return sorted(tuple("None" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_sql_agrees(spark, small, duck, name):
    df = core.queries()[name](spark, small)
    want = duck.sql(core.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert comparable(df.select(cols).collect()) == comparable(want.select(*cols).fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_others_run(spark, small, name):
    assert core.queries()[name](spark, small).count() > 0


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hash_cells_recall(spark, small):
    exact = {(r.query_id, r.id) for r in core.cosine_topk(spark, small).where("rank <= 10").collect()}
    found = {(r.query_id, r.id) for r in core.ivf_search(spark, small).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_wordpiece_query_is_whole(spark, small):
    """Greedy longest-match pieces of every word of every text, window by window."""
    out = core.wordpiece_encode(spark, small).collect()
    texts = {r.item_id: r.text for r in core._t(spark, small, "benchmark").collect()}
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "the", "##ing", "##tion", "th"]
    ids = {w: i for i, w in enumerate(words)}
    got: dict = {}
    for r in sorted(out, key=lambda r: (r.item_id, r.window)):
        used = [i for i, m in zip(r.input_ids, r.attention_mask) if m]
        assert len(r.input_ids) == 128 and used[0] == ids["[CLS]"] and used[-1] == ids["[SEP]"]
        got.setdefault(r.item_id, []).extend(used[1:-1])

    def pieces(word):
        found, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in ids:
                    found.append(ids[piece])
                    at = end
                    break
            else:
                found.append(ids["[UNK]"])
                at += 1
        return found

    for item, text in texts.items():
        assert got[item] == [p for w in text.lower().split() for p in pieces(w)], item
