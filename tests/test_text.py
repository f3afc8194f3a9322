"""Chunks, tokens, highlights, formats."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.operators.chunking import backfill_chunks, chunk_documents
from skerry.options import SearchOptions


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def chunks(spark, text, size, overlap):
    df = spark.createDataFrame([(7, text)], "id long, text string")
    return chunk_documents(df, SearchOptions(chunk_size=size, chunk_overlap=overlap)).orderBy("chunk_index").collect()


def test_windows_overlap_and_the_last_may_lie_within_the_one_before(spark):
    got = chunks(spark, " ".join(f"token{i}" for i in range(1, 13)), 6, 2)
    assert [(c.start_offset, c.end_offset) for c in got] == [(0, 6), (4, 10), (8, 12)]
    assert got[0].text == "token1 token2 token3 token4 token5 token6" and got[1].text.startswith("token5 ")
    assert [c.chunk_id for c in got] == [700000, 700001, 700002]
    assert [(c.start_offset, c.end_offset) for c in chunks(spark, "a b c d e f g", 6, 2)] == [(0, 6), (4, 7)]


def test_number_of_chunks_is_tokens_over_step(spark):
    rows = [(n, " ".join("w" * n)) for n in range(0, 40)]
    df = chunk_documents(spark.createDataFrame(rows, "id long, text string"), SearchOptions(chunk_size=10, chunk_overlap=3))
    got = {r.parent_file_id: r["count"] for r in df.groupBy("parent_file_id").count().collect()}
    assert got == {n: -(-n // 7) for n in range(1, 40)}


def test_no_tokens_no_chunks_and_bad_overlap(spark):
    assert chunks(spark, " \n\t ", 6, 2) == [] == chunks(spark, None, 6, 2)
    assert len(chunks(spark, "a b c", 2, 5)) == 3  # a step of at least one


def test_backfill(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "  "), (3, None)], "id long, text string")
    assert [tuple(r) for r in backfill_chunks(df).collect()] == [(1, 0, "abc", 0, 3)]


def test_word_tokens(spark):
    assert one(spark, "Crème-brûlée ÉTÉ x2 don't", X.word_tokens) == ["creme", "brulee", "ete", "x2", "don", "t"]
    assert one(spark, None, X.word_tokens) == []


@pytest.mark.parametrize(
    "text, query, want",
    [
        ("Kotlin and kotlin", "KOTLIN", "**KOTLIN** and **KOTLIN**..."),
        ("a+b costs $5 \\ end", "a+b $5 \\", "**a+b** costs **$5** **\\** end..."),
        ("nothing", "", "nothing..."),
        ("x" * 300, "q", "x" * 200 + "..."),
        ("say \\E now", "\\E", "say **\\E** now..."),
    ],
)
def test_highlight(spark, text, query, want):
    df = spark.createDataFrame([(text, query)], "t string, q string")
    assert df.select(X.highlight(F.col("t"), F.col("q")).alias("x")).first().x == want


def test_later_terms_see_earlier_marks(spark):
    df = spark.createDataFrame([("ab b", "ab b")], "t string, q string")
    assert df.select(X.highlight(F.col("t"), F.col("q")).alias("x")).first().x == "**a**b**** **b**..."


def test_render_bold(spark):
    assert one(spark, "a **b** c **d**...", X.render_bold) == "a <b>b</b> c <b>d</b>"
    assert one(spark, "a **b** c **d**...", X.bold_spans) == ["b", "d"]


def test_formats(spark):
    df = spark.createDataFrame([(0,), (512,), (2048,), (3 << 20,), (5 << 30,)], "n long")
    assert [r[0] for r in df.select(X.card_size(F.col("n"))).collect()] == ["--", "0 KB", "2 KB", "3.0 MB", "5120.0 MB"]
    assert [r[0] for r in df.select(X.file_size(F.col("n"))).collect()] == ["0 B", "512 B", "2 KB", "3 MB", "5 GB"]
    row = spark.createDataFrame([(1717200000000, 0, 0.999)], "a long, b long, s double")
    got = row.select(X.card_date(F.col("a")), X.full_date(F.col("b")), X.full_date(F.col("a")), X.clock_time(F.col("a")), X.percent_score(F.col("s")), X.decimal_score(F.col("s"))).first()
    assert tuple(got) == ("2024-06-01", "Never", "2024-06-01 00:00", "00:00:00", "99%", "Score: 1.00")


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=40))
def test_tokens_of_any_text(spark, text):
    assert "".join(one(spark, text, X.white_tokens)) == "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
