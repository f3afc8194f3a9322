"""Context packing, extractive answers, envelopes."""

import pytest
from pyspark.sql import functions as F

from skerry.operators import answers as A


def extract(spark, chunks, query):
    df = spark.createDataFrame([(chunks, query)], "c array<string>, q string")
    return df.select(A.extractive_answer(F.col("c"), F.col("q")).alias("a")).first().a


def test_answer_and_failures(spark):
    got = extract(spark, ["Kotlin coroutines are light.", "Cooking pasta.", "Coroutines suspend."], "kotlin coroutines")
    assert got.answer == "1. Kotlin coroutines are light.\n2. Coroutines suspend." and got.error is None
    assert extract(spark, [], "kotlin").error == A.ERRORS["chunks"] and extract(spark, [], "kotlin").answer == ""
    assert extract(spark, ["x"], "  ").error == A.ERRORS["query"]
    assert extract(spark, ["x"], "? a").error == A.ERRORS["terms"]
    assert extract(spark, ["x"], "kotlin").error == A.ERRORS["relevant"]
    assert extract(spark, None, "kotlin").error == A.ERRORS["chunks"]


def test_equal_scores_keep_their_order_and_three_are_taken(spark):
    got = extract(spark, [f"kotlin {i}" for i in range(5)], "kotlin")
    assert got.source_chunks == ["kotlin 0", "kotlin 1", "kotlin 2"]


def test_long_sentences_are_cut(spark):
    got = extract(spark, ["kotlin  \n " + "word " * 100], "kotlin").answer
    assert got.startswith("1. kotlin word") and got.endswith("...") and len(got) <= 3 + 220 + 3


@pytest.mark.parametrize(
    "lens, want",
    [([300] * 9, 5), ([900, 900, 900, 100], 3), ([2000, 1], 1), ([2001, 5], 1), ([], 0)],
)
def test_packing(spark, lens, want):
    df = spark.createDataFrame([(["x" * n for n in lens],)], "s array<string>")
    got = df.select(A.pack_context(F.col("s")).alias("k")).first().k
    assert len(got) == want and sum(map(len, got)) <= 2000


def test_envelope(spark):
    files = spark.createDataFrame([(1, f"/f{i}", [f"kotlin snippet {i}..."], i) for i in range(1, 6)], "query_id long, file_path string, snippets array<string>, rank int")
    q = spark.createDataFrame([(1, "kotlin"), (2, "java"), (3, None)], "query_id long, text string")
    got = {r.query_id: r for r in A.answer(files, q).collect()}
    assert got[1].answer.startswith("1. kotlin snippet 1...") and got[1].citations == ["/f1", "/f2", "/f3"] and got[1].error is None
    assert (got[2].answer, got[2].error, got[2].citations) == (None, A.ERRORS["context"], [])
    off = A.answer(files, q, provider=None).collect()
    assert {r.error for r in off} == {A.ERRORS["unavailable"]}
    assert A.choose_provider({}) is None and A.choose_provider() is A.extractive_answer


def test_prompt(spark):
    df = spark.createDataFrame([([f"c{i}" for i in range(7)], "why?")], "c array<string>, q string")
    got = df.select(A.prompt(F.col("c"), F.col("q")).alias("p")).first().p
    assert got.count("```") == 10 and got.endswith("Question: why?\n<|end|>\n<|assistant|>") and "c5" not in got
