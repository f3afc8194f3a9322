"""Query understanding."""

import pytest
from pyspark.sql import functions as F

from skerry.functions import query as Q
from skerry.options import DAY_MS, DEFAULTS

AS_OF = DEFAULTS.as_of_ms


@pytest.fixture(scope="module")
def know(spark):
    def f(text, **more):
        return Q.understand(spark.createDataFrame([(1, text)], "query_id long, text string"), AS_OF, **more).first()

    return f


def kinds(row):
    return [(e.type, e.text) for e in row.entities]


def test_urls_and_mail_go_and_contractions_are_spelled_out(know):
    r = know("I'm searching https://example.com for notes at me@test.com")
    assert len(r.urls) == len(r.emails) == 1 and "i am" in r.normalized and "https" not in r.normalized


def test_mail_is_collected_before_urls_go(know):
    assert know("https://host/x?to=me@test.com").emails == ["me@test.com"]


def test_marks_and_special_characters(know):
    assert know("Résumé  (naïve)! it's").normalized == "resume naive it is"


def test_entities(know):
    r = know("kotlin tutorials pdf from yesterday")
    assert {("PROGRAMMING_LANGUAGE", "kotlin"), ("FILE_TYPE", "pdf"), ("DATE_RELATIVE", "yesterday")} <= set(kinds(r))
    assert (r.filters.file_type, r.filters.date_after, r.filters.programming_language) == ("pdf", AS_OF - DAY_MS, "kotlin")


def test_this_week_is_now(know):
    assert know("notes this week").filters.date_after == AS_OF


def test_absolute_dates_roll_over_and_also_give_numbers(know):
    r = know("2023-13-45")
    assert [e.value_num for e in r.entities if e.type == "DATE_ABSOLUTE"] == [1707868800000]  # 2024-02-14
    assert [e.value_num for e in r.entities if e.type == "NUMERIC"] == [2023, 13, 45]


def test_numbers_out_of_range_are_zero(know):
    assert [e.value_num for e in know("99999999999 3").entities] == [0, 3]


def test_names_with_symbols_never_match(know):
    assert ("PROGRAMMING_LANGUAGE", "c++") not in kinds(know("c++ and c#"))
    assert ("PROGRAMMING_LANGUAGE", "r") in kinds(know("plot in r"))


def test_token_weights(know):
    r = know("the extraordinary state-of-art new kotlin - idea")
    assert [(t.text, t.importance) for t in r.tokens] == [("the", 0.1), ("extraordinary", 0.8), ("state-of-art", 0.8), ("new", 0.6), ("kotlin", 0.6), ("idea", 0.6)]
    assert know("kotlin").tokens[0].importance == 0.9 and know("a-b c-d").tokens[1].importance == 0.7
    assert {t.token_id for t in r.tokens} == {100}


def test_vocabulary_ids(spark):
    vocab = F.create_map(F.lit("kotlin"), F.lit(7), F.lit("[UNK]"), F.lit(3))
    df = Q.understand(spark.createDataFrame([(1, "kotlin idea")], "query_id long, text string"), AS_OF, vocab)
    assert [t.token_id for t in df.first().tokens] == [7, 3]


def test_expansion_repeats_boosted_terms_and_appends(know):
    r = know("search ml")
    assert r.bm25_query == "search ml ml machine learning find lookup query"
    assert r.dense_query == "search ml machine learning"
    assert know("search ml", mode="terms").bm25_query == "search ml ml"


@pytest.mark.parametrize(
    "text, intent",
    [
        ("what is kubernetes", "FACT_FINDING"),
        ("kotlin coroutine example", "CODE_SEARCH"),
        ("find my kotlin notes from yesterday", "LOOKUP"),
        ("", "LOOKUP"),
        ("renewable energy", "RECENT_FILES"),  # "new" is looked for inside words
        ("gardening tutorial tips", "EXPLORATION"),
    ],
)
def test_intent(know, text, intent):
    assert know(text).intent.intent == intent


def test_nothing_fires_on_nothing(know):
    assert (know("").intent.confidence, know("").intent.reasoning) == (0.0, "")


def test_null_query(know):
    assert know(None).normalized == "" and know(None).tokens == []


def test_degraded_queries(spark):
    raw = spark.createDataFrame([(1, "Kotlin PDF"), (2, None)], "query_id long, text string")
    whole = Q.understand(raw, 0)
    got = Q.understand_or_degrade(raw, 0, vocab="no such column")
    assert got.schema.fieldNames() == whole.schema.fieldNames()
    one, two = got.orderBy("query_id").collect()
    assert one.bm25_query == one.dense_query == one.normalized == "kotlin pdf" and one.key_terms == ["kotlin", "pdf"] and one.entities == []
    assert (one.intent.intent, one.intent.confidence, one.intent.reasoning) == ("EXPLORATION", 0.5, "fallback") and two.bm25_query == ""
    assert one.filters is None or one.filters.file_type is None
