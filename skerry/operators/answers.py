"""Answers from retrieved snippets: context, extraction, citations, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = {
    "query": "Query is blank",
    "chunks": "No context chunks provided",
    "terms": "Query has no searchable terms",
    "relevant": "No relevant context found",
    "unavailable": "AI answers are not available on this device",
    "context": "No relevant context found in search results",
}


def pack_context(snippets: Column, max_chunks: int = 5, max_chars: int = 2000) -> Column:
    """Snippets in order up to ``max_chunks``; one that would pass ``max_chars`` is skipped, later ones may fit."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

    def add(acc, s):
        fits = (F.size(acc["kept"]) < max_chunks) & (acc["n"] + F.length(s) <= max_chars)
        return F.when(fits, F.struct((acc["n"] + F.length(s)).alias("n"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc)

    return F.aggregate(snippets, start, add)["kept"]


def term_set(text: Column) -> Column:
    """Distinct lower-cased tokens of ASCII letters, digits and underscores, of two characters at least."""
    parts = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.regexp_replace(t, "[^a-z0-9_]", ""))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2))


def trim_sentence(text: Column, chars: int = 220) -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(F.length(clean) <= chars, clean).otherwise(F.concat(F.regexp_replace(F.substring(clean, 1, chars), r"\s+$", ""), F.lit("...")))


def extractive_answer(chunks: Column, query: Column) -> Column:
    """struct(answer, source_chunks, error): the three chunks that share most query terms, numbered.

    Chunks without a shared term are left out; equal scores keep their order.
    """
    wanted = term_set(query)
    scored = F.transform(
        chunks, lambda c, i: F.struct((-F.size(F.array_intersect(term_set(c), wanted))).alias("s"), i.alias("i"), c.alias("text"))
    )
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), 1, 3)
    texts = F.transform(best, lambda x: x["text"])
    lines = F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), trim_sentence(t)))
    error = (
        F.when(~F.coalesce(query, F.lit("")).rlike(r"\S"), ERRORS["query"])
        .when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, ERRORS["chunks"])
        .when(F.size(wanted) == 0, ERRORS["terms"])
        .when(F.size(texts) == 0, ERRORS["relevant"])
    )
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(error.isNull(), F.array_join(lines, "\n")).otherwise(F.lit("")).alias("answer"),
        F.when(error.isNull(), texts).otherwise(none).alias("source_chunks"),
        error.alias("error"),
    )


def prompt(chunks: Column, query: Column, max_chunks: int = 5) -> Column:
    """Prompt text with fenced excerpts and the question."""
    fenced = F.transform(F.slice(chunks, 1, max_chunks), lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```")))
    head = (
        "<|system|>\nYou are a helpful assistant. Use only the provided excerpts.\n"
        "If the answer is not present, say you do not have enough information.\n<|end|>\n<|user|>\nDocument Excerpts:\n"
    )
    return F.concat(F.lit(head), F.array_join(fenced, "\n\n"), F.lit("\n\nQuestion: "), query, F.lit("\n<|end|>\n<|assistant|>"))


def gather_files(files: DataFrame) -> DataFrame:
    """(query_id, snippets, paths) of ranked files (query_id, file_path, snippets, rank), in rank order."""
    rows = files.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "snippets"))).alias("fs"))
    return rows.select("query_id", F.flatten(F.transform("fs", lambda f: f["snippets"])).alias("snippets"), F.transform("fs", lambda f: f["file_path"]).alias("paths"))


#: Answerers by name, tried in order: (is available, (chunks, query) -> struct(answer, source_chunks, error)).
PROVIDERS: dict[str, tuple] = {"extractive": (lambda: True, extractive_answer)}


def choose_provider(providers: dict[str, tuple] | None = None):
    """The first available answerer; if it can't be set up there is none, later ones aren't tried."""
    for available, answer in (PROVIDERS if providers is None else providers).values():
        if available():
            return answer() if getattr(answer, "needs_init", False) else answer
    return None


def answer(files: DataFrame, queries: DataFrame, text_col: str = "text", provider="default", max_chunks: int = 5, max_chars: int = 2000) -> DataFrame:
    """(query_id, answer, error, citations): an answer per query from its ranked files.

    The answer is null if there is an error; citations are the first three paths.
    """
    use = choose_provider() if provider == "default" else provider
    rows = queries.select("query_id", F.col(text_col).alias("_q")).join(gather_files(files), "query_id", "left")
    none = F.array().cast("array<string>")
    if use is None:
        return rows.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit(ERRORS["unavailable"]).alias("error"), none.alias("citations"))
    context = pack_context(F.coalesce("snippets", none), max_chunks, max_chars)
    rows = rows.withColumn("_ctx", context).withColumn("_a", use(F.col("_ctx"), F.col("_q")))
    empty = F.size("_ctx") == 0
    error = F.when(empty, ERRORS["context"]).otherwise(F.col("_a.error"))
    text = F.when(~empty & F.col("_a.error").isNull() & F.col("_a.answer").rlike(r"\S"), F.col("_a.answer"))
    return rows.select("query_id", text.alias("answer"), error.alias("error"), F.when(empty, none).otherwise(F.slice(F.coalesce("paths", none), 1, 3)).alias("citations"))
