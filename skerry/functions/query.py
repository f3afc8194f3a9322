"""Query understanding as column expressions.

A query text passes through normalisation, tokens, entities, expansion and intent;
``understand`` adds them all to a table of queries.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import DAY_MS
from . import lexicon as L
from .text import strip_marks, white_tokens

ENTITY = "struct<text:string,type:string,value_str:string,value_num:bigint,confidence:double>"
TOKEN = "struct<text:string,token_id:int,is_stopword:boolean,is_punctuation:boolean,importance:double>"


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def removed_urls(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(f"({L.URL})"), F.lit(1))


def removed_emails(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(f"({L.EMAIL})"), F.lit(1))


def normalized(query: Column) -> Column:
    """Without URLs, e-mails and marks, lower-cased, contractions spelled out, plain characters only."""
    text = F.regexp_replace(F.regexp_replace(query, L.URL, " "), L.EMAIL, " ")
    text = F.lower(strip_marks(text))
    text = reduce(lambda t, kv: F.regexp_replace(t, rf"\b{kv[0]}\b", kv[1]), L.CONTRACTIONS.items(), text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, L.NOT_PLAIN, " "), r"\s+", " "))


def query_tokens(norm: Column, vocab: Column | None = None) -> Column:
    """Tokens with weight by kind and place; those of punctuation alone are left out.

    ``vocab`` is a map from token to id; a token it lacks gets the id of [UNK], or 100.
    """

    def token(word, i):
        stop = word.isin(L.STOP_WORDS)
        punct = ~word.rlike("[a-z0-9]")
        weight = (
            F.when(punct, 0.0).when(stop, 0.1).when(i == 0, 0.9).when(F.length(word) > 8, 0.8).when(word.contains("-"), 0.7).otherwise(0.6)
        )
        known = [F.try_element_at(vocab, word), F.try_element_at(vocab, F.lit("[UNK]"))] if vocab is not None else []
        return F.struct(
            word.alias("text"),
            F.coalesce(*known, F.lit(100)).cast("int").alias("token_id"),
            stop.alias("is_stopword"),
            punct.alias("is_punctuation"),
            weight.alias("importance"),
        )

    words = F.filter(F.split(norm, r"\s+"), lambda w: w != "")
    return F.filter(F.transform(words, token), lambda t: ~t["is_punctuation"])


def key_terms(tokens: Column, min_importance: float = 0.5) -> Column:
    return F.transform(F.filter(tokens, lambda t: t["importance"] >= min_importance), lambda t: t["text"])


def _entity(text, kind, value_str=None, value_num=None, confidence=1.0) -> Column:
    return F.struct(
        text.alias("text"),
        F.lit(kind).alias("type"),
        (F.lit(None).cast("string") if value_str is None else value_str).alias("value_str"),
        (F.lit(None).cast("long") if value_num is None else value_num.cast("long")).alias("value_num"),
        F.lit(confidence).alias("confidence"),
    )


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


def lenient_date_ms(text: Column, as_of_ms: int) -> Column:
    """yyyy-MM-dd with months and days that roll over, at the time of day of ``as_of_ms``."""
    year, month, day = (F.substring(text, i, n).cast("int") for i, n in ((1, 4), (6, 2), (9, 2)))
    date = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)
    return F.unix_date(date).cast("long") * DAY_MS + as_of_ms % DAY_MS


def entities(norm: Column, as_of_ms: int) -> Column:
    """File types, relative and absolute dates, languages, domains, possessive, numbers, in this order."""
    single = [F.when(norm.rlike(p), _entity(F.lit(t), "FILE_TYPE", F.lit(t))) for p, t in L.FILE_TYPES]
    single += [
        F.when(norm.rlike(rf"\b{p}\b"), _entity(F.lit(p), "DATE_RELATIVE", None, F.lit(as_of_ms - days * DAY_MS), 0.95))
        for p, days in L.RELATIVE_DATES
    ]
    dates = F.transform(F.regexp_extract_all(norm, F.lit(f"({L.ISO_DATE})"), F.lit(1)), lambda d: _entity(d, "DATE_ABSOLUTE", None, lenient_date_ms(d, as_of_ms)))
    named = [F.when(norm.rlike(rf"\b{_quoted(x)}\b"), _entity(F.lit(x), "PROGRAMMING_LANGUAGE", F.lit(x), None, 0.9)) for x in L.LANGUAGES]
    named += [F.when(norm.rlike(rf"\b{k}\b"), _entity(F.lit(k), "TECHNICAL_DOMAIN", F.lit(v), None, 0.85)) for k, v in L.DOMAINS.items()]
    named += [F.when(norm.rlike(r"\bmy\b"), _entity(F.lit("my"), "PERSON_POSSESSIVE", F.lit("user_owned"), None, 0.7))]
    numbers = F.transform(
        F.regexp_extract_all(norm, F.lit(L.NUMBER), F.lit(1)),
        lambda n: _entity(n, "NUMERIC", None, F.coalesce(n.try_cast("int"), F.lit(0))),
    )
    return F.concat(F.array_compact(F.array(*single)), dates, F.array_compact(F.array(*named)), numbers)


def _of_type(ents: Column, *types: str) -> Column:
    return F.filter(ents, lambda e: e["type"].isin(*types))


def _first(ents: Column, field: str, *types: str) -> Column:
    return F.get(F.transform(_of_type(ents, *types), lambda e: e[field]), F.lit(0))


def original_terms(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: ~t["is_stopword"]), lambda t: t["text"])


def domain_expansions(tokens: Column) -> Column:
    """Known short forms among the tokens, each once, with their long forms, in order."""
    table = _map(L.EXPANSIONS)
    found = F.filter(F.array_distinct(F.transform(tokens, lambda t: t["text"])), lambda w: F.map_contains_key(table, w))
    return F.transform(found, lambda w: F.struct(w.alias("term"), F.element_at(table, w).alias("expansion")))


def synonyms(tokens: Column) -> Column:
    table = _map(L.SYNONYMS)
    weighty = F.filter(tokens, lambda t: (t["importance"] >= 0.6) & ~t["is_stopword"])
    found = F.filter(F.array_distinct(F.transform(weighty, lambda t: t["text"])), lambda w: F.map_contains_key(table, w))
    return F.transform(found, lambda w: F.struct(w.alias("term"), F.element_at(table, w).alias("words")))


def boosted_terms(expansions: Column, ents: Column) -> Column:
    short = F.transform(expansions, lambda e: e["term"])
    long_ = F.transform(expansions, lambda e: e["expansion"])
    named = _of_type(ents, "PROGRAMMING_LANGUAGE", "TECHNICAL_DOMAIN")
    return F.array_distinct(F.concat(short, long_, F.transform(named, lambda e: e["text"]), F.transform(named, lambda e: e["value_str"])))


def query_filters(ents: Column) -> Column:
    return F.struct(
        _first(ents, "value_str", "FILE_TYPE").alias("file_type"),
        _first(ents, "value_num", "DATE_RELATIVE", "DATE_ABSOLUTE").alias("date_after"),
        F.lit(None).cast("long").alias("date_before"),
        _first(ents, "value_str", "PROGRAMMING_LANGUAGE").alias("programming_language"),
        (F.size(_of_type(ents, "PERSON_POSSESSIVE")) > 0).alias("user_owned"),
    )


def bm25_query(terms: Column, boosted: Column, expansions: Column, syns: Column, mode: str = "all") -> Column:
    """Terms, boosted ones twice, then words of expansions, then synonyms, in one line.

    The match joins all words by AND, so an expansion narrows; ``mode="terms"`` leaves
    expansions and synonyms out.
    """
    doubled = F.flatten(F.transform(terms, lambda t: F.when(F.array_contains(boosted, t), F.array(t, t)).otherwise(F.array(t))))
    words = F.flatten(F.transform(expansions, lambda e: F.split(e["expansion"], " ")))
    more = F.flatten(F.transform(syns, lambda s: s["words"]))
    parts = F.concat(doubled, words, more) if mode == "all" else doubled
    return F.trim(F.array_join(parts, " "))


def dense_query(terms: Column, expansions: Column) -> Column:
    return F.trim(F.array_join(F.concat(terms, F.transform(expansions, lambda e: e["expansion"])), " "))


def intent(original: Column, norm: Column, tokens: Column, ents: Column) -> Column:
    """The intent of the highest rule sum (the first of equals), its sum and the rules that fired."""

    def has(*types):
        return F.exists(ents, lambda e: e["type"].isin(*types))

    def any_of(check, words):
        return reduce(lambda a, b: a | b, [check(w) for w in words])

    question = any_of(norm.startswith, L.QUESTION_STARTS)
    rules = {
        "LOOKUP": [
            (any_of(norm.startswith, ("find", "open", "show")), 0.8, "starts with action verb"),
            (F.lower(original).contains("my "), 0.6, "contains possessive 'my'"),
            (has("FILE_TYPE"), 0.5, "specifies file type"),
        ],
        "EXPLORATION": [
            ((F.size(tokens) >= 2) & ~norm.startswith("find") & ~question, 0.4, "general topic query"),
            (any_of(norm.contains, ("tutorial", "guide", "learn")), 0.6, "learning keywords"),
        ],
        "FACT_FINDING": [
            (question, 0.9, "question format"),
            (any_of(norm.contains, ("explain", "definition")), 0.7, "explanation request"),
        ],
        "CODE_SEARCH": [
            (any_of(norm.contains, ("example", "sample", "snippet", "code")), 0.7, "code-related keywords"),
            (has("PROGRAMMING_LANGUAGE"), 0.6, "programming language mentioned"),
            (any_of(norm.contains, ("implement", "build")), 0.5, "implementation keywords"),
        ],
        "RECENT_FILES": [
            (has("DATE_RELATIVE", "DATE_ABSOLUTE"), 0.8, "date entity present"),
            (any_of(norm.contains, ("recent", "latest", "new")), 0.6, "recency keywords"),
        ],
    }
    zero = F.lit(0.0).cast("float")
    options = []
    for i, name in enumerate(L.INTENTS):
        # Sums are of 32-bit numbers, one after another: ties depend on it.
        total = reduce(lambda s, r: s + F.when(r[0], F.lit(r[1]).cast("float")).otherwise(zero), rules[name], zero)
        why = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, _, text in rules[name]])), "; ")
        options.append(F.struct(total.alias("confidence"), F.lit(-i).alias("place"), F.lit(name).alias("intent"), why.alias("reasoning")))
    best = F.array_max(F.array(*options))
    return F.struct(best["intent"].alias("intent"), best["confidence"].alias("confidence"), best["reasoning"].alias("reasoning"))


def understand(queries: DataFrame, as_of_ms: int, vocab: Column | None = None, text_col: str = "text", mode: str = "all") -> DataFrame:
    """``queries`` with normalized, tokens, entities, expansion, intent and both query texts added."""
    q = F.coalesce(F.col(text_col), F.lit(""))
    df = queries.withColumns({"normalized": normalized(q), "urls": removed_urls(q), "emails": removed_emails(q)})
    norm = F.col("normalized")
    df = df.withColumns({"tokens": query_tokens(norm, vocab), "entities": entities(norm, as_of_ms)})
    tok, ents = F.col("tokens"), F.col("entities")
    df = df.withColumns({"key_terms": key_terms(tok), "original_terms": original_terms(tok), "expansions": domain_expansions(tok), "synonyms": synonyms(tok)})
    df = df.withColumns({"boosted": boosted_terms(F.col("expansions"), ents), "filters": query_filters(ents), "intent": intent(q, norm, tok, ents)})
    return df.withColumns(
        {
            "bm25_query": bm25_query(F.col("original_terms"), F.col("boosted"), F.col("expansions"), F.col("synonyms"), mode),
            "dense_query": dense_query(F.col("original_terms"), F.col("expansions")),
        }
    )


def degraded(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """What ``understand`` adds, without understanding: the lower-cased raw query wherever a text is asked for."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    known = understand(queries.withColumn(text_col, F.lit("").cast("string")), 0, text_col=text_col)
    kept = {c: known.schema[c].dataType for c in known.columns if c not in queries.columns}
    plain = {"normalized": low, "key_terms": white_tokens(low), "original_terms": white_tokens(low), "bm25_query": low, "dense_query": low}
    guess = F.struct(F.lit("EXPLORATION").alias("intent"), F.lit(0.5).cast("float").alias("confidence"), F.lit("fallback").alias("reasoning"))
    empty = {c: F.array().cast(t) if t.typeName() == "array" else F.lit(None).cast(t) for c, t in kept.items()}
    return queries.withColumns({**empty, **plain, "intent": guess})


def understand_or_degrade(queries: DataFrame, as_of_ms: int, text_col: str = "text", **more) -> DataFrame:
    """``understand``, or its degraded form where the processing can't be set up (say, with a broken vocabulary)."""
    try:
        return understand(queries, as_of_ms, text_col=text_col, **more)
    except Exception as e:
        warnings.warn(f"queries are taken as they are: {e}", stacklevel=2)
        return degraded(queries, text_col)
