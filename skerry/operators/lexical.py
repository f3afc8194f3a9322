"""Full-text index and BM25 over chunks.

The index is a table of positions (chunk_id, pos, term, dl), dl being the chunk's
length, and a row of corpus totals. A query is a conjunction of prefix phrases. Terms
and the stated queries' tokens meet by equality of their first letters, and the join
itself compares the rest, so a lookup is one pass over the positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import white_tokens, word_tokens

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class LexicalIndex:
    positions: DataFrame  # chunk_id, pos, term, dl
    totals: DataFrame  # n, total_len (one row)

    @property
    def vocabulary(self) -> DataFrame:
        return vocabulary_of(self.positions)


def vocabulary_of(positions: DataFrame) -> DataFrame:
    """(term, cf, df): uses of each term and chunks that hold it; counted per chunk first."""
    return postings(positions).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def postings(positions: DataFrame) -> DataFrame:
    return positions.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def positions_of(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    ws = chunks.select(F.col(id_col).alias("chunk_id"), word_tokens(F.col(text_col)).alias("ws"))
    return ws.select("chunk_id", F.size("ws").alias("dl"), F.posexplode("ws").alias("pos", "term")).select("chunk_id", "pos", "term", "dl")


def totals_of(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(word_tokens(F.col(text_col)))), F.lit(0)).alias("total_len"))


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> LexicalIndex:
    return LexicalIndex(positions_of(chunks, id_col, text_col), totals_of(chunks, text_col))


def postings_delta(old: DataFrame, removed: DataFrame, added_chunks: DataFrame) -> DataFrame:
    """Positions after removing chunks (chunk_id) and adding others: what index triggers do row by row."""
    return old.join(removed.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(positions_of(added_chunks))


def fts_query(text: Column) -> Column:
    """The match expression: every token a quoted prefix phrase, joined by AND."""
    quoted = F.transform(white_tokens(F.trim(text)), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"*')))
    return F.array_join(quoted, " AND ")


def phrases(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, phrase, words) for every white-space token of every query."""
    tokens = queries.select("query_id", F.posexplode(white_tokens(F.col(text_col))).alias("phrase", "token"))
    return tokens.select("query_id", "phrase", word_tokens(F.col("token")).alias("words"))


def only_terms(positions: DataFrame, words: DataFrame, most: int = 256) -> DataFrame:
    """Positions whose term begins like some token, if there are at most ``most`` tokens; all of them otherwise.

    The prefixes are literals of the plan, so they reach the scan: of positions laid out
    by term, files and row groups without a fitting term aren't read.
    """
    found = sorted(r.token for r in words.select("token").distinct().limit(most + 1).collect())  # at most most + 1 tokens
    if len(found) > most:
        return positions
    heads: list[str] = []
    for token in found:
        if not heads or not token.startswith(heads[-1]):
            heads.append(token)
    fits = F.lit(False)
    for token in heads:
        fits = fits | F.col("term").startswith(token)
    return positions.where(fits)


def phrase_counts(queries: DataFrame, positions: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(query_id, phrase, chunk_id, f, dl): how often each phrase occurs in each chunk; and each query's number of phrases.

    All words of a phrase but the last match whole terms, the last a prefix. A token
    without words is a phrase that nothing matches.
    """
    ph = phrases(queries, text_col)
    needed = ph.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_phrases"))
    words = ph.select("query_id", "phrase", F.size("words").alias("m"), F.posexplode("words").alias("off", "token"))
    words = words.withColumn("is_prefix", F.col("off") == F.col("m") - 1)
    positions = only_terms(positions, words)
    # Terms and tokens meet on as many first letters as the shortest token has.
    head = words.agg(F.coalesce(F.min(F.length("token")), F.lit(1)).alias("n"))
    words = words.crossJoin(F.broadcast(head)).withColumn("head", F.substring("token", F.lit(1), F.col("n"))).drop("n")
    rows = positions.crossJoin(F.broadcast(head)).withColumn("cut", F.substring("term", F.lit(1), F.col("n"))).drop("n")
    fits = F.when(F.col("is_prefix"), F.startswith("term", "token")).otherwise(F.col("term") == F.col("token"))
    hits = rows.join(words, (F.col("cut") == F.col("head")) & fits)
    hits = hits.select("query_id", "phrase", "m", "chunk_id", "dl", (F.col("pos") - F.col("off")).alias("at"))
    whole = hits.where("m = 1").unionByName(
        hits.where("m > 1").groupBy("query_id", "phrase", "m", "chunk_id", "dl", "at").agg(F.count(F.lit(1)).alias("k")).where("k = m").drop("k")
    )
    return whole.groupBy("query_id", "phrase", "chunk_id").agg(F.count(F.lit(1)).alias("f"), F.first("dl").alias("dl")), needed


def match(queries: DataFrame, index: LexicalIndex, text_col: str = "text") -> DataFrame:
    """(query_id, chunk_id) of the chunks in which every phrase of the query occurs."""
    counts, needed = phrase_counts(queries, index.positions, text_col)
    found = counts.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("k")).join(needed, "query_id")
    return found.where("k = n_phrases").select("query_id", "chunk_id")


def _scored(counts: DataFrame, needed: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Sums of idf times saturated occurrences, for the keys that have all phrases.

    idf is ln((N - df + 0.5) / (df + 0.5)), df the keys a phrase occurs in, and 1e-6
    where that isn't positive. Counting df and weighing the parts use one shuffle each.
    """
    # Reading f and dl here too leaves both uses of the counts one plan, which is then shuffled once.
    hits = F.count_if((F.col("f") > 0) & (F.col("dl") > 0))
    df = counts.groupBy("query_id", "phrase").agg(hits.alias("df")).crossJoin(F.broadcast(totals))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.select("query_id", "phrase", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"), (F.col("total_len") / F.col("n")).alias("avgdl"))
    f = F.col("f").cast("double")
    part = F.col("idf") * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # Parts are added in the order of the phrases, so that equal texts get equal scores to the last bit.
    parts = F.array_sort(F.collect_list(F.struct("phrase", part.alias("part"))))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"])
    sums = counts.join(df, ["query_id", "phrase"]).groupBy("query_id", key).agg((-total).alias("score"), F.count(F.lit(1)).alias("k"))
    return sums.join(needed, "query_id").where("k = n_phrases").select("query_id", key, "score")


def bm25(queries: DataFrame, index: LexicalIndex, text_col: str = "text") -> DataFrame:
    """(query_id, chunk_id, score), lower is better, of the chunks that match. A repeated phrase counts repeatedly."""
    counts, needed = phrase_counts(queries, index.positions, text_col)
    return _scored(counts, needed, index.totals, "chunk_id")


def bm25_columns(queries: DataFrame, docs: DataFrame, weights: dict[str, float], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score) over several columns, each column's occurrences times its weight.

    Lengths and document frequencies are over all columns together.
    """
    lists = [word_tokens(F.col(c)) for c in weights]
    total = sum((F.size(ws) for ws in lists[1:]), F.size(lists[0]))
    fields = F.explode(F.array(*[F.struct(F.lit(float(w)).alias("w"), ws.alias("ws")) for w, ws in zip(weights.values(), lists)]))
    rows = docs.select(F.col(id_col).alias("id"), total.alias("dl"), fields.alias("f"))
    pos = rows.select(F.struct("id", "f.w").alias("chunk_id"), "dl", F.posexplode("f.ws").alias("pos", "term"))
    counts, needed = phrase_counts(queries, pos, text_col)
    per = counts.groupBy("query_id", "phrase", F.col("chunk_id.id").alias("id")).agg(F.sum(F.col("f") * F.col("chunk_id.w")).alias("f"), F.first("dl").alias("dl"))
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total_len"))
    return _scored(per, needed, totals, "id")


def top_chunks(scored: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` chunks of each query, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.asc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
