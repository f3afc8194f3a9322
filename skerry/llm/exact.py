"""Exact deduplication by skew-safe combining (DataFrame functions only).

Stages: every map task combines equal texts of its own rows (the partial
aggregate), groups of (digest, salt, text) merge with the salt taken from the
task where the digest is hot, and the winners of the salts combine globally. The text itself is part of
the grouping key at each stage, so digests only route rows and two texts with
one digest never merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, fresh, is_empty, materialize


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    hot_share: float = 1e-4,
    digest=sha256_digest,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id stays; a null id is smaller than any other. Rows
    that repeat an id along with its text are rows of the group like any other,
    and only one row of a group is kept. An empty table gives an empty result.
    Other columns of ``docs`` are neither read nor returned.

    Digests of over ``hot_share`` of all rows are salted, at most 1 / ``hot_share`` of
    them; any other has a single salt, whose winners are final and needn't move again.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    # Repeated rows become one with a count, so that a single one of them can stay.
    ids = materialize(rows.groupBy("doc_id", "_digest").agg(F.count(F.lit(1)).alias("_copies")), "exact-ids")

    total = ids.agg(F.sum("_copies")).first()[0] or 0
    hot = ids.groupBy("_digest").agg(F.sum("_copies").alias("_n")).where(F.col("_n") > max(1.0, hot_share * total)).select("_digest")
    hot = F.broadcast(materialize(hot, "exact-hot"))  # at most 1 / hot_share digests
    size, last = F.sum("_n").alias("group_size"), F.max("_id").alias("keep_id")

    def merged(some, salt):
        found = some.withColumn("_salt", salt).groupBy("_digest", "_salt", "_text")
        return found.agg(F.max("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"))

    single = merged(rows.join(hot, "_digest", "left_anti"), F.lit(0))
    single = single.select("_digest", "_text", F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"))
    salted = merged(rows.join(hot, "_digest", "left_semi"), F.spark_partition_id() % salts)
    winners = single.unionByName(salted.groupBy("_digest", "_text").agg(last, size))
    groups = materialize(winners.select("_digest", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-groups")

    # Rows find their group by digest alone unless some digest stands for several texts.
    if not is_empty(groups.groupBy("_digest").count().where("count > 1")):
        own = rows.select("doc_id", "_digest", F.sha2("_text", 256).alias("text_sha256"))
        ids = materialize(own.groupBy("doc_id", "_digest", "text_sha256").agg(F.count(F.lit(1)).alias("_copies")), "exact-ids")
    out = ids.join(groups, [c for c in ids.columns if c not in ("doc_id", "_copies")])
    copy = F.when(F.col("_copies") > 1, F.sequence(F.lit(1), F.col("_copies").cast("int"))).otherwise(F.array(F.lit(1)))
    out = out.withColumn("_copy", F.explode(copy))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` does not keep; all columns stay.

    Of rows that repeat the kept id along with its text, one stays, whichever it is if
    their other columns differ. A null text equals an empty one, a null id is smaller
    than any other; an empty table gives an empty result.
    """
    marks = materialize(exact_dedup(docs, id_col, text_col), "exact-marks")
    gone = marks.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    repeated = not is_empty(marks.groupBy("doc_id").count().where("count > 1 or doc_id is null"))
    if repeated:
        # Ids do not tell rows apart here: one row per kept id and text.
        sha = fresh(docs, "sha")
        kept = marks.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
        rows = docs.withColumn(sha, F.sha2(fold_ascii(F.col(text_col)), 256))
        cond = rows[id_col].eqNullSafe(kept["_id"]) & (rows[sha] == kept["_sha"])
        return rows.join(kept, cond, "left_semi").dropDuplicates([id_col, sha]).drop(sha)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
