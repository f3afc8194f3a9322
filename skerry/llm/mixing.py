"""Mixing sources to target weights (DataFrame functions only).

Tokens are aggregated per source; a source's repetition rate is its target over
its size. A document is emitted floor(rate) times plus one copy more if a
uniform number hashed from seed and id lies under the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize

#: Sources in order of code points weigh 1, 2, 3, 1, 2, 3, ...
WEIGHTS = (1, 2, 3)


def count_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, for a table (source, size) with a row per document.

    Targets share the total by weight and stop at ``max_repeat`` times a source's
    size. With sources in order of cap over weight, the capped ones come first, so
    the level that the others share follows from running sums, with no rounds. The
    ordered pass sees one row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("w", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_repeat)
    # Exact order of cap / w: cross-multiplied by the weights' common multiple.
    common = 1
    for w in weights:
        common *= w
    order = [(F.col("cap") * (F.lit(common) / F.col("w")).cast("long")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "share": F.sum("w").over(onward),
        }
    )
    # A source is capped if its share of what is left reaches its cap.
    per = per.withColumn("capped", F.col("rest") * F.col("w") >= F.col("cap") * F.col("share"))
    free = F.when(~F.col("capped"), F.struct("rest", "share"))
    per = per.withColumn("level", F.first(free, ignorenulls=True).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("level.rest").cast("double") * F.col("w").cast("double") / F.col("level.share").cast("double")
    )
    return per.select("source", "source_size", target.alias("target"))


def uniform(seed: int, *cols):
    """A number in [0, 1) from the md5 of seed and columns: 52 bits, the same on every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def draw_copies(docs: DataFrame, seed: int = 17, max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per input row: doc_id, size, source_size, target, copies, taken.

    A null text has size 0; documents without words are emitted like others of
    their source but take no words. A source of size 0 has target 0 and no copies.
    A null source is a source, last in order. Rows that repeat an id draw alike; rows with a null id draw
    by their text. An empty table gives an empty result. Other columns are unread.
    """
    text = F.col(text_col)
    nameless = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(text, F.lit(""))))
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        count_words(text).alias("size"),
        uniform(seed, F.col(id_col), F.coalesce(nameless, F.lit(""))).alias("u"),
    )
    sizes = materialize(sizes, "mix-sizes")
    targets = materialize(source_targets(sizes.select("source", "size"), max_repeat), "mix-targets")
    t = targets.withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17, max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; all columns stay.

    Null and empty texts have no words and are repeated like others of their source; a
    null source is one of its own, the last; rows that repeat an id are drawn alike,
    rows with a null id by their text; an empty table gives an empty result.
    """
    text = F.col(text_col)
    targets = materialize(source_targets(docs.select(F.col(source_col).alias("source"), count_words(text).alias("size")), max_repeat), "mix-targets")
    key, rate, copy = (fresh(docs, n) for n in ("_key", "_rate", "_copy"))
    value = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias(key), value.alias(rate))
    nameless = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(text, F.lit(""))))
    u = uniform(seed, F.col(id_col), F.coalesce(nameless, F.lit("")))
    rows = docs.join(t, docs[source_col].eqNullSafe(t[key]))
    copies = (F.floor(rate) + F.when(u < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(docs.columns)
