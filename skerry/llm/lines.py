"""Line deduplication by distinct-site spread.

HyperLogLog sketches of the sites of every line merge by aggregation. Lines whose
estimate is clearly on one side of the threshold are decided by it, those within
the sketch's error band get an exact distinct count. Lines on too many sites are
boilerplate and leave every document.
"""

from __future__ import annotations

from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: ASCII white space without the newline: what is trimmed off a line before it is compared.
_TRIM = " \t\x0b\x0c\r"


def _line_hash(line):
    return F.unhex(F.md5(F.btrim(line, F.lit(_TRIM))))


def _split(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def widespread_lines(lines: DataFrame, min_sites: int = 5, lg_k: int = 12, deviations: float = 6.0) -> DataFrame:
    """(line) hashes found on ``min_sites`` or more sites, of a table (line, site).

    A sketch of 2**lg_k registers errs by 1.04 / sqrt(2**lg_k) of the count (one
    standard deviation); estimates within ``deviations`` of these around the threshold
    are in doubt. A null site is none.
    """
    band = deviations * 1.04 / (1 << lg_k) ** 0.5
    sketches = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    spread = materialize(sketches.where(F.col("sites") >= min_sites * (1 - band)), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("line")
    # Pairs are made distinct before they meet the doubtful lines.
    pairs = lines.where(F.col("site").isNotNull()).groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = pairs.join(near, "line", "left_semi").groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    return sure.unionByName(exact)


def _without(bad):
    """Drop lines whose hash is in a broadcast set, where the texts lie."""
    white = _TRIM.encode()

    def rows(batches):
        for b in batches:
            out = [[], [], []]
            for text in b.column(1).to_pylist():
                n = gone = 0
                kept = []
                for line in (text or "").encode("utf-8").split(b"\n"):
                    bare = line.strip(white)
                    n += bool(bare)
                    if bare and md5(bare).digest() in bad.value:
                        gone += 1
                    else:
                        kept.append(line)
                for c, v in zip(out, (n, gone, b"\n".join(kept).decode("utf-8"))):
                    c.append(v)
            yield pa.record_batch([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_text"])

    return rows


def _without_by_join(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """The same by joins: each text meets the list of its own bad lines, keyed by text so that equal or null ids do no harm."""
    key = F.xxhash64("text")
    found = rows.select(key.alias("_key"), F.explode(F.array_distinct(_worded_hashes())).alias("line"))
    hits = found.join(bad, "line").groupBy("_key").agg(F.collect_set("line").alias("bad"))
    hits = materialize(hits, "boilerplate-hits").withColumnRenamed("_key", "_hit")
    none = F.array().cast("array<binary>")
    out = rows.join(hits, key == F.col("_hit"), "left").withColumns({"all": _split(F.col("text")), "bad": F.coalesce("bad", none)})
    out = out.withColumn("kept", F.filter("all", lambda x: (F.btrim(x, F.lit(_TRIM)) == "") | ~F.array_contains(F.col("bad"), _line_hash(x))))
    n_lines = F.size(F.filter("all", lambda x: F.btrim(x, F.lit(_TRIM)) != ""))
    return out.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        (F.size("all") - F.size("kept")).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


def _worded_hashes():
    return F.transform(F.filter(_split(F.col("text")), lambda x: F.btrim(x, F.lit(_TRIM)) != ""), _line_hash)


def remove_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 5,
    lg_k: int = 12,
    max_sent: int = 500_000,
) -> DataFrame:
    """A row per input row: doc_id, n_lines, n_removed, kept_text.

    Lines are what newlines separate, compared without ASCII white space at their
    ends; a line of nothing but that is never removed nor counted. Every occurrence of a
    line on ``min_sites`` or more distinct sites goes; the lines left are joined by
    newlines, unchanged. A null text is empty; a null site counts for no line; rows
    with a null id are treated alike; repeated rows give repeated results. An empty
    table gives an empty result; other columns are unread.

    Up to ``max_sent`` boilerplate lines (16 bytes each) are sent to the texts, which
    then needn't move; beyond, lines and texts are joined, with the same result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).alias("site"))
    lines = rows.select("site", F.explode(_worded_hashes()).alias("line"))
    bad = materialize(widespread_lines(lines, min_sites, lg_k), "boilerplate")
    if bad.count() > max_sent:
        return _without_by_join(rows, bad)
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.line) for r in bad.collect()))  # at most max_sent rows
    return rows.select("doc_id", "text").mapInArrow(_without(sent), "doc_id long, n_lines long, n_removed long, kept_text string")
