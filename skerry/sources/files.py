"""File scan, parsing and change detection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import PARSEABLE
from .pdf import pdf_text

#: Text files are read up to this many bytes.
MAX_BYTES = 100_000

#: Parsers for formats that aren't plain text: extension -> function from bytes to text (or None).
PARSERS: dict[str, Callable[[bytes], str | None]] = {"pdf": pdf_text}


def extension(path) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def can_parse(path) -> F.Column:
    return extension(path).isin(*PARSEABLE)


def existing_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that exist, each path once."""
    found = []
    for r in dict.fromkeys(x.rstrip("/") for x in roots):
        p = spark._jvm.org.apache.hadoop.fs.Path(r)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            found.append(r)
    return found


def scan_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, modified_at, size_bytes, content) of all parseable files under the roots, each path once.

    Empty files are passed over.
    """
    roots = existing_roots(spark, roots)
    if not roots:
        return spark.createDataFrame([], "path string, modified_at long, size_bytes long, content binary")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    rows = rows.where(can_parse(F.col("path"))).dropDuplicates(["path"])
    return rows.select("path", F.unix_millis("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), "content")


def plain_text(content) -> F.Column:
    """UTF-8 text of the first bytes, trimmed; null if nothing is left. Broken bytes are replaced."""
    text = F.make_valid_utf8(F.substring(content, 1, MAX_BYTES).cast("string"))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(text != "", text)


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` with body, null where it can't be parsed; formats without a parser count as such."""
    ext = extension(F.col("path"))
    out = files.withColumn("body", F.when(ext != "pdf", plain_text(F.col("content"))))
    if PARSERS:
        parsers = dict(PARSERS)

        @F.pandas_udf("string")
        def parsed(kind, content):
            def one(k, c):
                try:
                    text = parsers[k](bytes(c))
                except Exception:
                    return None
                return text.strip() or None if text else None

            return kind.combine(content, lambda k, c: one(k, c) if k in parsers else None)

        out = out.withColumn("body", F.when(ext.isin(*parsers), parsed(ext, F.col("content"))).otherwise(F.col("body")))
    return out.drop("content")


def metadata(files: DataFrame) -> DataFrame:
    """Document rows: a stable id from the path, name as title, type, time, size; the text stays in body."""
    return files.select(
        F.xxhash64("path").alias("id"),
        F.col("path").alias("file_path"),
        F.element_at(F.split("path", "/"), -1).alias("title"),
        "body",
        extension(F.col("path")).alias("file_type"),
        "modified_at",
        "size_bytes",
    )


def classify_changes(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """``scanned`` with status: new, skipped (times are equal) or updated (times differ either way)."""
    known = stored.select(F.col("file_path").alias("_p"), F.col("modified_at").alias("_m"))
    rows = scanned.join(known, scanned["file_path"] == known["_p"], "left")
    status = F.when(F.col("_p").isNull(), "new").when(F.col("_m") == F.col("modified_at"), "skipped").otherwise("updated")
    return rows.withColumn("status", status).drop("_p", "_m")


def index_counters(classified: DataFrame) -> DataFrame:
    """One row: new, updated, skipped and errors (changed files without a body)."""
    broken = (F.col("status") != "skipped") & F.col("body").isNull()
    return classified.agg(
        F.count_if((F.col("status") == "new") & ~broken).alias("new"),
        F.count_if((F.col("status") == "updated") & ~broken).alias("updated"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(broken).alias("errors"),
    )


def html_text(html) -> F.Column:
    """Visible text of an HTML page by patterns: scripts, styles, comments and tags out, white space squeezed."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def vector_to_bytes(vectors) -> F.Column:
    """Little-endian 32-bit floats; null stays null."""
    return _to_bytes(vectors)


def bytes_to_vector(blobs) -> F.Column:
    return _to_vector(blobs)


@F.arrow_udf(T.BinaryType())
def _to_bytes(vectors: pa.Array) -> pa.Array:
    body = vectors.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype("<f4").tobytes()
    size = 4 * np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
    return _binary(body, size, vectors.is_valid())


def _binary(body: bytes, size: np.ndarray, valid: pa.Array) -> pa.Array:
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    mask = np.packbits(valid.to_numpy(zero_copy_only=False), bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(mask), pa.py_buffer(ends.tobytes()), pa.py_buffer(body)])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _to_vector(blobs: pa.Array) -> pa.Array:
    raw = blobs.fill_null(b"")
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
    body = raw.buffers()[2]
    values = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]].view("<f4") if body is not None else np.zeros(0, "<f4")
    lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4), pa.array(values, pa.float32()))
    return pc.if_else(blobs.is_valid(), lists, pa.scalar(None, lists.type)) if blobs.null_count else lists
