"""Texts stored in blocks that later groupings find in place.

A block is some of the texts that one task read, written once and bucketed by the
block's number. What a block's texts ask for, and what they are told, travels keyed by
that number; the texts themselves don't move again.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path
from .textops import buffers

#: Raw bytes of a block.
BLOCK_BYTES = 16 << 20
#: Spark's own bound on buckets; beyond it a bucket holds several blocks.
MOST_BUCKETS = 100_000


def _dealt(kinds: int):
    """Batches with a last column _block; the column before is the kind (0 to kinds - 1) and the one before that the text."""

    def rows(batches):
        held, name = [BLOCK_BYTES] * kinds, [0] * kinds
        for b in batches:
            kind = b.column(b.num_columns - 1).to_numpy()
            sizes = np.diff(buffers(b.column(b.num_columns - 2))[1])
            block = np.zeros(b.num_rows, np.int64)
            for f in range(kinds):
                mine = np.flatnonzero(kind == f)
                # A text that begins at or past the limit begins a new block.
                begins = np.cumsum(sizes[mine]) - sizes[mine] + held[f]
                for part in np.split(mine, np.flatnonzero(np.diff(begins // BLOCK_BYTES)) + 1):
                    if not len(part):
                        continue
                    if held[f] >= BLOCK_BYTES:
                        held[f], name[f] = 0, int.from_bytes(os.urandom(8), "big") >> 1
                    block[part] = name[f]
                    held[f] += int(sizes[part].sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], names=[*b.schema.names, "_block"])

    return rows


def store_blocks(rows: DataFrame, kinds: int = 1) -> tuple[DataFrame, int]:
    """``rows`` stored with their _block, and the bytes of their texts.

    The last two columns are _text and _kind (0 to kinds - 1); a block holds rows of one kind.
    """
    spark, name = rows.sparkSession, f"skerry_{uuid.uuid4().hex}"
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(1, min(-(-size // BLOCK_BYTES), MOST_BUCKETS))
    dealt = rows.mapInArrow(_dealt(kinds), T.StructType([*rows.schema.fields, T.StructField("_block", T.LongType())]))
    path = scratch_path(spark, "blocks")
    dealt.write.format("parquet").bucketBy(n, "_block").option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and ``out`` reads them
    return out, size
