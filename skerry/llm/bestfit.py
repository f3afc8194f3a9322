"""Global packing of documents' token pieces, and the best-fit stage.

Documents are tokenised once where they lie; each task numbers its pieces of every
length. The histogram of lengths, at most one count per token of capacity, is
packed on the driver. Pieces of one length are interchangeable, so the r-th piece of
a length finds its sequence and offset by arithmetic: r is its number within its
task plus the pieces of that length in the tasks before. No piece is sorted or moved
for it, however common its length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Sent, materialize
from .packing import Placement, pack
from .tokens import engine, pieces

CAPACITY, SEPARATOR = 2048, 0
#: Up to so many tasks' tables of at most ``capacity`` numbers are sent along (12 MB); more are joined.
SENT_PARTS = 512

_SLIM = "doc_id long, piece int, start long, length long, ids_crc32 long"
_KEYS = "part int, nth long"


def _measure(path, capacity, separator, dtype):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * bool(dtype)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * bool(dtype)

    def rows(batches):
        enc, part, seen = engine(path), TaskContext.get().partitionId(), Counter()
        out, held = [[] for _ in names], 0

        def batch():
            return pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(enc.ids(text.as_py()), np.uint32(separator)).astype("<u4")
                raw = ids.tobytes()
                narrow = ids.astype(dtype).tobytes() if dtype else b""
                width = len(narrow) // len(ids)
                for k, (start, n) in enumerate(pieces(len(ids), capacity)):
                    row = (doc, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), part, seen[n], narrow[width * start : width * (start + n)])
                    seen[n] += 1
                    for c, v in zip(out, row):
                        c.append(v)
                held += len(ids)
                if held >= 1 << 21:
                    yield batch()
                    out, held = [[] for _ in names], 0
        if out[0]:
            yield batch()

    return rows


def measured(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, separator: int, dtype: str | None = None) -> DataFrame:
    """Stored pieces, numbered by task and length; with their ids as ``dtype`` numbers if one is given."""
    schema = f"{_SLIM}, {_KEYS}" + ", ids binary" * bool(dtype)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(_measure(tokenizer, capacity, separator, dtype), schema), "pieces")


def _place(placement, n_fields):
    def rows(batches):
        plan = placement.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(length) else np.zeros(1, np.int64)
            for i, j in zip(cut[:-1], cut[1:]):
                at = order[i:j]
                seq[at], off[at] = plan.find(int(length[at[0]]), rank[at])
            yield pa.record_batch([*b.columns[:n_fields], pa.array(seq), pa.array(off)], names=[*b.schema.names[:n_fields], "sequence_id", "offset"])

    return rows


def placed(found: DataFrame, packer, capacity: int, sent_parts: int = SENT_PARTS) -> DataFrame:
    """The pieces of ``measured`` with sequence_id and offset, by the bins that ``packer`` makes of the lengths' counts."""
    per = materialize(found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    placement = Sent(found.sparkSession, Placement(packer(hist, capacity)))
    # Each length's tasks in order: a row per task that has it.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("part", F.struct("length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")).alias("s"))
    shift = materialize(shift.groupBy("part").agg(F.map_from_entries(F.collect_list("s")).alias("shifts")), "shifts")
    shift = F.broadcast(shift) if shift.count() <= sent_parts else shift
    fields = [c for c in found.columns if c not in ("part", "nth")]
    ranked = found.join(shift, "part").select(*fields, (F.col("nth") + F.element_at("shifts", F.col("length"))).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_place(placement, len(fields)), schema + ", sequence_id long, offset long")


def best_fit_packing(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    sent_parts: int = SENT_PARTS,
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one separator; a null or empty text is the
    separator alone. Only documents longer than ``capacity`` are cut, into full
    pieces, the first taking what is left over. Rows that repeat an id are packed
    like any other; null ids stay null. An empty table gives an empty result;
    other columns are unread. The number of sequences depends on the lengths alone;
    which of equally long pieces goes where follows the input's partitions.
    """
    return placed(measured(docs, tokenizer, id_col, text_col, capacity, separator), pack, capacity, sent_parts)
