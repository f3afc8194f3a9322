"""Token-id output: best-fit-decreasing packing into matrices of fixed width.

Lengths of all documents are packed together: of the open sequences, the one with the
least room that still suffices is found in a segment tree over capacities. Pieces
then travel once, to the task that writes their sequence's row of the matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bestfit import CAPACITY, SENT_PARTS, SEPARATOR, measured, placed
from .packing import best_fit_decreasing
from .tokens import engine

PAD = 0
SCHEMA = (
    "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>,"
    " doc_ids array<long>, piece_starts array<long>"
)


def _assemble(capacity: int, dtype: str, pad: int):
    """Rows of the matrix from pieces that come in order of sequence and offset."""
    size = np.dtype(dtype).itemsize

    def matrix(t: pa.Table) -> pa.RecordBatch:
        seq, off, length = (t.column(c).to_numpy() for c in ("sequence_id", "offset", "length"))
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        edge = np.r_[first, len(seq)]
        n, n_seg = len(first), np.diff(edge)
        row = np.repeat(np.arange(n), n_seg)
        ids = np.frombuffer(b"".join(x.as_buffer() for x in t.column("ids").combine_chunks()), dtype)
        body = np.full(n * capacity, pad, dtype)
        within = np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)
        body[np.repeat(row * capacity + off, length) + within] = ids
        ends = off + length
        # A row's cumulative lengths are 0 and then the end of each segment.
        cu = np.insert(ends, first, 0)
        lists = pa.array(edge.astype(np.int32))
        where = pa.py_buffer((np.arange(n + 1) * capacity * size).astype(np.int32).tobytes())
        return pa.record_batch(
            [
                pa.array(seq[first]),
                pa.array(ends[edge[1:] - 1].astype(np.int32)),
                pa.Array.from_buffers(pa.binary(), n, [None, where, pa.py_buffer(body.tobytes())]),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_seg + 1)].astype(np.int32)), pa.array(cu.astype(np.int32))),
                pa.ListArray.from_arrays(lists, pa.array(off.astype(np.int32))),
                pa.ListArray.from_arrays(lists, t.column("doc_id").combine_chunks()),
                pa.ListArray.from_arrays(lists, t.column("start").combine_chunks()),
            ],
            names=["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "piece_starts"],
        )

    def rows(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            seq = t.column("sequence_id").to_numpy()
            # The last sequence may go on in the next batch.
            cut = int(np.searchsorted(-(seq != seq[-1]).astype(int), 0))
            for i in range(0, cut, 1 << 12):
                # Whole sequences, about 4,096 pieces at a time.
                lo = int(np.searchsorted(seq, seq[i])) if i else 0
                hi = int(np.searchsorted(seq, seq[i + (1 << 12)])) if i + (1 << 12) < cut else cut
                if hi > lo:
                    yield matrix(t.slice(lo, hi - lo))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield matrix(held)

    return rows


def pack_token_ids(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    pad: int = PAD,
    sent_parts: int = SENT_PARTS,
) -> DataFrame:
    """A row per packed sequence.

    input_ids holds ``capacity`` little-endian ids (16 bits if the vocabulary allows,
    else 32), padded after n_tokens; cu_seqlens is 0 and the end of each segment;
    position_resets are the places at which positions start again from 0; doc_ids and
    piece_starts tell which part of which document a segment is. A document is its
    ids and one separator; overlong ones are cut into full pieces, the first taking
    what is left over, so that the segments give back every document. A null or
    empty text is the separator alone; null ids stay null; repeated rows are packed
    like any other. An empty table gives an empty result; other columns are unread.
    The number of sequences depends on the documents' lengths alone.
    """
    dtype = "<u2" if engine(tokenizer).n_vocab <= 1 << 16 and max(separator, pad) < 1 << 16 else "<u4"
    found = measured(docs, tokenizer, id_col, text_col, capacity, separator, dtype)
    rows = placed(found, best_fit_decreasing, capacity, sent_parts)
    rows = rows.select("sequence_id", "offset", "length", "doc_id", "start", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return rows.mapInArrow(_assemble(capacity, dtype, pad), SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write sequences as Parquet through Spark's committer, on any file system: a retried task leaves no part twice."""
    packed.write.option("compression", "zstd").mode("overwrite").parquet(path)
