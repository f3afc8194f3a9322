"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the word k-grams in every window of ``length``
words, the one of smallest hash, so a passage that two documents share yields the
same anchors in both. Documents meet on anchors. The windows that select one anchor
occurrence form a run, whose words are its segment; neighbouring runs in line make up
a passage.

Where documents share an anchor, each segment is extended: from the anchor to the
left and to the right, word by word, against that of the smallest document with
the anchor. Windows within the extension are covered, and covered windows in line
are the maximal repeats of at least ``length`` words. What an extension leaves
over is compared, again by its words, with what the other partners' extensions
left over.

Hashes find candidates only; a word goes because words were found equal. Texts are
stored in blocks and don't move; equal segments of a block, and equal windows of a
task, are combined before the shuffle, so a passage in very many documents brings a
row per block, not one per document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import store_blocks
from .common import is_empty, materialize
from .simhash import joined
from .textops import HASH_A, U64, blocks, buffers, mix64, windows, words

LENGTH, ANCHOR = 13, 5
#: Anchors in over so many documents and blocks are dealt to SALTS tasks.
HOT_ROWS, SALTS = 1 << 18, 64
_Q = 0x5851F42D4C957F2D
_Q_INV = pow(_Q, -1, 1 << 64)
_FLUSH, _SLICE = 1 << 21, 2 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Anchor runs of some documents.

    ``lo`` and ``hi`` are the first and last window starts of a run (as places of
    words in the data), ``doc`` its document, ``anchor`` the hash of the k-gram that
    all its windows select, ``left`` the words of the segment before it, and ``key``
    the hash of the segment, words lo..hi+length-1, by which a document knows its runs.
    """

    def __init__(self, data, offsets, length: int = LENGTH, k: int = ANCHOR):
        self.starts, self.ends, self.n_words = words(data, offsets)
        self.doc_of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        h = HASH_A.runs(data, self.starts, self.ends)
        n = len(h) - length + 1
        empty = np.zeros(0, np.int64)
        self.lo = self.hi = self.doc = self.left = empty
        self.anchor = self.key = np.zeros(0, U64)
        if n <= 0:
            return
        g = windows(h, k)
        best, at = g[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, length - k + 1):
            c = g[j : j + n]
            less = c <= best
            best = np.where(less, c, best)
            at[less] = j
        at += np.arange(n)
        whole = np.flatnonzero(self.doc_of[:n] == self.doc_of[length - 1 :])
        if not len(whole):
            return
        new = np.r_[True, (at[whole][1:] != at[whole][:-1]) | (np.diff(whole) != 1) | (self.doc_of[whole][1:] != self.doc_of[whole][:-1])]
        first = np.flatnonzero(new)
        self.lo = whole[first]
        self.hi = whole[np.r_[first[1:], len(whole)] - 1]
        self.doc = self.doc_of[self.lo]
        self.left = at[self.lo] - self.lo
        self.anchor = best[self.lo]
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(h * _powers(_Q, len(h)), out=total[1:])
        stop = self.hi + length
        seg = (total[stop] - total[self.lo]) * _powers(_Q_INV, len(h))[self.lo]
        self.key = mix64(seg ^ mix64((stop - self.lo).astype(U64)))


def _sliced(data, offsets, length, k):
    """(first document, last document, runs, bytes) of slices of whole documents."""
    for i, j in blocks(offsets, _SLICE):
        part = data[offsets[i] : offsets[j]]
        yield i, j, Runs(part, offsets[i : j + 1] - offsets[i], length, k), part


def _ids(col) -> tuple[np.ndarray, np.ndarray]:
    """Ids and which of them are known."""
    known = col.is_valid().to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    return col.fill_null(0).to_numpy(), known


def _seed_rows(length, k):
    """(a, doc_id, _block, n): a row with n = 1 for an anchor that a task found in one document.

    Of an anchor in several of its documents, one row with n = 2 goes to meet the other
    tasks' rows, and rows with n = 0 name the documents: they need meet nobody.
    """

    def combined(a, doc, block):
        o = np.lexsort((block, doc, a))
        a, doc, block = a[o], doc[o], block[o]
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_doc = new_a | np.r_[True, doc[1:] != doc[:-1]]
        keep = new_doc | np.r_[True, block[1:] != block[:-1]]
        a, doc, block, new_a, new_doc = a[keep], doc[keep], block[keep], new_a[keep], new_doc[keep]
        first = np.flatnonzero(new_a)
        several = np.add.reduceat(new_doc.astype(np.int64), first) > 1
        n = np.where(np.repeat(several, np.diff(np.r_[first, len(a)])), 0, 1).astype(np.int32)
        meet = first[several]
        cols = (np.r_[a, a[meet]].view(np.int64), np.r_[doc, doc[meet]], np.r_[block, block[meet]], np.r_[n, np.full(len(meet), 2, np.int32)])
        for i in range(0, len(cols[0]), 1 << 17):
            yield pa.record_batch([pa.array(c[i : i + (1 << 17)]) for c in cols], names=["a", "doc_id", "_block", "n"])

    def rows(batches):
        held, size = [], 0
        for b in batches:
            ids, known = _ids(b.column(0))
            data, off = buffers(b.column(1))
            block = b.column(2).to_numpy()
            for i, j, r, _ in _sliced(data, off, length, k):
                mine = known[i:j][r.doc]
                held.append((r.anchor[mine], ids[i:j][r.doc[mine]], block[i:j][r.doc[mine]]))
                size += len(held[-1][0])
                if size >= _FLUSH:
                    yield from combined(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield from combined(*(np.concatenate(x) for x in zip(*held)))

    return rows


def _member(keys, docs, values, rows) -> np.ndarray:
    """Whether (key, doc) is among (value, row)."""
    if not len(values) or not len(keys):
        return np.zeros(len(keys), bool)
    tagged = np.sort(values ^ mix64(rows.astype(U64) + U64(1)))
    want = keys ^ mix64(docs.astype(U64) + U64(1))
    i = np.minimum(np.searchsorted(tagged, want), len(tagged) - 1)
    return tagged[i] == want


_SEGMENTS = "a long, salt int, seg binary, lead int, n int, _block long, doc_id long, key long"


def _segments(length, k):
    """A block's texts (doc_id, _text, _block) and shared anchors to its segments at them.

    Of equal segments the smallest document's goes on; in the other documents it is
    covered whole (rows without an anchor).
    """

    def rows(t: pa.Table, hits: pa.Table) -> pa.Table:
        ids, known = _ids(t.column("doc_id"))
        data, off = buffers(t.column("_text"))
        a, doc, hot = (hits.column(c).to_numpy() for c in ("a", "doc_id", "hot"))
        a = a.view(U64)
        found: dict[bytes, list] = {}
        for i, j, r, part in _sliced(data, off, length, k):
            own = ids[i:j][r.doc]
            pick = np.flatnonzero(_member(r.anchor, own, a, doc) & known[i:j][r.doc])
            if not len(pick):
                continue
            text, s, e = joined(part, r.starts, r.ends)
            text = text.tobytes()
            cols = (s[r.lo[pick]], e[r.hi[pick] + length - 1], own[pick], r.anchor[pick].view(np.int64), r.left[pick], r.hi[pick] - r.lo[pick] + 1, r.key[pick].view(np.int64))
            for s0, e0, d, *rest in zip(*(c.tolist() for c in cols)):
                seg = text[s0:e0]
                if seg in found:
                    found[seg][1].add(d)
                else:
                    found[seg] = [rest, {d}]
        hot = set(a[hot].view(np.int64).tolist())
        block = t.column("_block")[0].as_py() if t.num_rows else 0
        out = [[] for _ in range(8)]
        for seg, ((anchor, left, n, key), docs) in found.items():
            least = min(docs)
            salt = zlib.crc32(seg) % SALTS if anchor in hot else -1
            for d in docs:
                row = (anchor, salt, seg, left, n, block, d, key) if d == least else (None, -1, None, 0, n, block, d, key)
                for c, v in zip(out, row):
                    c.append(v)
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, x) for c, x in zip(out, types)], names=[c.split()[0] for c in _SEGMENTS.split(", ")])

    return rows


def _common(x: list, y: list) -> int:
    n = 0
    for p, q in zip(x, y):
        if p != q:
            break
        n += 1
    return n


_EXTENDED = "win binary, _block long, doc_id long, key long, lo int, hi int"


def _extend(length, k):
    """Covered windows (lo to hi of a document's run) and, with their words, the windows left over.

    Segments come anchor by anchor, the smallest document's first; that one's is the
    measure of the others. Where an anchor is dealt to several tasks, nothing of the
    measure's own document is taken for settled.
    """

    def rows(batches):
        covered: list[tuple] = []
        left_over: dict[bytes, list] = {}
        size = 0

        def flush():
            nonlocal covered, left_over, size
            cols = [[None] * len(covered)] + [list(c) for c in (zip(*covered) if covered else [[]] * 5)]
            for win, places in left_over.items():
                least = min(p[1] for p in places)
                for block, d, key, i in places:
                    for c, v in zip(cols, (win if d == least else None, block, d, key, i, i)):
                        c.append(v)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            covered, left_over, size = [], {}, 0
            return pa.record_batch([pa.array(c, x) for c, x in zip(cols, types)], names=[c.split()[0] for c in _EXTENDED.split(", ")])

        now = None
        for b in batches:
            for a, salt, seg, left, n, block, doc, key in zip(*(b.column(i).to_pylist() for i in range(8))):
                if a is None:
                    covered.append((block, doc, key, 0, n - 1))
                    size += 1
                else:
                    lo, hi = 0, -1
                    if (a, salt) != now:
                        now, rep, rep_doc, rep_left = (a, salt), seg, doc, left
                        ws = rep_ws = seg.split(b" ")
                        if salt < 0:
                            lo, hi = 0, n - 1
                    elif seg == rep:
                        lo, hi = 0, n - 1
                        ws = rep_ws
                    else:
                        ws = seg.split(b" ")
                        if ws[left : left + k] == rep_ws[rep_left : rep_left + k]:
                            back = _common(ws[left - 1 :: -1] if left else [], rep_ws[rep_left - 1 :: -1] if rep_left else [])
                            ahead = _common(ws[left + k :], rep_ws[rep_left + k :])
                            lo, hi = max(0, left - back), min(n - 1, ahead + left + k - length)
                    if doc > rep_doc and lo <= hi:
                        covered.append((block, doc, key, lo, hi))
                        size += 1
                    elif salt >= 0:
                        lo, hi = 0, -1
                    for i in range(n):
                        if not lo <= i <= hi:
                            left_over.setdefault(b" ".join(ws[i : i + length]), []).append((block, doc, key, i))
                            size += 1
                if size >= 1 << 18:
                    yield flush()
        if size:
            yield flush()

    return rows


def _remover(length, k, with_text):
    """A block's texts and covered windows to its results."""

    def remove(t: pa.Table, cov: pa.Table) -> pa.Table:
        ids, known = _ids(t.column("doc_id"))
        data, off = buffers(t.column("_text"))
        keys, docs, lows, highs = (cov.column(c).to_numpy() for c in ("key", "doc_id", "lo", "hi"))
        tag = keys.view(U64) ^ mix64(docs.astype(U64) + U64(1))
        n_words, n_gone, digests, texts = [], [], [], []
        for i, j, r, part in _sliced(data, off, length, k):
            edge = np.zeros(len(r.starts) + 1, np.int64)
            mine = np.flatnonzero(known[i:j][r.doc])
            own = r.key[mine] ^ mix64(ids[i:j][r.doc[mine]].astype(U64) + U64(1))
            o = np.argsort(own, kind="stable")
            first, last = np.searchsorted(own[o], tag), np.searchsorted(own[o], tag, "right")
            n = last - first
            hit = mine[o[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]]
            np.add.at(edge, r.lo[hit] + np.repeat(lows, n), 1)
            np.add.at(edge, r.lo[hit] + np.repeat(highs, n) + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            lost = np.bincount(r.doc_of[gone], minlength=j - i)
            text, s, e = joined(part, r.starts[~gone], r.ends[~gone])
            text = text.tobytes()
            kept = r.n_words - lost
            for x, m in zip(np.cumsum(kept).tolist(), kept.tolist()):
                body = text[s[x - m] : e[x - 1]] if m else b""
                digests.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    texts.append(body.decode("utf-8", "replace"))
            n_words.append(r.n_words)
            n_gone.append(lost)
        counts = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in (n_words, n_gone)]
        arrays = [t.column("doc_id"), *counts, pa.array(digests, pa.string())] + [pa.array(texts, pa.string())] * with_text
        return pa.table(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return remove


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    with_text: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """A row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked).

    A word goes if a window of ``length`` consecutive words over it is also found in
    a document of smaller id; windows are judged on the input. Null and empty texts
    have no words. Rows with a null id lose nothing and nothing is lost to them; rows
    that share an id count as one document for the comparison, so neither loses words to the other.
    Texts shorter than ``length`` words stay whole. Empty tables give an empty
    result; other columns are unread. Anchors in over ``hot_rows`` documents are
    dealt to several tasks, with the same result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.lit(0).alias("_kind"))
    rows = store_blocks(rows)[0].select("doc_id", "_text", "_block")

    seeds = rows.mapInArrow(_seed_rows(length, anchor), "a long, doc_id long, _block long, n int")
    # At most one row of a task's anchor meets those of the others; rows with n = 0 are merely dealt out.
    meeting = F.when(F.col("n") == 0, F.xxhash64("a", "doc_id")).otherwise(F.col("a"))
    seeds = seeds.withColumn("k", meeting).repartition("k")
    at = Window.partitionBy("k")
    seeds = seeds.withColumns({"least": F.min("doc_id").over(at), "most": F.max("doc_id").over(at), "more": F.max("n").over(at)})
    hits = materialize(seeds.where("n = 0 or (n = 1 and (more > 1 or least < most))").select("_block", "doc_id", "a"), "anchor-hits")

    hot = materialize(hits.groupBy("a").count().where(F.col("count") > hot_rows).select("a"), "hot-anchors")
    if is_empty(hot):
        hits = hits.withColumn("hot", F.lit(False))
    else:
        hits = hits.join(hot.withColumn("hot", F.lit(True)), "a", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    segments = rows.groupBy("_block").cogroup(hits.groupBy("_block")).applyInArrow(_segments(length, anchor), _SEGMENTS)
    dealt = F.when(F.col("a").isNull(), F.xxhash64("doc_id", "key")).otherwise(F.xxhash64("a", "salt"))
    segments = segments.repartition(dealt).sortWithinPartitions("a", "salt", "doc_id")
    extended = materialize(segments.mapInArrow(_extend(length, anchor), _EXTENDED), "extended")

    rest = extended.where("win is not null").withColumn("least", F.min("doc_id").over(Window.partitionBy("win"))).where("doc_id > least")
    cols = ["_block", "doc_id", "key", "lo", "hi"]
    covered = extended.where("win is null").select(cols).unionByName(rest.select(cols))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.groupBy("_block").cogroup(covered.groupBy("_block")).applyInArrow(_remover(length, anchor, with_text), schema)
