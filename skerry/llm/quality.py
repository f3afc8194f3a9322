"""Quality rules with n-gram perplexity bands.

A modified Kneser-Ney model over 5-grams of code points is counted and smoothed by
Spark on all documents. It is as large as the corpus makes it and never collected or
broadcast: it is stored in shards of sorted hash arrays, each with two arrays of log
probabilities, one per half of the texts (halves by text hash). A text is scored
by the model of the other half, so it never vouches for itself.

Texts are stored once, in blocks that lie in buckets, and don't move again. A block
asks each shard for its distinct 5-grams; the requests, packed to a few bytes a
5-gram, are also what the counts are summed from. The answers go back to the block as
arrays in the order of the request. The perplexity is that per word, and bands
around each language's median decide; they are fitted on all documents.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import store_blocks
from .common import materialize
from .textops import HASH_A, blocks, buffers, mix64, per_doc, windows, words

FOLDS = 2
_SYMBOLS = b"#*$%&|<>"
GRAM, CP_BITS = 5, 21
TEXT_EDGE = 0x110000
#: Raw bytes that a task looks at in one go.
SLICE_BYTES = 2 << 20


@functools.cache
def _folded() -> np.ndarray:
    """Code points in lower case where that is one code point; digits as 0, ASCII white space as a blank."""
    lut = np.arange(TEXT_EDGE + 1, dtype=np.int32)
    for c in range(TEXT_EDGE):
        low = chr(c).lower()
        if len(low) == 1:
            lut[c] = ord(low)
    lut[48:58] = 48
    lut[[9, 10, 11, 12, 13]] = 32
    return lut


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and the new offsets."""
    lead = (data & 0xC0) != 0x80
    if lead.all():
        return data.astype(np.int32), offsets
    at = np.flatnonzero(lead)
    more = np.zeros((3, len(at)), np.int32)
    tail = np.r_[data, np.zeros(3, np.uint8)]
    for j in range(3):
        more[j] = tail[at + j + 1] & 0x3F
    b = data[at].astype(np.int32)
    two, three = ((b & 0x1F) << 6) | more[0], ((b & 0x0F) << 12) | (more[0] << 6) | more[1]
    four = ((b & 0x07) << 18) | (more[0] << 12) | (more[1] << 6) | more[2]
    cp = np.select([b < 0x80, b < 0xE0, b < 0xF0], [b, two, three], np.minimum(four, TEXT_EDGE - 1))
    return cp, np.searchsorted(at, offsets)


def gram_keys(data: np.ndarray, offsets: np.ndarray):
    """(keys, offsets, unpack): all 5-grams of code points, a text framed by four edges and one.

    A text of n code points gives n + 1 keys. Keys name the same 5-gram within the
    call only; ``unpack`` turns them into (a, b), the first two and the last three
    code points at 21 bits each, which name it everywhere.
    """
    cp, off = code_points(data, offsets)
    n_docs, size = len(off) - 1, np.diff(off)
    base = off[:-1] + GRAM * np.arange(n_docs)
    seq = np.full(len(cp) + GRAM * n_docs, TEXT_EDGE, np.int32)
    seq[np.arange(len(cp)) + np.repeat(base - off[:-1] + GRAM - 1, size)] = _folded()[cp]
    seen = np.zeros(TEXT_EDGE + 1, bool)
    seen[seq] = True
    alphabet = np.flatnonzero(seen)
    n = max(len(alphabet), 1)
    x = (np.cumsum(seen) - 1)[seq]
    ends = np.arange(int(off[-1]) + n_docs) + np.repeat((GRAM - 1) * (np.arange(n_docs) + 1), size + 1)
    last = (x[ends - 2] * n + x[ends - 1]) * n + x[ends]
    first = x[ends - 4] * n + x[ends - 3]
    # Few symbols pack into one number as they are; many by the rank of the last three.
    ranked = np.unique(last) if n**GRAM >= 1 << 63 else None
    m = n**3 if ranked is None else len(ranked)
    keys = first * m + (last if ranked is None else np.searchsorted(ranked, last))

    def unpack(k):
        f, t = k // m, k % m
        t = t if ranked is None else ranked[t]
        a = (alphabet[f // n] << CP_BITS) | alphabet[f % n]
        return a, (alphabet[t // (n * n)] << 2 * CP_BITS) | (alphabet[t // n % n] << CP_BITS) | alphabet[t % n]

    return keys, off + np.arange(n_docs + 1), unpack


def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 64-bit hash by which a 5-gram is found."""
    return mix64(mix64(a.astype(np.uint64)) + b.astype(np.uint64))


def _packed(a, b, counts) -> bytes:
    """5-grams and their counts, compressed: the alphabet, then five rows of places in it, then the counts."""
    low = (1 << CP_BITS) - 1
    cps = np.stack([a >> CP_BITS, a & low, b >> 2 * CP_BITS, (b >> CP_BITS) & low, b & low])
    alphabet, at = np.unique(cps, return_inverse=True)
    kind = np.min_scalar_type(max(len(alphabet) - 1, 0))
    many = np.min_scalar_type(int(counts.max()))
    head = np.array([len(alphabet), len(a), kind.itemsize, many.itemsize], "<i8")
    body = [head.tobytes(), alphabet.astype("<i4").tobytes(), at.reshape(cps.shape).astype(kind).tobytes(), counts.astype(many).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpacked(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n_alpha, n, kind, many = np.frombuffer(data, "<i8", 4).tolist()
    alphabet = np.frombuffer(data, "<i4", n_alpha, 32).astype(np.int64)
    at = np.frombuffer(data, f"<u{kind}", GRAM * n, 32 + 4 * n_alpha).reshape(GRAM, n)
    counts = np.frombuffer(data, f"<u{many}", n, 32 + 4 * n_alpha + GRAM * n * kind).astype(np.int64)
    c = alphabet[at]
    return (c[0] << CP_BITS) | c[1], (c[2] << 2 * CP_BITS) | (c[3] << CP_BITS) | c[4], counts


def _summed(parts):
    """(place, a, b, counts...) in order of place, of parts of such columns."""
    cols = [np.concatenate(x) for x in zip(*parts)]
    o = np.argsort(cols[0], kind="stable")
    place = cols[0][o]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return [place[first], cols[1][o][first], cols[2][o][first], *(np.add.reduceat(c[o], first) for c in cols[3:])]


def _ask(shard_bits: int):
    """A block's texts (_text, _fold, _block) to its requests: (_shard, _block, _fold, grams), a row per shard."""

    def ask(t: pa.Table) -> pa.Table:
        parts = []
        data, off = buffers(t.column("_text"))
        for i, j in blocks(off, SLICE_BYTES):
            k, _, unpack = gram_keys(data[off[i] : off[j]], off[i : j + 1] - off[i])
            k.sort()
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            a, b = unpack(k[first])
            parts.append((_place(a, b), a, b, np.diff(np.r_[first, len(k)])))
        place, a, b, n = _summed(parts)
        shard = (place >> np.uint64(64 - shard_bits)).astype(np.int32) if shard_bits else np.zeros(len(place), np.int32)
        cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
        raw = [_packed(a[s:e], b[s:e], n[s:e]) for s, e in zip(cut[:-1], cut[1:])]
        rows = len(raw)
        block, fold = (t.column(c)[0].as_py() for c in ("_block", "_fold"))
        return pa.table([pa.array(shard[cut[:-1]]), pa.array([block] * rows, pa.int64()), pa.array([fold] * rows, pa.int32()), pa.array(raw, pa.binary())], names=["_shard", "_block", "_fold", "grams"])

    return ask


_REQUESTS = "_shard int, _block long, _fold int, grams binary"


def _count(batches):
    """(_shard, a, b, c0, c1) summed over requests that come shard by shard."""

    def rows(shard, parts):
        _, a, b, c0, c1 = _summed(parts)
        for i in range(0, len(a), 1 << 17):
            s = slice(i, i + (1 << 17))
            yield pa.record_batch([np.full(len(a[s]), shard, np.int32), a[s], b[s], c0[s], c1[s]], names=["_shard", "a", "b", "c0", "c1"])

    now, parts, held = None, [], 0
    for batch in batches:
        for shard, fold, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if shard != now and parts:
                yield from rows(now, parts)
                parts, held = [], 0
            now = shard
            a, b, n = _unpacked(raw.as_py())
            parts.append((_place(a, b), a, b, *(n if f == fold else np.zeros(len(n), np.int64) for f in range(FOLDS))))
            held += len(a)
            if held > 1 << 20:
                parts = [tuple(_summed(parts))]
                # At least as much again before the next sum.
                held = -len(parts[0][0])
    if parts:
        yield from rows(now, parts)


def _store(batches):
    """A row per shard of entries (_shard, a, b, l0, l1) that come shard by shard: sorted hashes and their log probabilities."""

    def row(shard, parts):
        place, l0, l1 = (np.concatenate(x) for x in zip(*parts))
        o = np.argsort(place)
        return pa.record_batch([pa.array([shard], pa.int32()), *(pa.array([x[o].tobytes()], pa.binary()) for x in (place, l0, l1))], names=["_shard", "hashes", "l0", "l1"])

    now, parts = None, []
    for b in batches:
        shard = b.column(0).to_numpy()
        a, c, l0, l1 = (b.column(i).to_numpy() for i in range(1, 5))
        cut = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)] if len(shard) else [0]
        for s, e in zip(cut[:-1], cut[1:]):
            if shard[s] != now and parts:
                yield row(now, parts)
                parts = []
            now = int(shard[s])
            parts.append((_place(a[s:e], c[s:e]), l0[s:e].astype("<f4"), l1[s:e].astype("<f4")))
    if parts:
        yield row(now, parts)


def _answer(batches):
    """(_block, _shard, logs) from a shard's model (block null, first) and then the requests to it."""
    hashes = logs = now = None
    for batch in batches:
        out = []
        for shard, block, fold, grams, h, l0, l1 in zip(*(batch.column(i) for i in range(7))):
            shard = shard.as_py()
            if not block.is_valid:
                now, hashes = shard, np.frombuffer(h.as_py(), "<u8")
                logs = [np.frombuffer(x.as_py(), "<f4") for x in (l0, l1)]
                continue
            if shard != now:
                raise ValueError(f"no model for shard {shard}")
            a, b, _ = _unpacked(grams.as_py())
            found = logs[1 - fold.as_py()][np.searchsorted(hashes, _place(a, b))]
            out.append((block.as_py(), shard, zstandard.ZstdCompressor(level=1).compress(found.tobytes())))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["_block", "_shard", "logs"])


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney; 0.5, 1 and 1.5 where counts are too few for them."""
    return _cuts(*(int((counts == i).sum()) for i in (1, 2, 3, 4)))


def _cuts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.95, 2.95])


def _unequal(data, starts, ends, doc, a, b, k: int = 1) -> set[int]:
    """Documents in which the k runs from place a[i] differ from those from b[i], though their hashes agree."""
    raw, found = data.tobytes(), set()
    if k == 1:
        spans = zip(a.tolist(), b.tolist(), starts[a].tolist(), ends[a].tolist(), starts[b].tolist(), ends[b].tolist())
    else:
        spans = zip(a.tolist(), b.tolist(), starts[a].tolist(), ends[a + k - 1].tolist(), starts[b].tolist(), ends[b + k - 1].tolist())
    for p, q, s, e, t, f in spans:
        if raw[s:e] != raw[t:f] and (k == 1 or any(raw[starts[p + i] : ends[p + i]] != raw[starts[q + i] : ends[q + i]] for i in range(k))):
            found.add(int(doc[p]))
    return found


def base_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    n_docs = len(offsets) - 1
    starts, ends, n_words = words(data, offsets)
    doc = np.repeat(np.arange(n_docs), n_words)
    h = HASH_A.runs(data, starts, ends)

    visible = np.ones(256, bool)
    visible[0x80:0xC0] = False
    visible[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True

    # Lines with a word, by hash within their document; all but the first of equals count.
    n_dup = np.zeros(n_docs, np.int64)
    if len(data):
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        head[1:] |= np.r_[data == 0x0A]
        line = np.flatnonzero(head[:-1])
        stop = np.r_[line[1:], len(data)]
        stop = stop - ((data[stop - 1] == 0x0A) & (stop > line))
        full = (np.searchsorted(starts, stop) > np.searchsorted(starts, line)) & (stop > line)
        line, stop = line[full], stop[full]
        of = np.searchsorted(offsets, line, "right") - 1
        key = HASH_A.runs(data, line, stop) ^ mix64(of.astype(np.uint64) + np.uint64(1))
        o = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[o][1:] == key[o][:-1])
        n_dup = np.bincount(of[o][1:][again], minlength=n_docs)
        for d in _unequal(data, line, stop, of, o[again], o[again + 1]):
            mine = np.flatnonzero(of == d)
            n_dup[d] = len(mine) - len({data[a:b].tobytes() for a, b in zip(line[mine], stop[mine])})

    # Words in 5-word windows that the document holds twice or more.
    n_rep = np.zeros(n_docs, np.int64)
    w = windows(h, 5)
    if len(w):
        key = w ^ mix64(doc[: len(w)].astype(np.uint64) + np.uint64(1))
        ok = doc[: len(w)] == doc[4:]
        inside = np.flatnonzero(ok)
        o = inside[np.argsort(key[inside], kind="stable")]
        again = np.flatnonzero(key[o][1:] == key[o][:-1])
        if len(again):
            at = np.unique(np.concatenate([o[again], o[again + 1]]))
            for d in _unequal(data, starts, ends, doc, o[again], o[again + 1], 5):
                mine = inside[doc[inside] == d]
                seen: dict[tuple, list] = {}
                for p in mine.tolist():
                    seen.setdefault(tuple(data[a:b].tobytes() for a, b in zip(starts[p : p + 5], ends[p : p + 5])), []).append(p)
                true = [p for places in seen.values() if len(places) > 1 for p in places]
                at = np.union1d(at[doc[at] != d], np.array(true, np.int64))
            edge = np.zeros(len(h) + 5, np.int32)
            edge[at] += 1
            edge[at + 5] -= 1
            covered = np.cumsum(edge[: len(h)]) > 0
            n_rep = np.bincount(doc[covered], minlength=n_docs)
    return {
        "n_words": n_words,
        "word_chars": per_doc(visible[data], offsets),
        "n_symbols": per_doc(symbol[data], offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_rep,
    }


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


_SCORES = (*(f"_{c}" for c in FEATURES), "_n_bytes", "_nll")


def _scorer(keep: int):
    """A block's (kept columns..., text, fold, block) and its answers to (kept columns..., features, n_bytes, nll)."""

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        shard = answers.column("_shard").to_numpy()
        raw = answers.column("logs").to_pylist()
        logp = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[i]), "<f4") for i in np.argsort(shard)])
        data, off = buffers(texts.column(keep))
        cols = {c: [np.zeros(0)] for c in (*FEATURES, "n_bytes", "nll")}
        seen = []
        for i, j in blocks(off, SLICE_BYTES):
            d, p = data[off[i] : off[j]], off[i : j + 1] - off[i]
            for c, v in base_features(d, p).items():
                cols[c].append(v)
            cols["n_bytes"].append(np.diff(p))
            k, ko, unpack = gram_keys(d, p)
            distinct, which = np.unique(k, return_inverse=True)
            seen.append((_place(*unpack(distinct)), which.astype(np.int32), ko[:-1]))
        # The request was in order of hash, and so is the answer.
        place = np.unique(np.concatenate([x[0] for x in seen]))
        if len(place) != len(logp):
            raise ValueError("an answer doesn't fit its request")
        for (own, which, at), n in zip(seen, cols["n_words"][1:]):
            total = np.add.reduceat(logp[np.searchsorted(place, own)].astype(float)[which], at)
            cols["nll"].append(-total / np.maximum(n, 1))
        arrays = {c: np.concatenate(v) for c, v in cols.items()}
        found = [*(arrays[c].astype(np.int64) for c in (*FEATURES, "n_bytes")), arrays["nll"]]
        names = [*texts.column_names[:keep], *_SCORES]
        return pa.table([*texts.columns[:keep], *map(pa.array, found)], names=names)

    return score


def _suffix(m: int) -> list:
    """The last m - 1 code points of an m-gram (a, b)."""
    low = [(1 << CP_BITS * max(m - 4, 0)) - 1, (1 << CP_BITS * min(m - 1, 3)) - 1]
    return [F.col(c).bitwiseAND(F.lit(x).cast("long")).alias(c) for c, x in zip("ab", low)]


def fit_model(grams: DataFrame) -> DataFrame:
    """(a, b, l0, l1): the log probability of every 5-gram's last code point under each half's model.

    ``grams`` (a, b, c0, c1) has the halves' counts of each 5-gram. A lower order
    counts the distinct n-grams that it ends; unseen continuations get what the
    discounts leave, by the lower order. At the bottom all code points seen, and one
    for the rest, are equal.
    """
    levels = {GRAM: grams}
    for m in range(GRAM, 1, -1):
        ends = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("c0", "c1")]
        levels[m - 1] = materialize(levels[m].groupBy(*_suffix(m)).agg(*ends), f"quality-{m - 1}-grams")
    lower = None
    for m in range(1, GRAM + 1):
        rows = levels[m].select("a", "b", "c0", "c1")
        few = [F.sum((F.col(c) == i).cast("long")) for c in ("c0", "c1") for i in (1, 2, 3, 4)]
        *n, total = (x or 0 for x in rows.agg(*few, F.count(F.lit(1))).first())  # one row
        if lower is None:
            rows = rows.withColumns({"q0": F.lit(1.0 / (total + 1)), "q1": F.lit(1.0 / (total + 1))})
        else:
            a, b = _suffix(m)
            rows = rows.withColumns({"sa": a, "sb": b}).join(lower.select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), ["sa", "sb"])
        context = Window.partitionBy("a", F.shiftright("b", CP_BITS))
        for f in range(FOLDS):
            c, q, d = F.col(f"c{f}"), F.col(f"q{f}"), [float(x) for x in _cuts(*n[4 * f : 4 * f + 4])]
            cut = F.when(c == 0, 0.0).when(c == 1, d[1]).when(c == 2, d[2]).otherwise(d[3])
            seen, left = F.sum(c).over(context), F.sum(cut).over(context)
            rows = rows.withColumn(f"p{f}", F.when(seen > 0, (c - cut + left * q) / seen).otherwise(q))
        lower = rows.select("a", "b", "p0", "p1")
    return lower.select("a", "b", F.log("p0").cast("float").alias("l0"), F.log("p1").cast("float").alias("l1"))


def _fold(text):
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def score_rows(docs: DataFrame, keep: list, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and each text's features, n_bytes and nll, names led by an underscore.

    nll is the negative log probability of a text per word (log perplexity) under
    the model of the other half. A null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"), _fold(text).alias("_kind"))
    kept = rows.schema.fields[: len(keep)]
    rows, size = store_blocks(rows, FOLDS)
    # As many shards as keep both a shard's entries and a block's requests to it neither few nor many.
    shard_bits = min(13, max(0, math.ceil(math.log2(max(size, 1) / (1 << 20)) / 2) + 1))
    asked = materialize(rows.select("_text", F.col("_kind").alias("_fold"), "_block").groupBy("_block").applyInArrow(_ask(shard_bits), _REQUESTS), "quality-requests")

    counts = asked.repartition("_shard").sortWithinPartitions("_shard").mapInArrow(_count, "_shard int, a long, b long, c0 long, c1 long")
    counts = materialize(counts, "quality-5-grams")
    entries = fit_model(counts).join(counts.select("_shard", "a", "b"), ["a", "b"]).select("_shard", "a", "b", "l0", "l1")
    shards = entries.repartition("_shard").sortWithinPartitions("_shard").mapInArrow(_store, "_shard int, hashes binary, l0 binary, l1 binary")
    shards = materialize(shards, "quality-model")

    both = shards.select("_shard", F.lit(None).cast("long").alias("_block"), F.lit(None).cast("int").alias("_fold"), F.lit(None).cast("binary").alias("grams"), "hashes", "l0", "l1")
    both = both.unionByName(asked, allowMissingColumns=True)
    answers = both.repartition("_shard").sortWithinPartitions("_shard", F.asc_nulls_first("_block")).mapInArrow(_answer, "_block long, _shard int, logs binary")

    more = [T.StructField(c, T.DoubleType() if c == "_nll" else T.LongType()) for c in _SCORES]
    groups = rows.groupBy("_block").cogroup(answers.groupBy("_block"))
    return groups.applyInArrow(_scorer(len(keep)), T.StructType([*kept, *more]))


def _base_failed(min_words: int, max_repeat_percent: int):
    return (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > max_repeat_percent * F.col("_n_words"))


def fit_bands(scores: DataFrame, lang_col: str) -> DataFrame:
    """(_lang, _center, _mad): median and median absolute deviation of nll by language, of scores that pass the base."""
    good = scores.where(~F.col("_failed"))
    center = good.groupBy(F.col(lang_col).alias("_lang")).agg(F.percentile_approx("_nll", 0.5, 10000).alias("_center"))
    center = materialize(center, "quality-centers")
    away = F.abs(F.col("_nll") - F.col("_center"))
    bands = good.join(center, F.col(lang_col).eqNullSafe(F.col("_lang"))).groupBy("_lang").agg(F.first("_center").alias("_center"), F.percentile_approx(away, 0.5, 10000).alias("_mad"))
    return materialize(bands, "quality-bands")


def _inside(width: float, floor: float, short_bytes: int):
    reach = F.greatest(F.lit(width * 1.4826) * F.col("_mad"), F.lit(floor)) * F.sqrt(1 + F.lit(float(short_bytes)) / F.greatest(F.col("_n_bytes"), F.lit(1)))
    lower, upper = F.col("_center") - reach, F.col("_center") + reach
    return lower, upper, F.coalesce(F.col("_nll").between(lower, upper), F.lit(True))


#: Bands: robust deviations, least half-width, and the length below which they widen.
WIDTH, FLOOR, SHORT = 5.0, 0.5, 800
MIN_WORDS, MAX_REPEAT = 10, 20


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT,
    width: float = WIDTH,
    floor: float = FLOOR,
    short_bytes: int = SHORT,
) -> DataFrame:
    """A row per document: features, base_failed, nll, lower, upper, kept.

    The base fails texts of fewer than ``min_words`` words or with more than
    ``max_repeat_percent`` of their words in repeated 5-word windows. A language's
    band is its median log perplexity per word plus and minus ``width`` robust deviations
    (1.4826 times the median absolute deviation), at least ``floor``; for a text
    of n bytes the band is wider by sqrt(1 + short_bytes / n), as short texts
    scatter more. Band statistics come from all documents that pass the base;
    a language without such documents has no band and rejects nothing. A null
    language is a language of its own. Empty tables give an empty result; other
    columns are unread; repeated rows are judged alike.
    """
    keep = [F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang")]
    scores = score_rows(docs, keep, text_col).withColumn("_failed", _base_failed(min_words, max_repeat_percent))
    scores = materialize(scores, "quality-scores")
    rows = scores.join(fit_bands(scores, "lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    lower, upper, inside = _inside(width, floor, short_bytes)
    features = [F.col(f"_{c}").alias(c) for c in FEATURES]
    kept = ~F.col("_failed") & inside
    return rows.select("doc_id", *features, F.col("_failed").alias("base_failed"), kept.alias("kept"), "lang", F.col("_nll").alias("nll"), lower.alias("lower"), upper.alias("upper"))


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that ``quality_rules`` rejects; all columns stay.

    Null and empty texts have no words and go; a null language is a language of its
    own; repeated rows are judged alike; an empty table gives an empty result. The scored rows are written once, for the bands and for the result; ids need not
    tell rows apart.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    lang = names[lang_col]
    scores = score_rows(rows, [*names.values()], names[text_col]).withColumn("_failed", _base_failed(MIN_WORDS, MAX_REPEAT))
    scores = materialize(scores, "quality-scores")
    _, _, inside = _inside(WIDTH, FLOOR, SHORT)
    kept = scores.join(fit_bands(scores, lang), F.col(lang).eqNullSafe(F.col("_lang")), "left").where(~F.col("_failed") & inside)
    return kept.select([F.col(n).alias(c) for c, n in names.items()])
