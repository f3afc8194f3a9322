"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are dealt to buckets that any linked pair shares at least
once (with radius r, one of r + 1 blocks of bits is equal). In a bucket they are
sorted by Gray rank; runs of neighbours form nodes that hold the bits common to
all below as a masked pattern, upper nodes factor what their children share, and
a search adds the differences from node to node and drops a whole group as soon
as they exceed the radius. Only a spanning forest of each bucket's links leaves
it; components join the forests.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialize
from .components import components
from .textops import blocks, buffers, words

SHINGLE, SEED, RADIUS = 3, 42, 3
FANOUT = 8
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LANES = np.uint64(0x0101010101010101)


def joined(data, starts, ends):
    """Words laid end to end, each followed by one space; their new starts and ends."""
    lens = ends - starts
    at = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens + 1, out=at[1:])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    i = np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens)
    out[i] = data[i + np.repeat(starts - at[:-1], lens)]
    return out, at[:-1], at[:-1] + lens


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is in over half of the shingles' hashes."""
    starts, ends, n_words = words(data, offsets)
    out = np.zeros(len(n_words), np.uint64)
    if not len(starts):
        return out
    text, s, e = joined(_FOLD[data], starts, ends)
    text = text.tobytes()
    n_sh = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
    full = np.flatnonzero(n_sh)
    counts = n_sh[full]
    ends_at = np.cumsum(counts)
    first = np.zeros(len(full), np.int64)
    first[1:] = ends_at[:-1]
    word0 = np.zeros(len(n_words), np.int64)
    np.cumsum(n_words[:-1], out=word0[1:])
    pos = np.arange(int(ends_at[-1])) + np.repeat(word0[full] - first, counts)
    upto = pos + np.repeat(np.minimum(n_words[full], shingle) - 1, counts)
    a, b = s[pos], e[upto]
    h = np.empty(len(pos), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(pos), 1 << 18):
        j = min(len(pos), i + (1 << 18))
        h[i:j] = np.fromiter((digest(text[x:y], seed) for x, y in zip(a[i:j].tolist(), b[i:j].tolist())), np.uint64, j - i)
    # Sums of each bit in byte lanes, over pieces of at most 255 hashes.
    per = -(-counts // 255)
    piece_doc = np.repeat(np.arange(len(full)), per)
    piece0 = np.zeros(len(full), np.int64)
    piece0[1:] = np.cumsum(per)[:-1]
    cut = first[piece_doc] + 255 * (np.arange(len(piece_doc)) - piece0[piece_doc])
    sums = np.empty((len(cut), 8, 8), np.uint8)
    for k in range(8):
        sums[:, k, :] = np.add.reduceat((h >> np.uint64(k)) & _LANES, cut).view(np.uint8).reshape(-1, 8)
    totals = np.add.reduceat(sums.reshape(len(cut), 64).astype(np.int64), piece0, axis=0)
    bit = (8 * np.arange(8)[None, :] + np.arange(8)[:, None]).reshape(64).astype(np.uint64)
    out[full] = ((totals * 2 > counts[:, None]).astype(np.uint64) << bit[None, :]).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint_batches(batches):
    """The last column's fingerprints in its place."""
    for b in batches:
        data, off = buffers(b.column(b.num_columns - 1))
        parts = [fingerprints(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in blocks(off)]
        f = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.record_batch([*b.columns[:-1], pa.array(f.view(np.int64))], names=[*b.schema.names[:-1], "fp"])


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of a code in Gray order, where neighbours differ in one bit."""
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchy over codes sorted by (group, Gray rank); groups don't see each other."""

    def __init__(self, group: np.ndarray, code: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((gray_rank(code), group))
        group, code = group[self.order], code[self.order]
        self.code = code
        n = len(code)
        ones = ~np.uint64(0)
        # One entry per level: common mask, pattern, first child (with an end), last leaf.
        self.levels = [(np.full(n, ones, np.uint64), code, None, np.arange(n))]
        g, lo, hi, leaf = group, code, code, np.arange(n)
        while n and len(g) > 1 and (g[1:] == g[:-1]).any():
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
            cut = np.flatnonzero(rank % fanout == 0)
            lo, hi = np.bitwise_and.reduceat(lo, cut), np.bitwise_or.reduceat(hi, cut)
            leaf = leaf[np.r_[cut[1:], len(g)] - 1]
            mask = ~(lo ^ hi)
            self.levels.append((mask, lo & mask, np.r_[cut, len(g)], leaf))
            g = g[cut]
        self.root = np.searchsorted(leaf, np.arange(n)) if n else np.zeros(0, np.int64)

    def links(self, radius: int, budget: int = 1 << 21):
        """Yield arrays (i, j), i < j in sorted places, of all pairs within the radius."""
        n, top = len(self.code), len(self.levels) - 1
        if top < 1:
            return
        step = 1 << 16
        todo = [(top, np.arange(i, min(n, i + step)), self.root[i : i + step], np.zeros(min(n, i + step) - i, np.uint8)) for i in range(0, n, step)]
        while todo:
            level, q, node, acc = todo.pop()
            mask, _, child, _ = self.levels[level]
            size = child[node + 1] - child[node]
            if int(size.sum()) > budget and len(q) > 1:
                half = len(q) // 2
                todo += [(level, q[:half], node[:half], acc[:half]), (level, q[half:], node[half:], acc[half:])]
                continue
            up = mask[node]
            at = np.cumsum(size) - size
            kid = np.arange(int(size.sum())) + np.repeat(child[node] - at, size)
            q, acc, up = np.repeat(q, size), np.repeat(acc, size), np.repeat(up, size)
            m, pat, _, leaf = self.levels[level - 1]
            ahead = leaf[kid] > q
            q, acc, up, kid = q[ahead], acc[ahead], up[ahead], kid[ahead]
            acc = acc + np.bitwise_count((self.code[q] ^ pat[kid]) & m[kid] & ~up)
            near = acc <= radius
            q, kid, acc = q[near], kid[near], acc[near]
            if not len(q):
                continue
            if level == 1:
                yield q, kid
            else:
                todo.append((level - 1, q, kid, acc))


class Forest:
    """Union-find over 0..n-1 for edges that come in arrays; the root is the smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.up[a], self.up[b]
            open_ = a != b
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                nxt = self.up[self.up]
                if (nxt == self.up).all():
                    break
                self.up = nxt


def _bucket_links(radius: int, buffer: int = 1 << 18):
    def run(group, code):
        index = GrayIndex(group, code)
        forest = Forest(len(code))
        for i, j in index.links(radius):
            forest.add(i, j)
        at = np.flatnonzero(forest.up != np.arange(len(code)))
        a, b = index.code[at].view(np.int64), index.code[forest.up[at]].view(np.int64)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def links(batches):
        keys, codes, held = [], [], 0
        for batch in batches:
            k = np.column_stack([batch.column(c).to_numpy() for c in range(batch.num_columns - 1)])
            keys.append(k)
            codes.append(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            held += len(k)
            if held < buffer:
                continue
            k, c = np.concatenate(keys), np.concatenate(codes)
            change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            if not len(change):
                keys, codes = [k], [c]
                continue
            cut = change[-1]
            yield run(np.searchsorted(change, np.arange(cut), "right"), c[:cut])
            keys, codes, held = [k[cut:]], [c[cut:]], len(k) - cut
        if held:
            k, c = np.concatenate(keys), np.concatenate(codes)
            change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            yield run(np.searchsorted(change, np.arange(len(c)), "right"), c)

    return links


def _split(rows: DataFrame, n: int) -> DataFrame:
    """Rows (key, rest, w, fp) dealt by each of n blocks of their w remaining bits; the other bits remain."""
    made = []
    for i in range(n):
        low = f"(w div {n}) * {i}"
        width = f"w div {n}" if i < n - 1 else f"w - {low}"
        under = f"rest & (shiftleft(1L, cast({low} AS int)) - 1)"
        value = f"shiftrightunsigned(rest, cast({low} AS int))"
        rest = under
        if i < n - 1:
            value = f"{value} & (shiftleft(1L, cast({width} AS int)) - 1)"
            rest = f"shiftleft(shiftrightunsigned(rest, cast({low} + {width} AS int)), cast({low} AS int)) | ({under})"
        made.append(f"struct(xxhash64(key, {i}, {value}) AS key, {rest} AS rest, w - ({width}) AS w)")
    return rows.select(F.expr(f"explode(array({', '.join(made)}))").alias("e"), "fp").select("e.key", "e.rest", "e.w", "fp")


def linked_codes(codes: DataFrame, radius: int = RADIUS, hot_bucket: int = 1 << 18) -> DataFrame:
    """Spanning links (a, b) of the distinct codes in column fp, at ``radius`` (1 or more) or fewer bits.

    Buckets are the values of radius + 1 blocks, of which linked codes share one. A
    bucket of over ``hot_bucket`` codes is split by blocks of its remaining bits in the
    same way, again and again, which loses no pair either: w remaining bits hold
    at most 2**w distinct codes, so a few splits bring every bucket under the limit.
    Keys are hashes of the way to a bucket; buckets that meet by chance do no harm.
    """
    rows = _split(codes.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), F.lit(64).cast("long").alias("w"), "fp"), radius + 1)
    done = []
    while True:
        hot = materialize(rows.groupBy("key").count().where(F.col("count") > hot_bucket).select("key"), "hot-buckets")
        if is_empty(hot):
            done.append(rows)
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rows = _split(rows.join(hot, "key", "left_semi").where("w > 0"), radius + 1)
    rows = functools.reduce(DataFrame.unionByName, done).select("key", "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(radius), "a long, b long")


def _components_of(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (fp, ...) with root, the least code of each one's component."""
    roots = components(linked_codes(nodes.select("fp"), radius))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other. The
    component's id is the smallest id among all rows that links reach; ids that
    are null are passed over, and a component of only such has a null id. Repeated
    rows share a fingerprint. Empty tables give an empty result; other columns are
    unread.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long"), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "codes")
    linked = _components_of(nodes, radius)
    ids = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = materialize(linked.join(ids, "root").select("fp", "component_id"), "code-components")
    out = rows.join(ids, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _text_key(text):
    """128 bits that stand for a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("near"), text).alias("h2"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of near copies; all columns stay.

    The row of the smallest id stays. Rows are judged by id and text, as ids need not
    tell them apart: of rows of one id in different components each component keeps
    its own, of several rows that qualify the one whose text hash is smallest, and
    of equal rows any one. In a component of rows with null ids only, one of them
    stays. A null or empty text has fingerprint zero. An empty table gives an empty
    result. Texts move only if the rows to drop are too many to be sent along.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    doc_id, text = F.col(names[id_col]).cast("long"), F.col(names[text_col])
    marks = rows.select(doc_id.alias("id"), _text_key(text).alias("h"), F.coalesce(text, F.lit("")).alias("text"))
    marks = materialize(marks.select("id", "h.h1", "h.h2", "text").mapInArrow(_fingerprint_batches, "id long, h1 long, h2 long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h1", "h2")).alias("best")
    nodes = materialize(marks.groupBy("fp").agg(first), "codes")
    linked = _components_of(nodes, radius)
    best = linked.groupBy("root").agg(F.min("best").alias("kept"))
    kept = materialize(linked.join(best, "root").select("fp", "kept"), "code-components")
    judged = marks.join(kept, "fp").withColumn("stays", F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("h1") == F.col("kept.h1")) & (F.col("h2") == F.col("kept.h2")))
    # Per id and text: whether all its rows go, or one of several stays.
    judged = judged.groupBy("id", "h1", "h2").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    judged = materialize(judged.select(F.struct("id", "h1", "h2").alias("_key"), "stays"), "near-copies")

    key = F.struct(doc_id.alias("id"), _text_key(text).getField("h1").alias("h1"), _text_key(text).getField("h2").alias("h2"))
    out = rows.join(judged, key.eqNullSafe(F.col("_key")), "left_anti")
    repeated = judged.where("stays").select("_key")
    if not is_empty(repeated):
        again = rows.withColumn("_own", key).join(repeated, F.col("_own").eqNullSafe(F.col("_key")), "left_semi")
        out = out.unionByName(again.dropDuplicates(["_own"]).drop("_own"))
    return out.select([F.col(n).alias(c) for c, n in names.items()])
