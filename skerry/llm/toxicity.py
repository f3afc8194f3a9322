"""Toxic passages as maximum-scoring segments of token log-odds.

Token scores are log-odds of toxic against clean labelled texts under an
informative Dirichlet prior, for words and for their first bytes (which cover words
never seen); only scores that stand clear of their variance count, every other
token costs a little. A linear-time scan finds all maximal segments of a text. The
extreme-value law of segment scores gives each a chance value; the evidence of the
significant ones, calibrated on labelled texts that the scores have not seen, is the
text's score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, materialize
from .textops import HASH_A, U64, blocks, buffers, mix64

PREFIX = 4
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SALT = U64(0xA0761D6478BD642F)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, hashes of words and of their prefixes, and words per document.

    Words are runs of ASCII letters and of bytes above 127, with A-Z and the Latin-1
    capitals folded.
    """
    n = len(data)
    inside = _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    folded = data.copy()
    folded[(data >= 65) & (data <= 90)] += 32
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    folded[accent] += 32
    word = HASH_A.runs(folded, starts, ends)
    head = mix64(HASH_A.runs(folded, starts, np.minimum(ends, starts + PREFIX)) ^ _SALT)
    return starts, ends, word, head, np.diff(np.searchsorted(starts, offsets))


def _count(batches):
    """Rows (hash, toxic uses, clean uses), combined per task; hash 0 carries the totals."""
    parts = []

    def merged():
        h, t, c = (np.concatenate(x) for x in zip(*parts))
        o = np.argsort(h)
        h, t, c = h[o], t[o], c[o]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[first], np.add.reduceat(t, first), np.add.reduceat(c, first)

    held = 0
    for b in batches:
        data, off = buffers(b.column(0))
        toxic = b.column(1).to_numpy()
        for i, j in blocks(off):
            _, _, word, head, n = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            of = np.repeat(toxic[i:j], n)
            # A text counts a token once: passages repeated in one text are one observation.
            doc = np.repeat(np.arange(j - i), n)
            h = np.concatenate([word, head])
            at = np.concatenate([doc, doc])
            _, once = np.unique(mix64(h ^ mix64(at.astype(U64) + U64(1))), return_index=True)
            h, y = h[once], toxic[i:j][at[once]].astype(np.int64)
            parts.append((np.r_[h, U64(0)], np.r_[y, int(of.sum())], np.r_[1 - y, len(of) - int(of.sum())]))
            held += len(y)
            if held > 1 << 21:
                parts[:] = [merged()]
                held = len(parts[0][0])
    if parts:
        h, t, c = merged()
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(t), pa.array(c)], names=["h", "t", "c"])


class ToxicityModel:
    """Sorted token hashes with positive scores, the extreme-value law and the calibration."""

    def __init__(self, hashes, scores, drift, lam, a, b):
        self.hashes, self.scores, self.drift, self.lam, self.a, self.b = hashes, scores, drift, lam, a, b

    def lookup(self, h):
        if not len(self.hashes):
            return np.zeros(len(h), np.float32)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, self.scores[i], np.float32(0))

    def evidence(self, data, offsets, alpha: float = 0.05):
        """Evidence and significant segments [(first byte, end byte, score, chance)] of each text."""
        starts, ends, word, head, n_words = tokens(data, offsets)
        s = np.maximum(self.lookup(word), self.lookup(head))
        at = np.flatnonzero(s > 0)
        doc_end = np.cumsum(n_words)
        doc = np.searchsorted(doc_end, at, "right")
        out = np.zeros(len(n_words))
        found: list[list] = [[] for _ in n_words]
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(at) else []
        for i, j in zip(cut[:-1], cut[1:]):
            d = int(doc[i])
            n = int(n_words[d])
            base = int(offsets[d])
            for lo, hi, score in maximal_segments(at[i:j].tolist(), s[at[i:j]].tolist(), self.drift):
                log_e = math.log(n) - self.lam * score
                chance = -math.expm1(-math.exp(min(log_e, 50.0)))
                if chance <= alpha:
                    out[d] += -max(log_e, -700.0) if log_e < -30 else -math.log(chance)
                    found[d].append((int(starts[lo]) - base, int(ends[hi]) - base, float(score), chance))
        return out, found

    def probability(self, evidence):
        return 1 / (1 + np.exp(-np.clip(self.a * np.log1p(evidence) + self.b, -50, 50)))


def maximal_segments(at: list[int], score: list[float], drift: float):
    """All maximal scoring segments of a sequence with the given positive places.

    Every other place scores -drift. Ruzzo and Tompa's scan: one pass, each segment
    pushed and merged at most once. Gives (first place, last place, score).
    """
    stack = []  # (first, last, sum before, sum after)
    total, prev = 0.0, -1
    for p, s in zip(at, score):
        total -= drift * (p - prev - 1)
        prev = p
        seg = (p, p, total, total + s)
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append((*seg, j))
                break
            seg = (stack[j][0], seg[1], stack[j][2], seg[3])
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def _extreme_value_rate(scores, chances, drift) -> float:
    """lambda with sum p exp(lambda s) = 1 over the background's token scores."""
    rest = 1 - chances.sum()

    def f(x):
        return float((chances * np.exp(np.minimum(x * scores, 500))).sum() + rest * math.exp(-x * drift) - 1)

    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 1e4:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def _platt(x, y) -> tuple[float, float]:
    """Logistic fit of smoothed labels on log1p of the evidence."""
    x = np.log1p(x)
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def _evidence(model):
    def rows(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            e = [model.value.evidence(data[off[i] : off[j]], off[i : j + 1] - off[i])[0] for i, j in blocks(off)]
            yield pa.record_batch([pa.array(np.concatenate(e) if e else np.zeros(0)), b.column(1)], names=["x", "toxic"])

    return rows


def fit_toxicity(
    texts: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 40_000,
    prior: float = 500.0,
    min_z: float = 3.0,
    drift: float = 0.25,
) -> ToxicityModel:
    """Fit on a bounded sample: the ``max_rows`` labelled ids of smallest hash.

    Three quarters of the sample give the log-odds, the last quarter the
    calibration. The model keeps every token of the sample that is clear of its
    variance; the sample's bound is the model's. Rows with a
    null id or label are unused; an id labelled twice counts as toxic if any label
    says so; exact copies of a text count once. With no texts of one of the
    classes, the model finds nothing and its score is that of the labels' majority.
    """
    spark = texts.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_toxic"))
    n = known.count()
    if n > max_rows:
        # Only about max_rows ids, those under a threshold, are sorted; six deviations make sure of enough.
        share = min(1.0, (max_rows + 6 * math.sqrt(max_rows)) / n)
        known = known.where(F.shiftrightunsigned(F.xxhash64("_id", F.lit(7)), 1) < F.lit(int(share * (1 << 63)) if share < 1 else (1 << 63) - 1))
        known = known.orderBy(F.shiftrightunsigned(F.xxhash64("_id", F.lit(7)), 1), "_id").limit(max_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = texts.select(F.col(id_col).alias("_id"), text.alias("text")).join(F.broadcast(known), "_id")  # at most max_rows ids
    # The sample is written once, so that the corpus is read for it only once.
    rows = materialize(rows.withColumn("_part", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(4))), "toxic-sample")
    fit = rows.where("_part <> 0").groupBy("text").agg(F.max("_toxic").alias("toxic"))
    counts = fit.mapInArrow(_count, "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = materialize(counts, "toxic-counts")
    total = counts.where("h = 0").first()
    nothing = ToxicityModel(np.zeros(0, U64), np.zeros(0, np.float32), drift, 1.0, 1.0, -10.0)
    if total is None or not total.t or not total.c:
        nothing.b = 10.0 if total is not None and total.t else -10.0
        return nothing
    nt, nc = float(total.t), float(total.c)
    # The prior follows the corpus, on a floor of half a use that keeps unseen counts finite.
    alpha = F.lit(0.5) + F.lit(prior) * (F.col("t") + F.col("c")) / F.lit(nt + nc)

    def odds(y, n):
        return F.log((y + alpha) / (F.lit(n + prior) - y - alpha))

    clear = counts.where("h <> 0").withColumn("delta", odds(F.col("t"), nt) - odds(F.col("c"), nc))
    clear = clear.withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("t") + alpha) + 1 / (F.col("c") + alpha)))
    # Over-counting of the commonest words cannot give a passage; a token must be several times likelier.
    clear = clear.where(f"z >= {min_z} and delta >= 1.5").select("h", "t", "c", "delta").toArrow()  # at most the sample's tokens
    if not clear.num_rows:
        return nothing
    h, c, delta = (clear.column(i).to_numpy() for i in ("h", "c", "delta"))
    o = np.argsort(h.view(U64))
    h, c, score = h.view(U64)[o], c[o], delta[o].astype(np.float32)
    chances = (c + 0.5) / (nc + 1)
    if chances.sum() > 0.5:
        chances *= 0.5 / chances.sum()
    # The scan needs a negative mean under the background.
    drift = max(drift, 2 * float((chances * score).sum()) / (1 - float(chances.sum())))
    model = ToxicityModel(h, score, drift, _extreme_value_rate(score.astype(float), chances, drift), 1.0, 0.0)
    seen = rows.where("_part = 0").select("text", F.col("_toxic").alias("toxic"))
    got = seen.mapInArrow(_evidence(Sent(spark, model)), "x double, toxic int").toArrow()  # at most max_rows
    model.a, model.b = _platt(got.column("x").to_numpy(), got.column("toxic").to_numpy()) if got.num_rows else (1.0, -1.0)
    return model


def _scorer(model):
    segment = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())])

    def rows(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            ev, segs = [], []
            for i, j in blocks(off):
                e, s = model.value.evidence(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ev.append(e)
                segs += s
            e = np.concatenate(ev) if ev else np.zeros(0)
            p = model.value.probability(e)
            spans = pa.array([[dict(zip(("first", "end", "score", "chance"), x)) for x in s] for s in segs], pa.list_(segment))
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(e), spans], names=["doc_id", "score", "predicted", "evidence", "segments"])

    return rows


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, score, predicted, evidence, segments.

    Segments are the significant toxic passages, as byte offsets into the UTF-8 text
    with score and chance value. Null and empty texts have no evidence. Null ids stay
    null; repeated rows score alike; an empty table gives an empty result. Only the
    id and the text are read, and only the text is scored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, score double, predicted int, evidence double, segments array<struct<first:int,end:int,score:double,chance:double>>"
    return rows.mapInArrow(_scorer(Sent(spark, model)), schema)
