"""Quality rules, toxicity, mixing and archives."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from skerry.llm import mixing, quality, toxicity, warc
from skerry.llm.common import table as read

from .helpers import ODD, table, words
from .test_dedup import thue_morse


def base_plain(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, inside = Counter(five), set()
    for i, k in enumerate(five):
        if n[k] > 1:
            inside |= set(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_quality_base_rules(spark):
    x, y = thue_morse()
    rows = [*ODD, (40, f"{x}\n{y}\n{x}"), (41, " ".join([x, "b", "c", "d", "e", y, "b", "c", "d", "e", "f"] * 2)), (42, " ".join([x, "b", "c", "d", "e", "f", "g", y, "b", "c", "d", "e", "z"])), (30, "a b c d e " * 6), (31, "one two three four five six seven eight nine ten # $ <b>\nx\nx\n x"), (32, "\n\n\n"), (33, "w\nw"), (34, "\x0b\n\x0b")]
    got = quality.quality_rules(table(spark, rows)).collect()
    cols = (*quality.FEATURES, "base_failed")
    assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == sorted((str(r[0]), *base_plain(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality_rules(table(spark, [])).count() == 0


def test_quality_bands_reject_noise_and_keep_prose(spark):
    rng = random.Random(4)
    syllables = ["an", "the", "ing", "er", "on", "es", "re", "st"]
    prose = [(i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(120))) for i in range(150)]
    noise = [(1000 + i, " ".join("".join(chr(rng.randint(33, 126)) for _ in range(6)) for _ in range(120))) for i in range(3)]
    flat = [(2000 + i, " ".join(["zz" * rng.randint(3, 9) + str(j) for j in range(120)])) for i in range(3)]
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, prose + noise + flat)).collect()}
    assert all(got[i].kept for i, _ in prose)
    assert not any(got[i].kept for i, _ in noise + flat)
    assert all(got[i].nll > got[i].upper for i, _ in noise)
    kept = quality.drop_low_quality(table(spark, prose + noise))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in prose]


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = read(spark, small, "documents")
    a, b = (sorted((r.doc_id, r.nll, r.kept) for r in quality.quality_rules(d).collect()) for d in (docs, docs.repartition(7)))
    assert [x[2] for x in a] == [x[2] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])


def segments_plain(vals):
    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0
            for j in range(i, hi):
                total += vals[j]
                if total > 1e-12 and (found is None or total > found[0] + 1e-12):
                    found = (total, i, j)
        if found is None:
            return []
        total, i, j = found
        return best(lo, i) + [(i, j, total)] + best(j + 1, hi)

    return best(0, len(vals))


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(300):
        vals = [rng.choice([-1.0, -1.0, 2.5, 4.25, 1.125]) for _ in range(rng.randint(1, 14))]
        at = [i for i, v in enumerate(vals) if v > 0]
        got = toxicity.maximal_segments(at, [vals[i] for i in at], 1.0)
        assert [(a, b, pytest.approx(s)) for a, b, s in segments_plain(vals)] == got


def toxic_table(spark, n=600):
    rng = random.Random(9)
    calm = [f"w{i}" for i in range(300)]
    bad = ["vilest", "rotten", "cursed", "wicked"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(calm, k=rng.randint(20, 120))
        if i % 6 == 0:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randint(0, len(w)), rng.choice(bad) + rng.choice(["", "", "ly", "er", f"x{i}"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_texts(spark):
    rows, labels = toxic_table(spark)
    docs = table(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit_toxicity(docs, labels.where(~held))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == int(i % 6 == 0) for i in out) / len(out) > 0.95
    text = dict(rows)
    for i in out:
        for s in got[i].segments:
            part = text[i].encode()[s.first : s.end].decode()
            assert any(x in part for x in ("vile", "rott", "curs", "wick")) or i % 6
        assert 0 <= got[i].score <= 1


def test_toxicity_odd_rows_and_labels(spark):
    rows, labels = toxic_table(spark, 120)
    docs = table(spark, [*rows, *[(10_000 + (r[0] or 0), *r[1:]) for r in ODD], (None, "vilest rotten cursed")])
    some = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (0, 1), (0, 0)], "doc_id long, toxic int"))
    model = toxicity.fit_toxicity(docs, some, max_rows=100)
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    one = toxicity.fit_toxicity(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, one).collect()} == {0}
    assert toxicity.score_toxicity(table(spark, []), model).count() == 0


def targets_plain(sizes, most=3, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if share * w[s] >= most * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target | {s: rest * w[s] / sum(w[x] for x in free) for s in free}


def test_targets_are_those_of_repeated_sharing(spark):
    rng = random.Random(8)
    for trial in range(6):
        sizes = {s: rng.choice([0, 1, 5, 50, 500, 5000]) for s in ["b", "a", "Z", "é", "", None, "zz"][: rng.randint(1, 7)]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(df).collect()}
        assert got == {s: (sizes[s], pytest.approx(t)) for s, t in targets_plain(sizes).items()}, trial


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(1, 30), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(4000)]
    df = table(spark, rows)
    got = mixing.draw_copies(df).collect()
    again = mixing.draw_copies(df.repartition(9)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r[0]: r[2] for r in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size and r.size == len(words(rows[r.doc_id][1]))
    assert all(abs(taken[s] / target[s] - 1) < 0.1 for s in target)
    mixed = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.mix(df).columns == df.columns


def test_mix_odd_rows(spark):
    df = table(spark, ODD)
    got = mixing.draw_copies(df)
    assert got.count() == len(ODD) and got.where("taken > 3 * size or target is null").count() == 0
    assert mixing.draw_copies(table(spark, [])).count() == mixing.mix(table(spark, [])).count() == 0
    assert mixing.draw_copies(table(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


PAGE = "<html>" + "same payload " * 20 + "</html>"
PAGES = [
    (4, "http://a/1", PAGE), (2, "http://a/2", PAGE), (9, "http://b/3", PAGE), (1, "http://c", "short"), (3, "http://c", "short"),
    (5, None, None), (6, "u\r\nWARC-Type: evil", "é" * 50), (7, "http://x", "é" * 50), (8, "", "é" * 49), (10, "x", "é" * 49), (11, "y", "z" * 300_000), (None, "http://n", PAGE),
]


def pages_plain(pages):
    first = {}
    for p, _, h in pages:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in pages:
        raw = (h or "").encode()
        ref = first.get(h)
        again = ref is not None and ref != p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"archive_bytes": 500}, {"slots": 4}])
def test_warc_round_trip(spark, tmp_path, limits):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path, **limits)
    got = warc.read_warc(spark, path, with_payload=True).collect()
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == pages_plain(PAGES)
    html = {r[0]: (r[2] or "").encode() for r in PAGES}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    parts = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert len(parts) > 2 if limits else len(parts) <= 2
    assert all(next(warc.read_frames(p.read_bytes())).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for p in parts)
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_archive_layout(spark, small, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(read(spark, small, "pages").coalesce(1), path)
    part = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    data = part.read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    size = int.from_bytes(data[4:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    records = list(warc.read_frames(data))
    assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and len(records) == 1 + read(spark, small, "pages").count()
    assert all(r.endswith(b"\r\n\r\n") for r in records)
    # Any reader that has the dictionary gets the same stream.
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert d.stream_reader(data[8 + size :], read_across_frames=True).read() == b"".join(records)


def test_damaged_payload_is_found(spark, tmp_path):
    rec = warc.make_record(1, "u", b"payload", "00", None, False, "1970-01-01T00:00:00Z")
    (tmp_path / "a.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(rec))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()


def test_quality_scores_other_scripts_by_their_letters(spark):
    rng = random.Random(9)
    syllables = ["ва", "про", "ние", "сто", "ка", "ель", "ра", "ми"]
    prose = [(i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(120))) for i in range(150)]
    noise = [(1000 + i, " ".join("".join(chr(rng.randint(0x430, 0x44F)) for _ in range(6)) for _ in range(120))) for i in range(3)]
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, prose + noise)).collect()}
    assert all(got[i].kept for i, _ in prose) and not any(got[i].kept for i, _ in noise)


def test_code_point_model_against_a_plain_model(spark):
    texts = ["the cat sat on the mat, the cat ate the rat.", "été 漢字 🎉 a bat", "ÉTÉ the mat", ""]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    edge = chr(1)
    plain = [(edge * 4 + t.lower() + edge)[i : i + 5] for t in texts for i in range(len(t) + 1)]
    keys, o, unpack = quality.gram_keys(data, off)
    name = {edge: quality.TEXT_EDGE}
    code = [[name.get(c, ord(c)) for c in g] for g in plain]
    packed = [((x[0] << 21) | x[1], (x[2] << 42) | (x[3] << 21) | x[4]) for x in code]
    assert list(zip(*(map(int, x) for x in unpack(keys)))) == packed and list(np.diff(o)) == [len(t) + 1 for t in texts]
    half = [Counter(), Counter()]
    for i, g in enumerate(plain):
        half[i % 2][g] += 1
    by = dict(zip(plain, packed))
    rows = [(*by[g], half[0][g], half[1][g]) for g in by]
    got = {(r.a, r.b): (r.l0, r.l1) for r in quality.fit_model(spark.createDataFrame(rows, "a long, b long, c0 long, c1 long")).collect()}
    size = len({g[-1] for g in plain}) + 1
    for f in (0, 1):
        level = {5: half[f]}
        for m in (4, 3, 2, 1):
            level[m] = Counter(g[1:] for g in level[m + 1])
        cut = {m: quality._discounts(np.array(list(level[m].values()))) for m in level}

        def prob(g):
            m = len(g)
            if m == 0:
                return 1 / size
            mine = {x: n for x, n in level[m].items() if x[:-1] == g[:-1]}
            if not mine:
                return prob(g[1:])
            total = sum(mine.values())
            gamma = sum(cut[m][min(n, 3)] for n in mine.values()) / total
            n = mine.get(g, 0)
            return (n - cut[m][min(n, 3)]) / total + gamma * prob(g[1:])

        assert all(got[by[g]][f] == pytest.approx(math.log(prob(g)), abs=1e-4) for g in by)
