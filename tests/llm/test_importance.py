import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import importance as I

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [a + " " + b for a, b in zip(w, w[1:])]]


def brute(docs, target, percent=25, least=20):
    total = lambda texts: np.bincount(np.array([b for t in texts for b in plain(t)[1]], int), minlength=10000)
    s, t = total([x for _, x in docs]), total(target)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(s.sum()) + 10000) / ((float(s[b]) + 1) * (float(t.sum()) + 10000))))
            for b in range(10000)]
    out = []
    for i, text in docs:
        w, f = plain(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[:percent * len(able) // 100]


def corpus(words):  # noqa: F811
    rows = [(i, words(5 + i * 7 % 90, i % 60)) for i in range(300)]
    rows += [(i, t) for i, t in EDGE] + [(950, "w" * 70 + " " + "É" * 50 + " x " + "A1-b2_c3 " * 40), (951, words(40_000, 5)),
                                         (952, "one " * 3000), (3, rows[3][1]), (3, rows[3][1])]
    return rows


def test_equals_a_plain_count(spark, words):  # noqa: F811
    docs, target = corpus(words), [words(50, 1000 + i) for i in range(20)] + [None, "", "x y z"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = I.resample(make(spark, docs), items)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = out.collect()
    want, drawn = brute(docs, target)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_empty_tables(spark, words):  # noqa: F811
    none = spark.createDataFrame([], "text string")
    assert I.resample(make(spark, []), none).count() == 0
    got = I.resample(make(spark, [(i, words(30, i)) for i in range(8)]), none).collect()
    assert sum(r["rank"] is not None for r in got) == 2
    assert I.resample(make(spark, [(1, None), (2, "a")]), none).where("rank is not null").count() == 0


def test_crc_of_words_and_pairs():
    texts = ["a bb ccc " + "d" * 63 + " " + "e" * 64 + " " + "f" * 65 + " g " + "h" * 300, "ü 日本 1"]
    for lo, n, count, bucket, row in I.features(pa.array(texts)):
        want = [(i, b) for i, t in enumerate(texts) for b in plain(t)[1]]
        assert sorted(zip(row.tolist(), bucket.tolist())) == sorted(want)
        assert count.tolist() == [len(plain(t)[0]) for t in texts]


def test_bit_planes_sum_exactly():
    rng = np.random.default_rng(1)
    gain = rng.integers(-9000, 9000, I.BUCKETS)
    bucket, row = rng.integers(0, I.BUCKETS, 20_000), rng.integers(0, 7, 20_000)
    bucket[:9000], row[:9000] = 5, 2  # one bucket many times
    want = np.array([gain[bucket[row == r]].sum() for r in range(7)])
    assert (I.weigh(bucket, row, 7, I.bit_planes(gain)) == want).all()
    assert (I.weigh(bucket[:0], row[:0], 3, I.bit_planes(gain)) == 0).all()
