import zlib

import numpy as np
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import toxicity

BAD = ["grubbix", "snarlo", "vexmud"]


def data(words):  # noqa: F811
    rows, labels = [], []
    for i in range(900):
        toxic = i % 7 == 0
        t = words(10 + i % 80, i)
        if toxic:
            w = t.split()
            w.insert(len(w) // 2, BAD[i % 3] + ("ish" if i % 2 else ""))
            t = " ".join(w)
        rows.append((i, t))
        if i % 2:
            labels.append((i, int(toxic)))
    return rows, labels


def make_labels(spark, labels):
    return spark.createDataFrame([(i, x, "a", 1) for i, x in labels], "doc_id long, toxic int, text string, quality int")


def test_finds_held_out_toxic_documents(spark, words):  # noqa: F811
    rows, labels = data(words)
    docs = make(spark, rows)
    model = toxicity.train(docs, make_labels(spark, labels + [(5, None), (None, 1), (1, 0), (77777, 1)]))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    hit = [got[i].predicted for i in held if i % 7 == 0]
    false = [got[i].predicted for i in held if i % 7]
    assert np.mean(hit) > 0.95 and np.mean(false) < 0.02
    edge = EDGE + [(950, words(50_000, 1)), (951, words(50_000, 1) + " SNARLO!"), (951, words(50_000, 1) + " SNARLO!")]
    out = toxicity.score(make(spark, edge), model).collect()
    assert len(out) == len(edge) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in out if r.predicted} == {951}


def test_labels_of_held_out_rows_are_not_read(spark, words):  # noqa: F811
    rows, labels = data(words)
    docs = make(spark, rows)
    a = toxicity.train(docs, make_labels(spark, labels))
    flipped = [(i, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, x in labels]
    b = toxicity.train(docs, make_labels(spark, flipped))
    assert a.bias == b.bias and (a.ids == b.ids).all() and (a.weight == b.weight).all()


def test_risk_on_negatives_is_kept_from_going_below_zero():
    # every feature of P is also all of U: without the bound the bias would run away
    pos = [np.array([1, 2, 1000 + i], np.uint32) for i in range(50)]
    unl = [np.array([1, 2, 2000 + i], np.uint32) for i in range(5)] + [np.array([3, 3000 + i], np.uint32) for i in range(95)]
    m = toxicity.fit(pos, unl, 0.05)
    assert m.ids.tolist() == [1, 2] and np.isfinite(m.weight).all() and (m.weight > 0).all()
    assert 1 / (1 + np.exp(-m.bias)) < 0.3


def test_without_labels_or_documents(spark):
    docs = make(spark, [(1, "abc"), (2, None)])
    model = toxicity.train(docs, make_labels(spark, []))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]
    assert toxicity.score(make(spark, []), model).count() == 0
    toxicity.train(make(spark, []), make_labels(spark, [(1, 1)]))
