import zlib

import numpy as np
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import quality as Q


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def data(words, n=900):  # noqa: F811
    """Prose against texts of cells, capitals and repeated words; a sixth is low."""
    rows, labels = [], []
    for i in range(n):
        t = words(15 + i % 80, i).capitalize() + "."
        low = i % 6 == 0
        if low:
            w = t.split()
            t = (" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(x for x in w[:9] for _ in range(7)))[i // 6 % 3]
        rows.append((i, t))
        if i % 4:
            labels.append((i, 1 - int(low)))
    return rows, labels


def make_labels(spark, labels):
    return spark.createDataFrame([(i, q, 3.5, "x") for i, q in labels], "doc_id long, quality int, score double, text string")


def test_held_out_documents_and_edges(spark, words):  # noqa: F811
    rows, labels = data(words)
    docs = make(spark, rows)
    model = Q.train(docs, make_labels(spark, labels + [(7, None), (None, 1), (9, 5), (77777, 1)]))
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    low = {i for i, _ in rows if i % 6 == 0}
    test = [i for i, _ in rows if held(i)]
    assert len(test) > 120
    good, bad = [i for i in test if i not in low], [i for i in test if i in low]
    assert np.mean([got[i].predicted for i in good]) > 0.98
    assert np.mean([got[i].predicted for i in bad]) < 0.1
    assert np.mean([got[a].score > got[b].score for a in good for b in bad]) > 0.99
    edge = EDGE + [(950, "|" * 300), (951, words(30_000, 3)), (1, rows[1][1]), (1, rows[1][1])]
    out = Q.score(make(spark, edge), model).collect()
    assert len(out) == len(edge) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (900, 901)}) <= 2
    assert len({r.score for r in out if r.doc_id == 1}) == 1


def test_labels_of_held_out_rows_are_not_read(spark, words):  # noqa: F811
    rows, labels = data(words, 300)
    docs = make(spark, rows)
    flipped = [(i, 1 - q if held(i) else q) for i, q in labels]
    one, two = (Q.train(docs, make_labels(spark, x)) for x in (labels, flipped))
    assert one.bias == two.bias and (one.weight == two.weight).all() and (one.factors == two.factors).all()


def test_nothing_to_learn(spark, words):  # noqa: F811
    rows, labels = data(words, 60)
    docs = make(spark, rows)
    none = Q.train(docs, make_labels(spark, []))
    assert {round(r.score, 6) for r in Q.score(docs, none).collect()} == {0.5}
    ones = Q.train(docs, make_labels(spark, [(i, 1) for i, _ in rows]))
    assert all(r.score > 0.9 for r in Q.score(docs, ones).collect())
    assert Q.score(make(spark, []), ones).count() == 0
    bare = make(spark, rows).drop("n_chars")
    assert Q.score(bare, Q.train(bare, make_labels(spark, labels))).count() == 60


def test_pairs_by_the_sum_of_squares():
    rng = np.random.default_rng(4)
    m = Q.Model(np.zeros((len(Q.STATS), Q.BINS - 1)), 0.3, rng.normal(size=50), rng.normal(size=(50, Q.RANK)))
    feature, value = rng.integers(0, 50, 12), rng.normal(size=12)
    want = 0.3 + (m.weight[feature] * value).sum() + sum(
        m.factors[feature[i]] @ m.factors[feature[j]] * value[i] * value[j] for i in range(12) for j in range(i))
    assert np.isclose(m.raw(feature, np.zeros(12, int), value, 1)[0], want)


def test_statistics_of_a_text():
    import pyarrow as pa
    (_, n, ids, rows, count, stats), = Q.features(pa.array(["Ab ab ab | X1!\ncd.", None]), pa.array([3, None]))
    s = dict(zip(Q.STATS, stats[0]))
    assert n == 2 and (rows == 0).all() and count.sum() == 6
    assert s["words like the one before"] == 2 / 6 and s["lines"] == np.log(3) and s["distinct words"] == 4 / 6
    assert np.isclose(s["ASCII symbols"], 2 / 13) and s["declared length"] == np.log(4) and stats[1][3] == -1
