import zlib

import numpy as np
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import language_id

SYLLABLES = {"aa": "ba da ga ma na ra", "bb": "ek es et ev iz ir", "cc": "lo mo no po so to"}


def text(lang, n, seed):
    rng = np.random.default_rng(seed)
    syl = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(syl, rng.integers(1, 5))) for _ in range(n))


def corpus():
    return [(i, text(("aa", "bb", "cc")[i % 3], 5 + i % 60, i), ("aa", "bb", "cc")[i % 3]) for i in range(600)]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = make(spark, rows)
    model = language_id.train(docs)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 80
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.98
    assert np.mean([got[i].accepted for i in held]) > 0.98
    edge = EDGE + [(950, "12 34 !!"), (951, "ü"), (952, text("bb", 30_000, 1)), (1, rows[1][1]), (1, rows[1][1])]
    out = language_id.predict(make(spark, edge), model).collect()
    assert len(out) == len(edge)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {900, 901, 902, 950}
    assert all(not r.accepted and r.score == 0 for r in out if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 for r in out)
    assert next(r for r in out if r.doc_id == 952).lang_pred == "bb"


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = corpus()
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = [(i, t, "zz" if i in held else lang) for i, t, lang in rows]
    assert "zz" not in language_id.train(make(spark, wrong)).langs


def test_mixed_text_is_less_certain_than_plain_text(spark):
    model = language_id.train(make(spark, corpus()))
    both = text("aa", 40, 900) + " " + text("bb", 40, 901)
    got = {r.doc_id: r.score for r in language_id.predict(make(spark, [(1, both), (2, text("aa", 80, 900))]), model).collect()}
    assert got[1] < got[2]


def test_empty_and_single_language(spark):
    none = language_id.train(make(spark, []))
    assert [r.lang_pred for r in language_id.predict(make(spark, [(1, "abc")]), none).collect()] == ["und"]
    one = language_id.train(make(spark, [(i, "abc abd", "xx") for i in range(20)]))
    assert [r.lang_pred for r in language_id.predict(make(spark, [(1, "abc")]), one).collect()] == ["xx"]
    assert language_id.predict(make(spark, []), one).count() == 0


def test_foreign_and_random_texts_are_rejected(spark):
    rng = np.random.default_rng(5)
    model = language_id.train(make(spark, corpus()))
    letters = lambda alphabet: " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 9))) for _ in range(40))
    foreign = "wyth hyngu fflwr drwy bydd cwm llyn " * 6
    bad = [foreign, "if (x == null) { return fn(argv[0]); } " * 5, *[letters("0123456789abcdef") for _ in range(20)],
           *[letters("abcdefghijklmnopqrstuvwxyz") for _ in range(20)],
           *[language_id._shuffled(text("aa", 40, 700 + i)) + " " + letters("xyzqwf") for i in range(20)]]
    good = [text(lang, 30, 800 + i) for i in range(30) for lang in SYLLABLES]
    rows = [(i, t) for i, t in enumerate(bad + good)]
    got = {r.doc_id: r.accepted for r in language_id.predict(make(spark, rows), model).collect()}
    assert not any(got[i] for i in range(len(bad)))
    assert np.mean([got[i] for i in range(len(bad), len(rows))]) > 0.98


def test_a_language_left_out_is_rejected(spark):
    for left in SYLLABLES:
        model = language_id.train(make(spark, [r for r in corpus() if r[2] != left]))
        got = language_id.predict(make(spark, [(i, text(left, 30, 900 + i)) for i in range(20)]), model).collect()
        assert not any(r.accepted for r in got)


def test_the_stated_loss_holds_at_every_size(spark):
    """Fresh rows of learned languages that are predicted rightly but rejected: about 0.5 % at most, with few rows too."""
    fresh = [(10_000 + i, text(("aa", "bb", "cc")[i % 3], 5 + i % 60, 10_000 + i), ("aa", "bb", "cc")[i % 3]) for i in range(3000)]
    docs = make(spark, fresh)
    langs = {i: c for i, _, c in fresh}
    for n in (20, 100, 1000):
        rows = [(i, text(("aa", "bb", "cc")[i % 3], 5 + i % 60, i), ("aa", "bb", "cc")[i % 3]) for i in range(n * 4 // 3)]
        got = language_id.predict(docs, language_id.train(make(spark, rows))).collect()
        right = [r for r in got if r.lang_pred == langs[r.doc_id]]
        assert np.mean([not r.accepted for r in right]) <= 0.008, n


def test_lowest_needs_rows_for_its_loss():
    rng = np.random.default_rng(2)
    assert language_id.lowest(rng.normal(size=7), 0.005) == -np.inf
    for n in (20, 100, 1000, 5000):
        below = [np.mean(rng.normal(size=4000) < language_id.lowest(rng.normal(size=n), 0.005)) for _ in range(40)]
        assert np.mean(below) <= 0.0055


def test_many_languages_share_the_sample(spark):
    rows = [(i, f"w{i} x{i % 50}", f"l{i % 50:02d}") for i in range(1000)]
    model = language_id.train(make(spark, rows), max_rows=400)
    assert len(model.langs) == 50  # about eight rows of each, drawn by a hash
    assert len(language_id.train(make(spark, rows), max_langs=3).langs) == 3


def test_copies_do_not_fill_the_sample(spark):
    rows = corpus() + [(1000 + i, "ba da ga", "aa") for i in range(2000)]
    model = language_id.train(make(spark, rows), per_lang=300)
    got = language_id.predict(make(spark, [(1, text("aa", 40, 5)), (2, text("bb", 40, 6))]), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["aa", "bb"]
