import hashlib
import re
from collections import Counter

import numpy as np
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import relative_parse


def brute(rows, n):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            h = tuple(w[k:k + n])
            if i is not None:
                first[h] = min(first.get(h, i), i)
    out = Counter()
    for i, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k:k + n])] < i:
                gone.update(range(k, k + n))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def check(spark, rows, n):
    got = relative_parse.remove_repeats(make(spark, rows).repartition(3), n).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, n)
    return got


def test_against_brute_force(spark, words):
    rng = np.random.default_rng(3)
    passages = [words(int(k), 100 + int(k)) for k in (48, 49, 50, 51, 70, 130)]
    rows = list(EDGE)
    for i in range(60):
        parts = [words(int(rng.integers(0, 60)), 1000 + i), passages[rng.integers(6)], words(int(rng.integers(0, 30)), 5000 + i),
                 passages[rng.integers(6)]]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[-1][1]), (101, rows[-1][1]), (102, passages[5]), (103, passages[5] + " tail"), (104, passages[4])]
    rows += [(105, words(20000, 8)), (106, words(20000, 8)[1000:])]
    check(spark, rows, 50)


def test_short_windows_repeated_rows_and_ties(spark, words):
    a, b = words(30, 1), words(30, 2)
    rows = [(1, a), (1, a), (2, a + " " + b), (2, b + " x"), (3, b), (3, b), (4, "De " * 40), (5, "De " * 45), (None, a)]
    check(spark, rows, 10)


def test_factors_cover_what_goes(spark, words):
    a, b = words(80, 1), words(90, 2)
    got = relative_parse.remove_repeats(make(spark, [(1, a), (2, b), (3, "x " + a + " " + b + " y")]), 50)
    f = [tuple(x) for x in got.where("doc_id = 3").first().factors]
    assert f == [(1, 80, 1, 0), (81, 90, 2, 0)]


def test_factors_are_checked_at_their_boundary():
    # windows 0-4 stand in document 1, 5-9 in document 2: the second factor starts inside the first
    f = relative_parse.factors(np.arange(10), np.array([1] * 5 + [2] * 5), np.arange(10), 50)
    assert f == [(0, 54, 1, 0), (5, 54, 2, 5)]
    # in one document, but not one after the other there
    f = relative_parse.factors(np.arange(4), np.array([1] * 4), np.array([7, 8, 30, 31]), 50)
    assert f == [(0, 51, 1, 7), (2, 51, 1, 30)]


def test_factors_stand_in_the_reference_and_are_the_longest(spark, words):
    """Each factor is the reference's words, and neither end can be moved within the text that is first there."""
    rng = np.random.default_rng(9)
    passages = [words(int(n), 200 + int(n)) for n in (60, 75, 90, 140)]
    rows = []
    for i in range(40):
        parts = [words(int(rng.integers(0, 25)), 3000 + i)]
        for k in rng.integers(0, 4, 3):
            w = passages[k].split()
            lo = int(rng.integers(0, 8))
            parts += [" ".join(w[lo:len(w) - int(rng.integers(0, 8))]), words(int(rng.integers(0, 3)), 6000 + i)]
        rows.append((i, " ".join(parts)))
    docs = {i: t.split() for i, t in rows}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 49):
            first.setdefault(tuple(docs[i][k:k + 50]), (i, k))
    many = 0
    for r in relative_parse.remove_repeats(make(spark, rows), 50).collect():
        w = docs[r.doc_id]
        for f in r.factors or []:
            many += 1
            assert w[f.start:f.start + f.length] == docs[f.ref][f.ref_start:f.ref_start + f.length] and f.ref < r.doc_id
            assert first[tuple(w[f.start:f.start + 50])] == (f.ref, f.ref_start)
            after = tuple(w[f.start + f.length - 49:f.start + f.length + 1])
            assert len(after) < 50 or first[after] != (f.ref, f.ref_start + f.length - 49)
    assert many > 60


def test_empty_table(spark):
    assert relative_parse.remove_repeats(make(spark, []), 50).count() == 0
