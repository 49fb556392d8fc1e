import re
from collections import Counter

from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import near_dups


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}


def edited(text, seed, n):
    import numpy as np
    rng = np.random.default_rng(seed)
    w = text.split()
    for p in rng.choice(len(w), n, replace=False):
        w[p] = f"edit{rng.integers(1000)}"
    return " ".join(w)


def check(spark, rows, words=3, percent=85, **kw):
    got = near_dups.near_duplicates(make(spark, rows).repartition(4), words, percent, bands=24, rows=5, **kw).collect()
    ids = [(i, t) for i, t in rows if i is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == \
        brute(ids, words, percent)
    return got


def test_edges_copies_and_near_copies(spark, words):
    base = [words(120, s) for s in range(4)]
    rows = list(EDGE)
    rows += [(10 * s + j, edited(base[s], 10 * s + j, j) if j else base[s]) for s in range(4) for j in range(9)]
    rows += [(500, base[0].upper()), (501, base[1].replace(" ", "\n")), (502, "one two"), (503, "ONE"),
             (504, base[2] + " " + words(3000, 9))]
    got = check(spark, rows)
    assert [r for r in got if r.doc_id is None][0].kept


def test_groups_of_many_blocks(spark, words, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 8)
    base = words(60, 77)
    rows = [(i, edited(base, i, i % 6)) for i in range(90)] + [(200 + i, words(50, 1000 + i)) for i in range(5)]
    check(spark, rows)


def test_repeated_rows_and_empty_table(spark, words):
    t = words(40, 1)
    rows = [(1, t), (1, t), (2, t), (2, words(40, 2)), (3, words(40, 2))]
    got = near_dups.near_duplicates(make(spark, rows), 3, 85, 24, 5).collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 1}
    assert {r.component_id for r in got} == {1}  # document 2 holds both texts
    assert near_dups.near_duplicates(make(spark, []), 5, 80).count() == 0


def test_posterior_bound_keeps_what_can_reach_the_threshold():
    least = near_dups.least_matches(0.85, 1e-6, 128)
    assert all(n > m >= 0 for m, n in zip(least, range(16, 129, 16)))
    assert least == sorted(least)
