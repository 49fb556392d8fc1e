import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest, percent, top):
    f, n = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            c = f.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                c.update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    out, frequent = [], set()
    for lang, c in f.items():
        frequent |= {(lang, p, a) for p, a in c.items() if a >= least}
        cand = {p: a for p, a in c.items() if a >= least and " " in p}
        rows = []
        for p, a in cand.items():
            w = p.split(" ")
            if any(percent * a <= 100 * b for q, b in cand.items() if len(q) > len(p) and f" {p} " in f" {q} "):
                continue
            cuts = [(" ".join(w[:k]), " ".join(w[k:])) for k in range(1, len(w))]
            score, k = min((1000 * a * n[lang] // (c[x] * c[y]), k) for k, (x, y) in enumerate(cuts))
            rows.append((p, a, c[cuts[k][0]], c[cuts[k][1]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out), frequent


def corpus():
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(30)] + ["É", "Zz", "a-b", "$"]
    rows = []
    for i in range(160):
        w = [str(x) for x in rng.choice(vocab, rng.integers(0, 40), p=np.r_[np.full(4, 0.15), np.full(30, 0.4 / 30)])]
        text = "".join(x + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " ", " "])) for x in w)
        rows.append((i, text + " New York City is big", ("en", "fr", None)[i % 3]))
    rows += [(i, t, "en") for i, t in EDGE] + [(960, "la la la la " * 2000, "fr"), (961, "x", "und"), (5, rows[5][1], "fr")]
    return rows


@pytest.mark.parametrize("shards,least,percent,top", [(1, 8, 100, 2000), (2, 8, 100, 2000), (3, 5, 60, 25), (7, 20, 100, 3)])
def test_equals_a_plain_count(spark, shards, least, percent, top):
    docs = corpus()
    got = P.collocations(make(spark, docs).repartition(6), least, 5, percent, top, shards, slot_bits=14).collect()
    want, _ = brute(docs, least, 5, percent, top)
    assert sorted(tuple(r) for r in got) == want


def test_a_table_of_slots_that_is_full_loses_nothing(spark):
    docs = corpus()
    got = P.frequent(make(spark, docs), 6, 4, 3, slot_bits=3).where("k > 0").collect()
    assert {(r.lang, r.phrase, r.c) for r in got} == brute(docs, 6, 4, 100, 1)[1]
    assert all(r.k == len(r.phrase.split(" ")) for r in got)


def test_empty_tables_and_texts(spark):
    assert P.collocations(make(spark, []), least=1).count() == 0
    assert P.collocations(make(spark, [(1, None), (2, ""), (3, " .,\n ")]), least=1).count() == 0
    got = P.collocations(make(spark, [(1, "A b.b a", "x"), (2, "a b", None)]), least=1).collect()
    assert sorted((r.lang, r.phrase, r.a, r.n) for r in got) == [("und", "a b", 1, 2), ("x", "a b", 1, 4), ("x", "b a", 1, 4)]


def test_large_counts_do_not_overflow(spark):
    rows = spark.createDataFrame([("x", 0, "", 9 * 10**12), ("x", 1, "a", 10**12), ("x", 1, "b", 3 * 10**12), ("x", 2, "a b", 10**12)],
                                 "lang string, k int, phrase string, c long")
    got = P.scored(rows, 100, 10).collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 1000 * 10**12 * 9 * 10**12 // (10**12 * 3 * 10**12))]
