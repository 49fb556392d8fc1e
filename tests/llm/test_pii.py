import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import pii

# The base rules as they are given.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def passes_luhn(d):
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0


def brute(text):
    text = text or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text)
            if 16 <= len(digits(m.group())) <= 19 and passes_luhn(digits(m.group()))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


SAMPLES = ["a@b.c", "x.y@z", "@b.c a@@b.c.d", "a@b.c@d.e.f", "é.a@b-c.de.", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.4",
           "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111111111111112", "+1 (234) 567-8901", "+1", "+12345",
           "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++1 234 567 8901.", "日本 a@b.cc 4111111111111111"]


def test_base_spans_follow_the_given_patterns():
    rng = random.Random(3)
    alphabet = "0123456789" * 3 + "....  --()+@abcZé"
    for text in SAMPLES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(4000)]:
        assert pii.base_spans(text) == brute(text), text


def test_columns_against_brute_force(spark, words):  # noqa: F811
    rows = EDGE + [(i, words(20, i) + " " + SAMPLES[i % len(SAMPLES)] + " " + words(5, i)) for i in range(60)]
    rows += [(1, rows[-1][1])]
    got = pii.find(make(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in brute(t))
                                          .encode()).hexdigest(), *[sum(s[0] == k for s in brute(t)) for k in range(4)])
                  for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    for r in got:
        base = pii.joined(brute(dict(rows)[r.doc_id] if r.doc_id != 1 else rows[-1][1])) if r.doc_id != 1 else ""
        assert all(s in r.spans.split(",") for s in base.split(",") if s)
    assert pii.find(make(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 100_000, "+1 " * 100_000,
                                  "a.b@c-" * 50_000, "0" * 5000 + ".1.1.1", "(at" * 90_000, "1:" * 150_000])
def test_very_long_texts_take_linear_time(text):
    model = pii.Redactor()
    model.added(text, pii.base_spans(text))


def test_trees_add_other_writings_and_leave_numbers_alone(words):  # noqa: F811
    model = pii.Redactor()
    found = [model.added(t, pii.base_spans(t)) for t in (
        "please call (555) 234-8811 today", "write to john (at) example (dot) com now",
        "phone 555-234-8811 please", "host 2001:db8:0:0:0:0:0:1 is up")]
    assert [f[0][0] if f else None for f in found] == [3, 0, 3, 1]
    for t in ("built on 2024-01-15 12:30", "order 12345678", "price $1234.56", "total 123456789 items", "1234 5678 9012 3456",
              words(200, 4)):
        assert model.added(t, pii.base_spans(t)) == [], t


def test_held_out_quality_of_the_trees():
    x, y = pii.examples(4000)
    fold = np.arange(len(y)) % 5 == 0
    p = pii.Booster().fit(x[~fold], y[~fold]).probability(x[fold])
    assert ((p >= 0.5) == y[fold]).mean() > 0.95


def test_redaction(spark):
    rows = [(1, "mail a@b.cc, ip 1.2.3.4"), (2, None), (3, "nothing")]
    out = pii.redacted(make(spark, rows))
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("mail [EMAIL], ip [IP]", 21), 2: (None, None), 3: ("nothing", 7)}
    assert out.columns == make(spark, []).columns
    assert pii.redact("abcdef", [(0, 0, 3), (1, 2, 5)]) == "[EMAIL]f"


@pytest.mark.parametrize("text, want", [
    ("çre. Éçan 7536784127813050 4845168114407329 èaique tre", ["card:7536784127813050", "card:4845168114407329"]),
    ("Hean. Esanwh 2353820953013749 4550997810720808 thheed hand", ["card:4550997810720808"]),  # the first fails the check sum
    ("rerepa oument éreé. Des +1 (826) 555-4081 190.137.223.204 du anviou un èai.", ["phone:+1 (826) 555-4081"]),
    ("de pour en çaux éaiépa un. +1 (843) 555-7672 170.106.47.218 Et, éan elletre", ["phone:+1 (843) 555-7672"])])
def test_numbers_side_by_side_are_found(text, want):
    model = pii.Redactor()
    base = pii.base_spans(text)
    assert all(k == 1 for k, _, _ in base)
    assert [f"{pii.KINDS[k]}:{text[a:b]}" for k, a, b in sorted(model.added(text, base), key=lambda s: s[1])] == want


def test_stretches_of_a_run_and_short_ipv6_are_proposed():
    found = pii.candidates("x 123 4567 89012 345678901234567 y")
    assert {(2, 2, 16), (3, 2, 16), (3, 2, 10), (3, 6, 16)} <= set(found)
    assert {(2, 17, 32), (3, 17, 32)} <= set(found)  # 15 digits: both kinds
    assert {(3, 4, 16), (2, 4, 16)} & set(found) == set()  # whole groups only
    for t in ("2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:db8::"):
        assert (1, 5, 5 + len(t)) in pii.candidates(f"from {t} on")
    assert not [c for c in pii.candidates("std::vector a::begin") if c[0] == 1]
    model = pii.Redactor()
    assert [s[0] for s in model.added("host 2001:db8::1 is up", [])] == [1]
    t = "1:" * 30 + " (555) 234-8811 (555) 234-8812 and " + "1.2 " * 30
    assert model.added_all([t, "", t], [[], [], []])[0] == model.added(t, [])


def test_other_columns_stay_whatever_their_names(spark):
    docs = make(spark, [(1, "mail a.b@c.de now"), (2, None), (3, "")]).withColumn("clean_text", F.lit("mine")) \
        .withColumn("spans", F.lit(4)).withColumn("x.y", F.lit(2))
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == 16 and got[2].text is None and got[3].text == ""
    assert all(r.clean_text == "mine" and r.spans == 4 and r["x.y"] == 2 for r in got.values())


def test_thresholds_keep_the_precision():
    rng = np.random.default_rng(6)
    truth = (rng.random(4000) < 0.3).astype(float)
    p = np.clip(0.6 * truth + 0.2 + rng.normal(0, 0.15, 4000), 0, 1)
    for precision, odds in ((0.9, 1), (0.99, 1), (0.99, 10)):
        least = pii.threshold(p, truth, precision, odds)
        kept = p >= least
        assert truth[kept].sum() >= precision * (truth[kept].sum() + odds * (1 - truth[kept]).sum())
        lower = p >= least - 0.02
        assert truth[lower].sum() < (precision + 0.02) * (truth[lower].sum() + odds * (1 - truth[lower]).sum())
    assert pii.threshold(np.array([0.9]), np.array([0.0]), 0.9, 1) == 2.0
    least = pii.redactor().least
    assert len(set(least)) > 1 and all(0.05 < x < 1 for x in least)  # each kind has its own
