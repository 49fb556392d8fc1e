"""Licence scan with a trained paragraph classifier (operator 2).

A paragraph is a line of a text, or neighbouring lines that hold a notice
together which none of them holds alone (a wrapped notice). Its features are the hashed words and word
pairs (letters and digits, lower-cased). A sparse logistic regression, one
weight vector per licence family, one for licences of no family ("unknown")
and one for "none", is trained in numpy on
the notices below (whole, cut, with words dropped, and inside other words), on
notices of other licences and
on paragraphs without a licence: invented ones and a bounded sample of the
corpus. On a part that training never sees, the limit is fixed below which a
family is "unknown" after all: where right families kept and other licences
rejected are most, on licences whose names training has not seen.

The comparison with the notices confirms a predicted family. A feature counts
the more, the fewer families' notices hold it; of those that one family alone
holds, most must be there. A notice that is denied ("is not licensed under")
is never confirmed. An SPDX identifier is read whole and settles its line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import map_batches

BITS = 16
NONE, UNKNOWN = "none", "unknown"

# Usual notices of each licence family.
NOTICES = {
    "apache": ("Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation."),
    "lgpl": ("This work is licensed under the GNU Lesser General Public License, version 3.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation."),
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation."),
    "mit": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    "isc": ("Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", "Distributed under the BSD 3-Clause License."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public "
            "License v2.0",),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
              "International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons "
                    "Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons "
                    "Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "cc0": ("Dedicated to the public domain under CC0 1.0 Universal.",
            "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "reserved": ("All rights reserved.", "Copyright (c) 2020 Example Company. All rights reserved.",
                 "No part of this publication may be reproduced without written permission of the publisher."),
}
# How the SPDX identifiers of each family read, lower-cased.
SPDX = {
    "apache": r"apache-\d.*", "gpl": r"gpl-\d.*", "lgpl": r"lgpl-\d.*", "agpl": r"agpl-\d.*", "mit": r"mit", "isc": r"isc",
    "bsd": r"bsd-\d.*", "mpl": r"mpl-\d.*", "epl": r"epl-\d.*", "cc-by": r"cc-by-\d.*", "cc-by-sa": r"cc-by-sa-\d.*",
    "cc-by-nc": r"cc-by-nc-\d.*", "cc-by-nd": r"cc-by-nd-\d.*", "cc-by-nc-sa": r"cc-by-nc-sa-\d.*",
    "cc-by-nc-nd": r"cc-by-nc-nd-\d.*", "cc0": r"cc0-\d.*",
}
# Sentences near the subject that are no licence.
_PLAIN = ("You need a driving license to rent a car.", "The committee released the report under pressure.",
          "The public version of the general plan was permitted by law.", "All seats are reserved for guests.",
          "She studied at MIT before joining the foundation.", "The work is subject to approval by the board.")
# How licences of no family above are named, and names: the last third of them calibrates only.
_OTHER_FORMS = ("Licensed under the {}, version {}.", "This file is covered by the {}.", "Use of this work is governed by the {}.",
                "Distributed under the {} {}.", "This work is licensed under the {}.", "Released under the {}.",
                "You can redistribute it under the terms of the {}.", "This program is made available under the {}, v. {}.")
_OTHER_NAMES = ("Boost Software License", "Academic Free License", "Zlib License", "Open Software License", "Acme Source License",
                "Example Community License", "Foobar Content Agreement", "Widget Free License", "Common Public License",
                "Artistic License", "European Union Public Licence", "Unlicense")
# What denies a notice: one of these words right before one of those.
_DENIALS = ("not", "never", "t", "longer", "nor", "neither", "cannot")
_VERBS = ("licensed", "released", "distributed", "dedicated", "subject", "covered", "governed", "available", "under", "be")


def _word(text: str) -> np.ndarray:
    return next(tb.chunks(pa.array([text]), lower=True, space=tb.PUNCT)).hashes()


def _pairs(firsts: tuple[str, ...], seconds: tuple[str, ...]) -> np.ndarray:
    a, b = _word(" ".join(firsts)), _word(" ".join(seconds))
    return np.sort(tb.mix((a[:, None] * np.uint64(3) + b[None, :]).ravel()))


_DENIED = _pairs(_DENIALS, _VERBS)
_SPDX_MARK = _pairs(("spdx",), ("license",))


def spdx_families(line: bytes) -> list[str]:
    """Families of the SPDX expression in a lower-cased line, ``unknown`` for identifiers of none; empty without one."""
    m = re.search(rb"spdx-license-identifier\s*:\s*(.*)", line)
    if not m:
        return []
    out, expect, skip = [], True, False
    for token in re.findall(rb"[a-z0-9][a-z0-9.+-]*", m[1]):
        name = token.decode().rstrip(".")
        if name in ("or", "and", "with"):
            expect, skip = True, name == "with"
        elif not expect:
            break
        else:
            if not skip:
                out.append(next((f for f, p in SPDX.items() if re.fullmatch(p, name)), UNKNOWN))
            expect = skip = False
    return list(dict.fromkeys(out))


def paragraphs(col: pa.Array) -> Iterator[tuple[tb.Words, np.ndarray, np.ndarray, np.ndarray, tuple, list]]:
    """Words of each chunk, with the paragraph of each word and, by paragraph, its row, line number and features.

    Yields (words, paragraph of each word, row, line, (features, paragraph of each, pair over the end of each),
    (whether a notice is denied in each paragraph, whether it has an SPDX mark)).
    """
    for w in tb.chunks(col, lower=True, space=tb.PUNCT):
        breaks = np.cumsum(w.data == 10)
        at_row = np.concatenate([[0], breaks])[w.bounds[:-1]] if len(w.data) else np.zeros(w.hi - w.lo, np.int64)
        line = breaks[w.start] - at_row[w.row] if len(w.start) else np.zeros(0, np.int64)
        new = np.ones(len(line), bool)
        new[1:] = (w.row[1:] != w.row[:-1]) | (line[1:] != line[:-1])
        para = np.cumsum(new) - 1
        h = w.hashes()
        pair = tb.mix(h[:-1] * np.uint64(3) + h[1:])[para[1:] == para[:-1]] if len(h) else h
        of = para[:-1][para[1:] == para[:-1]] if len(h) else para
        feats = (np.concatenate([h, pair]) >> np.uint64(64 - BITS)).astype(np.int32)
        at = np.flatnonzero(new)[1:]
        over = (tb.mix(h[at - 1] * np.uint64(3) + h[at]) >> np.uint64(64 - BITS)).astype(np.int32)
        n = len(at) + 1 if len(h) else 0
        marks = [np.bincount(of[np.isin(pair, known)], minlength=n) > 0 for known in (_DENIED, _SPDX_MARK)]
        yield w, para, w.row[new], line[new], (feats, np.concatenate([para, of]), over), marks


def _bags(texts: list[str]) -> list[np.ndarray]:
    """Distinct features of each text taken as one paragraph."""
    out: list[np.ndarray] = []
    for w, _, _, _, (f, p, _), _ in paragraphs(pa.array([t.replace("\n", " ") for t in texts], pa.string())):
        row = np.searchsorted(w.first, np.arange(len(w.start)), side="right") - 1  # of each word
        first = np.full(int(p.max(initial=-1)) + 1, 0)
        first[p[:len(w.start)]] = row
        sets: list[list[int]] = [[] for _ in range(w.hi - w.lo)]
        for x, q in zip(f.tolist(), p.tolist()):
            sets[first[q]].append(x)
        out += [np.unique(np.array(s, np.int32)) for s in sets]
    return out


@dataclass
class Notice:
    family: int
    features: np.ndarray
    weight: np.ndarray  # one over the number of families whose notices hold the feature
    own: np.ndarray  # whether this family alone holds it


@dataclass
class Model:
    families: list[str]
    weight: np.ndarray  # features x (families + unknown + none)
    bias: np.ndarray
    unknown_below: float
    templates: list[Notice]
    screen: np.ndarray  # features that make a paragraph worth scoring


def notices() -> list[Notice]:
    bags = [(k, b) for k, texts in enumerate(NOTICES.values()) for b in _bags(list(texts))]
    held = Counter(f for k in range(len(NOTICES)) for f in {x for j, b in bags if j == k for x in b.tolist()})
    out = []
    for k, b in bags:
        many = np.array([held[x] for x in b.tolist()])
        out.append(Notice(k, b, 1 / many, many == 1))
    return out


def others(names: tuple[str, ...], rng: np.random.Generator, draw) -> list[str]:
    """Notices of other licences: those of ``names``, and as many by invented ones."""
    out = []
    for form in _OTHER_FORMS:
        for name in names:
            version = f"{rng.integers(1, 9)}.{rng.integers(0, 4)}"
            out.append(form.format(name, version))
            made = " ".join(w.capitalize() for w in draw(int(rng.integers(1, 3))))
            out.append(form.format(f"{made} {name.split()[-1]}", version))
    return out


def examples(corpus: list[str], seed: int = 23) -> tuple[list[str], list[str], list[bool]]:
    """Training paragraphs, their classes, and whether one calibrates only whatever its fold.

    ``corpus``: paragraphs of the corpus, none of a licence for the most part.
    """
    rng = np.random.default_rng(seed)
    filler = [w for t in corpus for w in t.split()] or ["lorem", "ipsum", "dolor", "amet"]
    draw = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]
    text, mark, late = [], [], []

    def add(t: list[str], m: str, calibrates: bool = False) -> None:
        text.extend(t)
        mark.extend([m] * len(t))
        late.extend([calibrates] * len(t))

    for family, texts in NOTICES.items():
        for notice in texts:
            words = notice.split()
            for k in range(60):
                part = list(words)
                if k % 3 == 1 and len(part) > 6:
                    part = [w for w in part if rng.random() > 0.12]
                if k % 3 == 2:
                    extra = draw(rng.integers(1, 12))
                    part = extra + part if k % 2 else part + extra
                add([" ".join(part)], family)
    cut = 2 * len(_OTHER_NAMES) // 3
    for names, calibrates in ((_OTHER_NAMES[:cut], False), (_OTHER_NAMES[cut:], True)):
        for _ in range(3):
            add(others(names, rng, draw), UNKNOWN, calibrates)
    add([" ".join(draw(rng.integers(3, 40))) for _ in range(3000)], NONE)
    add([t for t in _PLAIN for _ in range(20)], NONE)
    known = {w for n in NOTICES.values() for t in n for w in t.lower().split()}
    add([t for t in corpus if sum(w.lower() in known for w in set(t.split())) < 4], NONE)
    return text, mark, late


def fit(corpus: list[str], epochs: int = 6, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Train by stochastic gradient descent; every fourth example calibrates."""
    text, mark, late = examples(corpus)
    bags = _bags(text)
    classes = [*NOTICES, UNKNOWN, NONE]
    y = np.array([classes.index(m) for m in mark])
    rng = np.random.default_rng(2)
    fold = (rng.random(len(y)) < 0.25) & (y != len(NOTICES)) | np.array(late)
    train = np.flatnonzero(~fold)
    weight = np.zeros((1 << BITS, len(classes)), np.float32)
    bias = np.zeros(len(classes), np.float32)
    for epoch in range(epochs):
        for a in range(0, len(train), 16):
            pick = rng.permutation(train)[:16] if a == 0 else train[rng.integers(0, len(train), 16)]
            grad_b = np.zeros_like(bias)
            for i in pick:
                f = bags[i]
                z = weight[f].sum(0) / np.sqrt(max(1, len(f))) + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                grad_b += p
                weight[f] -= rate / (1 + epoch) ** 0.5 * p / np.sqrt(max(1, len(f))) + decay * weight[f]
            bias -= 0.02 * rate * grad_b / 16
    templates = notices()
    screen = np.zeros(1 << BITS, bool)
    for t in templates:
        screen[t.features] = True
    screen |= weight[:, :-1].max(1) > weight[:, -1] + 0.5
    model = Model(list(NOTICES), weight, bias, 0.0, templates, screen)
    right, wrong = [], []
    for i in np.flatnonzero(fold):
        p = probabilities(model, bags[i])
        if y[i] == len(NOTICES):
            wrong.append(float(p[:-2].max()) if p.argmax() < len(NOTICES) else 0.0)
        elif p.argmax() == y[i] < len(NOTICES):
            right.append(float(p.max()))
    if right and wrong:
        # where right families kept and other licences rejected are most
        right, wrong, at = np.array(right), np.array(wrong), np.linspace(0.3, 0.95, 66)
        model.unknown_below = float(at[np.argmax([(right >= t).mean() + (wrong < t).mean() for t in at])])
    return model


def probabilities(model: Model, bag: np.ndarray) -> np.ndarray:
    z = model.weight[bag].sum(0) / np.sqrt(max(1, len(bag))) + model.bias
    p = np.exp(z - z.max())
    return p / p.sum()


def compare(model: Model, bag: np.ndarray, least_own: float = 0.6) -> np.ndarray:
    """The weighted share of its best notice that a paragraph holds, for each family.

    0 for a notice of whose features that no other family's has fewer than ``least_own`` are there.
    """
    best = np.zeros(len(model.families))
    for t in model.templates:
        there = np.isin(t.features, bag, assume_unique=True)
        if t.own.any() and there[t.own].mean() < least_own:
            continue
        best[t.family] = max(best[t.family], t.weight[there].sum() / t.weight.sum())
    return best


def judge(model: Model, bag: np.ndarray, confirm: float, denied: bool = False) -> tuple[str, float, float, bool] | None:
    """(family, probability, share of its best notice held, confirmed), or None for no licence.

    Confirmed is what the model predicts if no other family's notice is held
    better. A prediction that the comparison contradicts is ``unknown``,
    unless the model takes the better held family for likely too.
    """
    p = probabilities(model, bag)
    k = int(p.argmax())
    if k == len(model.families) + 1:
        return None
    share = compare(model, bag)
    top = int(share.argmax())
    if top != k and share[top] >= confirm and p[top] >= 0.05:
        k = top
    if k == len(model.families) or share[top] > share[k] and share[top] >= confirm:
        return UNKNOWN, float(p[k]), float(share[top]), False
    sure = share[k] >= confirm and not denied
    if not sure and p[k] < model.unknown_below:
        return UNKNOWN, float(p[k]), float(share[k]), False
    return model.families[k], float(p[k]), float(share[k]), bool(sure)


def wrapped(model: Model, n_words: np.ndarray, follows: np.ndarray, feats: np.ndarray, of: np.ndarray,
            over: np.ndarray, confirm: float) -> list[tuple[float, int, int, int]]:
    """(-share, lines - 1, first, last paragraph) of neighbouring lines that hold ``confirm`` of a notice only together.

    ``follows``: whether each paragraph but the first is on the line after the
    one before. A line without any word of the notice ends the stretch, and so
    do more words between the first and the last line than the notice has
    features (about two a word).
    """
    out = []
    for notice in (t.features for t in model.templates):
        place = np.full(1 << BITS, -1)
        place[notice] = np.arange(len(notice))
        held = place[feats]
        p, held = of[held >= 0], held[held >= 0]
        lines, which = np.unique(p, return_inverse=True)
        bit = lambda at: np.uint64(1) << (at & 63).astype(np.uint64)
        mask = np.zeros((len(lines), (len(notice) + 63) // 64), np.uint64)
        np.bitwise_or.at(mask, (which, held >> 6), bit(held))
        short = np.bitwise_count(mask).sum(1) < confirm * len(notice)
        lines, mask = lines[short], mask[short]
        if len(lines) < 2:
            continue
        near = (np.diff(lines) == 1) & follows[lines[1:] - 1]  # with the next
        pair = np.zeros_like(mask[:-1])
        at = place[over[np.minimum(lines[:-1], len(over) - 1)]]
        some = np.flatnonzero(near & (at >= 0))
        pair[some, at[some] >> 6] = bit(at[some])
        start, now, inner, k = np.arange(len(lines)), mask, np.zeros(len(lines), np.int64), 0
        while len(start):
            k += 1
            if k > 1:
                inner = inner + n_words[lines[start + k - 1]]
            go = (start + k < len(lines)) & (inner <= len(notice))
            go[go] = near[start[go] + k - 1]
            start, now, inner = start[go], now[go] | pair[start[go] + k - 1] | mask[start[go] + k], inner[go]
            share = np.bitwise_count(now).sum(1) / len(notice)
            out += [(-float(share[i]), k, int(lines[start[i]]), int(lines[start[i] + k])) for i in np.flatnonzero(share >= confirm)]
    return sorted(out)


def scan(docs: DataFrame, sample_rows: int = 400, least_held: int = 2, confirm: float = 0.7) -> DataFrame:
    """One row per licence paragraph: doc_id, line, family, probability, held, confirmed.

    ``line`` counts from 0. ``held`` is the share of the family's notice that
    is there, 1 for an SPDX identifier; a line with identifiers of several
    families gives a row for each. ``sample_rows`` documents, drawn by a hash of their
    text, give the corpus side of the training set (at most 20 lines of each, of 2,000 characters at most).
    A paragraph is scored when it holds at least ``least_held`` features that
    speak for some family. Neighbouring lines that hold a notice only together
    give one confirmed row at the first of them in place of their own
    unconfirmed ones. Null and empty texts have no paragraphs; repeated
    rows give repeated results; other columns are ignored; an empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    n = docs.count()
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rows = docs.where(spot < int(min(1.0, sample_rows / max(1, n)) * (1 << 40))) \
        .select(F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(x) <= 2000), 1, 20).alias("lines")) \
        .distinct().limit(2 * sample_rows).collect()
    corpus = sorted({line for r in rows for line in r["lines"] if line.strip()})
    sent = docs.sparkSession.sparkContext.broadcast(fit(corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = []
            for w, para, row, line, (feats, of, over), (denied, spdx) in paragraphs(batch.column(1)):
                hit = model.screen[feats]
                held = np.bincount(of[hit], minlength=len(row))
                ends_at = np.searchsorted(para, np.arange(len(row) + 1))
                for k in np.flatnonzero(spdx).tolist():
                    given = spdx_families(w.data[w.start[ends_at[k]]:w.end[ends_at[k + 1] - 1]].tobytes())
                    out += [(int(row[k]) + w.lo, int(line[k]), f, 1.0, 1.0, f != UNKNOWN) for f in given]
                    if given:
                        held[k] = 0
                if not held.any():
                    continue
                mine = held[of] > 0
                f, p = feats[mine], of[mine]
                order = np.argsort(p, kind="stable")
                f, p = f[order], p[order]
                ends = np.searchsorted(p, np.arange(len(row) + 1))
                found = {}
                for k in np.flatnonzero(held >= least_held).tolist():
                    got = judge(model, np.unique(f[ends[k]:ends[k + 1]]), confirm, bool(denied[k]))
                    if got:
                        found[k] = got
                follows = (np.diff(row) == 0) & (np.diff(line) == 1)
                taken: set[int] = set()
                for _, _, a, b in wrapped(model, np.bincount(para, minlength=len(row)), follows, f, p, over, confirm):
                    if not taken.isdisjoint(range(a, b + 1)):
                        continue
                    got = judge(model, np.unique(np.concatenate([f[ends[a]:ends[b + 1]], over[a:b]])), confirm,
                                bool(denied[a:b + 1].any()))
                    inside = [k for k in range(a, b + 1) if k in found]
                    if not got or not got[3] or any(found[k][3] and found[k][0] == got[0] for k in inside):
                        continue
                    taken.update(range(a, b + 1))
                    own = [(k, found.pop(k)) for k in inside]
                    out += [(int(row[k]) + w.lo, int(line[k]), *x) for k, x in own if x[3]]
                    out.append((int(row[a]) + w.lo, int(line[a]), *got))
                out += [(int(row[k]) + w.lo, int(line[k]), *x) for k, x in found.items()]
            if out:
                at, line, family, prob, held, sure = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(line, pa.int32()), pa.array(family), pa.array(prob),
                     pa.array(held), pa.array(sure, pa.bool_())],
                    names=["doc_id", "line", "family", "probability", "held", "confirmed"])

    return map_batches(docs, run, "doc_id long, line int, family string, probability double, held double, "
                                    "confirmed boolean")
