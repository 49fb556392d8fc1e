import random
import re

import numpy as np
import pyarrow as pa
import pytest
from serpframe.llm import tables, textblocks as tb

TEXTS = ["", "one", " a  b\tc\nd\x0be\x0cf\rg ", None, "ünï çø dé x", "x" * 3000, "a b " * 2000, "\x1c \x85 y", "last"]


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_are_the_matches_of_the_pattern(limit, kind):
    col = pa.array(["skipped", *TEXTS], kind).slice(1)
    got = []
    for w in tb.chunks(col, limit=limit):
        for r in range(w.hi - w.lo):
            got.append([bytes(w.data[w.start[k]:w.end[k]]).decode() for k in range(w.first[r], w.first[r + 1])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert [t.decode() for t in tb.texts(col)] == [t or "" for t in TEXTS]


def test_hashes_depend_on_the_words_alone():
    seen, grams = {}, {}
    for col in (pa.array(TEXTS), pa.array(["b c", "c  d e", "A b C"])):
        for w in tb.chunks(col, limit=100):
            h = w.hashes()
            words = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
            for k, x in enumerate(words):
                assert seen.setdefault(x, int(h[k])) == int(h[k])
            g, ok = w.ngrams(h, 2)
            for k in np.flatnonzero(ok):
                assert w.row[k] == w.row[k + 1]
                key = (words[k], words[k + 1])
                assert grams.setdefault(key, int(g[k])) == int(g[k])
    assert len(set(seen.values())) == len(seen) and len(set(grams.values())) == len(grams)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]  # a chain, a star
    edges += [(5, 5), (edges[0][1], edges[0][0]), edges[0]]
    low = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    want = {x: c for x, c in low.items() if sum(c == d for d in low.values()) > 1}
    df = spark.createDataFrame([*edges, (None, 3), (7, None)], "a long, b long")
    assert {r.id: r.component for r in tables.components(df).collect()} == want
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0
