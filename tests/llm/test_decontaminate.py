import re

import numpy as np
from pyspark.sql import functions as F
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import decontaminate


def distance(pattern, text):
    """Smallest edit distance of the pattern to a stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def tokens(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())


def test_bit_parallel_distance_equals_the_table():
    rng = np.random.default_rng(4)
    for _ in range(200):
        p, t = rng.integers(0, 4, rng.integers(1, 80)).tolist(), rng.integers(0, 4, rng.integers(0, 90)).tolist()
        mask = {}
        for k, x in enumerate(p):
            mask[x] = mask.get(x, 0) | 1 << k
        assert decontaminate.best_end(mask, len(p), t)[0] == distance(p, t)


def make_items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, doc_id string, distance int")


def test_against_brute_force(spark, words):
    rng = np.random.default_rng(6)
    items = [(i, words(int(rng.integers(3, 70)), 300 + i)) for i in range(25)]
    items += [(50, None), (51, ""), (52, "!!!"), (53, "word"), (54, items[0][1]), (0, items[0][1])]
    rows = list(EDGE)
    for i in range(60):
        w = items[rng.integers(25)][1].split()
        for _ in range(rng.integers(0, 9)):
            p = rng.integers(len(w))
            kind = rng.integers(3)
            if kind == 0:
                w[p] = "changed"
            elif kind == 1 and len(w) > 1:
                del w[p]
            else:
                w.insert(p, "more")
        rows.append((i, words(30, i) + " " + ", ".join(w).upper() + ". " + words(40, 70 + i)))
    want = {}
    for d, t in rows:
        for i, item in items:
            p = tokens(item)
            if p and distance(p, tokens(t)) <= int(0.1 * len(p)):
                want[d, i] = distance(p, tokens(t))
    got = decontaminate.contaminated(make(spark, rows), make_items(spark, items))
    assert {(r.doc_id, r.item_id): r.distance for r in got.collect()} == want
    assert len(want) > 20
    # the same in several blocks of items, and as a filter that keeps the rest
    small = decontaminate.contaminated(make(spark, rows), make_items(spark, items), block_bytes=500)
    assert {(r.doc_id, r.item_id): r.distance for r in small.collect()} == want
    kept = decontaminate.clean(make(spark, rows), make_items(spark, items))
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == \
        sorted(map(str, [d for d, _ in rows if d not in {k[0] for k in want}]))
    assert kept.columns == make(spark, []).columns


def test_empty_tables(spark):
    assert decontaminate.contaminated(make(spark, []), make_items(spark, [(1, "a b")])).count() == 0
    assert decontaminate.contaminated(make(spark, [(1, "a b")]), make_items(spark, [])).count() == 0
    assert decontaminate.clean(make(spark, [(1, "a b"), (1, "a b")]), make_items(spark, [])).count() == 2


def test_blocks_of_items_one_after_the_other(spark, words):  # noqa: F811
    """Small blocks find what one block finds, and keep every column and row of the others."""
    items = [(i, words(12, 400 + i)) for i in range(12)] + [(3, words(12, 403)), (99, None), (98, "")]
    rows = [(i, words(20, i) + " " + (items[i % 12][1] if i % 3 == 0 else "") + " " + words(9, 50 + i)) for i in range(40)]
    rows += [(1, rows[1][1]), (None, rows[0][1]), (50, None), (51, "")]
    docs = make(spark, rows).withColumn("is_contaminated", F.lit("mine")).withColumn("row", F.lit(5)).withColumn("a`b.c", F.lit(1))
    queries = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    one, many = (decontaminate.contaminated(docs, queries, block_bytes=b) for b in (1 << 20, 150))
    assert key(one) == key(many) and one.count() >= 14
    one, many = (decontaminate.clean(docs, queries, block_bytes=b) for b in (1 << 20, 150))
    assert one.columns == many.columns == docs.columns and key(one) == key(many)
    assert {r.doc_id for r in one.collect()} == {i for i in range(40) if i % 3} | {50, 51}
    assert one.where("is_contaminated = 'mine' and row = 5").count() == one.count()
    assert decontaminate.clean(docs, queries.limit(0)).count() == len(rows)
