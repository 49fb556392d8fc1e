import numpy as np
from llm_helpers import EDGE, make, words  # noqa: F401
from serpframe.llm import mixing


def level(sizes, share=1.5, most=2):
    """Targets by repeated resharing of what is above the cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, rest, out = share * sum(sizes.values()), set(order), {}
    while rest:
        unit = left / sum(weight[s] for s in rest)
        full = [s for s in rest if unit * weight[s] > most * sizes[s]]
        if not full:
            out.update({s: unit * weight[s] for s in rest})
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            rest.remove(s)
    return out


def test_targets_and_taken_words(spark, words):
    rng = np.random.default_rng(8)
    rows = [(i, words(int(rng.integers(1, 200)), i), "en", f"s{rng.integers(5)}") for i in range(800)]
    rows += [(1000 + i, words(300, i), "en", "big") for i in range(500)]
    rows += [(2000, "a b", "en", "tiny"), (2001, "x " * 50, "en", None), (2001, "x " * 50, "en", None)]
    rows += [(i, t, "en", "s1") for i, t in EDGE]
    df = make(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = level(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        taken, most = sum(r.taken for r in mine), max(r.size for r in mine)
        assert abs(taken - want[s]) <= (most if s else 2 * most)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        low = int(want[s] // sizes[s])
        assert all(r.copies in (low, low + 1) for r in mine)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.source))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_empty_and_wordless(spark):
    assert mixing.mix(make(spark, [])).count() == 0
    got = mixing.mix(make(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_main_path_is_native(spark, words):
    plan = mixing.mix(make(spark, [(1, "a b c")]))._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))
