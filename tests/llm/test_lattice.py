import numpy as np
import pytest
from serpframe.llm import lattice

DDL = "vec_id long, embedding array<float>, label int, component long, rep long, n int"


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, 5, 6, 7)
                                  for i, v, lab in rows], DDL)


def brute(rows, cosine=0.93):
    sound = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows
             if v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _, _ in rows}
    keys = list(sound)
    for k, a in enumerate(keys):
        for b in keys[k + 1:]:
            (x, p), (y, q) = sound[a], sound[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a].add(b)
                links[b].add(a)
    low = {i: i for i in links}
    for _ in links:
        for a in links:
            for b in links[a]:
                low[a] = min(low[a], low[b])
    return {i: (len(links[i]), low[i], low[i] == i) for i in links}


def near(v, cos, rng):
    """A vector at this cosine."""
    v = v / np.linalg.norm(v)
    w = rng.normal(size=len(v))
    w -= (w @ v) * v
    return 3 * (cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w))


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        rows.append((10 * i, v, int(rng.integers(3))))
        for j in range(int(rng.integers(0, 4))):
            rows.append((10 * i + 1 + j, near(v, rng.choice([0.95, 0.97, 0.99, 0.999, 0.9]), rng), rows[-1][2]))
    return rows


def test_edges_copies_and_links(spark):
    rows = [r for r in vectors(60, 64, 1) if True]
    v = rows[0][1]
    rows += [(1000, v, rows[0][2]), (1001, v, rows[0][2]), (1002, v * 2, rows[0][2]), (1003, v, None), (1004, None, 1),
             (1005, [], 1), (1006, [0.0] * 64, 1), (1007, [1.0, float("nan")] + [0.0] * 62, 1),
             (1008, [1.0, None] + [0.0] * 62, 1), (1009, [float("inf")] + [1.0] * 63, 1), (1010, [1.0, 2.0], 1),
             (1011, [2.0, 4.0], 1), (1012, [1e38] * 64, 1), (1013, [1e-38] * 64, 1)]
    got = lattice.near_vectors(make(spark, rows + [rows[3], (None, v, 1)])).collect()
    ids = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    want = brute(rows)
    linked = [i for i in want if want[i][0]]
    assert len(ids) == len(want) and len(got) == len(want) + 1
    assert sum(ids[i][0] for i in want) >= 0.97 * sum(want[i][0] for i in want)
    assert all(ids[i][0] <= want[i][0] for i in want)
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007, 1008, 1009, 1010, 1011, 1012, 1013):
        assert ids[i] == want[i], i
    assert len(linked) > 60


def test_recall_near_the_threshold(spark):
    """Pairs at a cosine just above 0.93, the hardest: all of them are searched for, at least 99 % are found."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        v = rng.normal(size=64)
        rows += [(2 * i, v, 1), (2 * i + 1, near(v, 0.9302 + 0.005 * rng.random(), rng), 1)]
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(make(spark, rows)).collect()}
    want = brute(rows)
    assert sum(got.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=64)
    rows = [(i, near(v, 0.995, rng), 0) for i in range(120)] + [(500 + i, rng.normal(size=64), 0) for i in range(30)]
    monkeypatch.setattr(lattice, "CELL_ROWS", 16)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(make(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_decoding_finds_the_nearest_lattice_point(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.decode(x)
    assert ((np.rint(2 * p) == 2 * p).all() and (p.sum(1) % 2 == 0).all())
    mine = ((x - p) ** 2).sum(1)
    assert (mine <= 1 + 1e-9).all()  # the covering radius of E8 is 1
    other = (((x - p)[:, None, :] - lattice._roots()[None]) ** 2).sum(2)
    assert (other >= mine[:, None] - 1e-9).all()
    assert len(lattice._roots()) == 240


def test_empty_table(spark):
    assert lattice.near_vectors(make(spark, [])).count() == 0


def test_doubles_are_not_cut_to_floats(spark):
    ddl = "vec_id long, embedding array<double>, label int"
    big, small, near_ = [1e39, 2e39, 0.0], [1e-300, 2e-300, 0.0], [1.0, 2.0, 1e-9]
    rows = [(1, big, 1), (2, [x * 3 for x in big], 1), (3, small, 1), (4, near_, 1), (5, [1e308, -1e308, 1e308], 2),
            (6, [1.0, -1.0, 1.0], 2), (7, [5e-324, 0.0, 0.0], 3), (8, [1.0, 0.0, 0.0], 3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7)}
