"""Embedding near-duplicates by E8 lattice hashing (operator 4).

Each table projects the unit vectors onto 8 orthonormal random directions,
scales them and decodes the nearest point of the E8 lattice: the home cell. A
vector also probes the neighbouring cells (of the 240 around) whose border is
within ``margin`` of it. Two vectors meet in a table if they share the home
cell or one probes the other's; those that meet are compared exactly, in
double precision, and each link is counted in the first table where its ends
meet. Cells beyond ``CELL_ROWS`` rows are cut into blocks and each pair of
blocks is a task row group of its own, so nothing is capped.

Equal vectors with one label form a class that goes through the tables once;
the members' links are counted by arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from serpframe.llm.tables import components, written
from serpframe.llm.textblocks import mix

CELL_ROWS = 1000
PROBES = 12


@lru_cache
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (-1, 1):
            for b in (-1, 1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def _near_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) % 2)
    err = x[odd] - r[odd]
    worst = np.abs(err).argmax(1)
    r[odd, worst] += np.where(err[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row."""
    a, b = _near_d8(x), _near_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache
def _frame(dim: int, table: int) -> np.ndarray:
    """8 random directions, orthonormal where the dimension allows, scaled to norm sqrt(dim / 8) on average."""
    g = np.random.default_rng((dim, table)).normal(size=(dim, max(8, 1)))
    if dim >= 8:
        g = np.linalg.qr(g)[0]
    else:
        g /= np.sqrt(dim)
    return g


def cells(unit: np.ndarray, table: int, scale: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's home cell, and of the cells it probes (0 where none), most likely first."""
    dim = unit.shape[1]
    x = unit @ _frame(dim, table) * (scale * np.sqrt(dim) / 8)
    p = decode(x)
    salt = mix(np.array([dim * 1000 + table], np.uint64))[0]

    def code(points: np.ndarray) -> np.ndarray:
        key = np.full(len(points), salt)
        twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
        for k in range(8):
            key = mix(key ^ twice[:, k])
        return key.view(np.int64)

    border = (1 - (x - p) @ _roots().T) / np.sqrt(2)  # distance to the border with each neighbour
    near = np.argsort(border, axis=1)[:, :PROBES]
    probes = np.zeros((len(x), PROBES), np.int64)
    for k in range(PROBES):
        pick = np.flatnonzero(border[np.arange(len(x)), near[:, k]] <= margin)
        probes[pick, k] = code(p[pick] + _roots()[near[pick, k]])
    return code(p), probes


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _spread(tables: int, scale: float, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(np.asarray(batch.column("vec").offsets))
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                part = batch.take(pa.array(at))
                unit = _unit(np.asarray(part.column("vec").flatten()).reshape(len(at), dim))
                for t in range(tables):
                    home, probes = cells(unit, t, scale, margin)
                    who, k = np.nonzero(probes)
                    row = pa.array(np.concatenate([np.arange(len(at)), who]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t, np.int32)), part.column("label").take(row),
                         pa.array(np.concatenate([home, probes[who, k]])),
                         pa.array(np.arange(len(row)) < len(at)), part.column("rep").take(row)],
                        names=["t", "label", "cell", "home", "rep"])
    return run


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within each group (rows of a group adjoin) that are to be compared."""
    size = np.bincount(group)[group] if len(group) else group
    at = np.arange(len(group))
    for d in range(1, int(size.max(initial=1))):
        a = at[:-d][group[:-d] == group[d:]]
        a = a[(side[a] | side[a + d]) > 0]
        if len(a):
            yield a, a + d


def _compare(cosine: float, tables: int, scale: float, margin: float):
    """Links of each task group: counts and a star of what is connected."""

    def links(t: pa.Table) -> pa.RecordBatch:
        rep = t.column("rep").to_numpy()
        n = t.column("n").to_numpy()
        home = t.column("home").to_numpy(zero_copy_only=False)
        table, cell = t.column("t").to_numpy(), t.column("cell").to_numpy()
        i, j, lab = (t.column(c).to_numpy() for c in ("i", "j", "label"))
        part = t.column("part").to_numpy()
        vec = t.column("vec").combine_chunks()
        flat = np.asarray(vec.flatten())
        off = np.asarray(vec.offsets) - np.asarray(vec.offsets)[0]
        change = np.zeros(len(rep), bool)
        for c in (table, lab, cell, i, j):
            change[1:] |= c[1:] != c[:-1]
        group = np.cumsum(change)
        dims = np.diff(off)
        count = np.zeros(len(rep), np.int64)
        low = np.arange(len(rep))
        px, py = [], []
        units: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            units[int(dim)] = (rows, _unit(np.stack([flat[off[r]:off[r + 1]] for r in rows])))
        where = np.zeros(len(rep), np.int64)
        for rows, _ in units.values():
            where[rows] = np.arange(len(rows))
        for a, b in _pairs(group, home.astype(np.int8)):
            a, b = a[ok := (dims[a] == dims[b]) & (rep[a] != rep[b])], b[ok]
            ok = (i[a] == j[a]) | (part[a] != part[b])  # two blocks: across only
            a, b = a[ok], b[ok]
            for dim in np.unique(dims[a]):
                mine = dims[a] == dim
                unit = units[int(dim)][1]
                cos = np.einsum("ij,ij->i", unit[where[a[mine]]], unit[where[b[mine]]])
                hit = np.flatnonzero(mine)[cos >= cosine]
                px.append(a[hit])
                py.append(b[hit])
        x = np.concatenate(px) if px else np.zeros(0, np.int64)
        y = np.concatenate(py) if py else np.zeros(0, np.int64)
        if len(x):
            keep = _first_meeting(x, y, dims, units, where, table, cell, tables, scale, margin)
            np.add.at(count, x[keep], n[y[keep]])
            np.add.at(count, y[keep], n[x[keep]])
            while True:
                before = low.copy()
                m = np.minimum(low[x], low[y])
                np.minimum.at(low, x, m)
                np.minimum.at(low, y, m)
                low = low[low]
                if (low == before).all():
                    break
        touched = np.unique(np.concatenate([x, y]))
        return pa.RecordBatch.from_arrays([pa.array(rep[touched]), pa.array(count[touched]), pa.array(rep[low[touched]])],
                                          names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["t", "label", "cell", "i", "j"]
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows of the last group wait for the next batch
            last = np.ones(batch.num_rows, bool)
            for k in keys:
                c = batch.column(k).to_numpy(zero_copy_only=False)
                last &= c == c[-1]
            cut = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
                yield links(pa.Table.from_batches(held))
                held = []
            if cut:
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _first_meeting(x, y, dims, units, where, table, cell, tables, scale, margin) -> np.ndarray:
    """Which pairs meet here for the first time, over tables and then cells."""
    keep = np.zeros(len(x), bool)
    for dim, (_, unit) in units.items():
        mine = np.flatnonzero(dims[x] == dim)
        used, code = np.unique(np.concatenate([where[x[mine]], where[y[mine]]]), return_inverse=True)
        cx, cy = code[:len(mine)], code[len(mine):]
        found = np.zeros(len(mine), bool)
        for t in range(tables):
            home, probes = cells(unit[used], t, scale, margin)
            for s in range(0, len(mine), 100_000):
                e = slice(s, s + 100_000)
                a, b = cx[e], cy[e]
                same = home[a] == home[b]
                at_b = (probes[a] == home[b][:, None]).any(1)  # in the home cell of b
                at_a = (probes[b] == home[a][:, None]).any(1)
                here = np.where(same, home[a], np.where(at_a & at_b, np.minimum(home[a], home[b]),
                                                        np.where(at_b, home[b], home[a])))
                meets = same | at_a | at_b
                now = meets & ~found[e] & (table[x[mine[e]]] == t) & (cell[x[mine[e]]] == here)
                keep[mine[e]] |= now
                found[e] |= meets
    return keep


def near_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = 8, scale: float = 5.0,
                 margin: float = 0.25) -> DataFrame:
    """One row per vec_id: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are
    equal and their cosine is at least ``cosine``. Null, empty and zero
    vectors, and vectors with null or non-finite components, link with
    nothing. Rows that repeat a vec_id count once; if their vectors or labels
    differ, one of them counts (smallest label, then vector hash). Rows with
    null vec_id come back each with no links, null component_id and kept true.
    Vectors of any length are compared whole; a cosine of just ``cosine`` links.
    Other columns are ignored; an empty table gives no rows.
    """
    given = vectors.schema["embedding"].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    vec = F.col("embedding").cast("array<float>" if single else "array<double>")  # doubles stay doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          vec.alias("vec"))
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) \
        & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) \
        & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound and vec_id is not null").select(
        "vec_id", "label", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    member = written(good.groupBy("vec_id").agg(F.min(F.struct("label", "h1", "h2")).alias("key"))
                     .select("vec_id", "key.*"), "vectors")
    classes = member.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes, "vector-classes")
    reps = good.join(classes, ["label", "h1", "h2"]).where("vec_id = rep") \
        .dropDuplicates(["label", "h1", "h2"]).select("label", "rep", "n", "vec")

    reps = written(reps, "vector-reps")
    # vectors go only where a cell is the home of one and is met by another
    spread = written(reps.mapInArrow(_spread(tables, scale, margin),
                                     "t int, label long, cell long, home boolean, rep long"), "cells")
    met = spread.groupBy("t", "label", "cell").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")) \
        .where("rows > 1 and homes > 0") \
        .select("t", "label", "cell", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("blocks"))
    spread = spread.join(written(met, "met-cells"), ["t", "label", "cell"]) \
        .join(reps.select("rep", "n", "vec"), "rep") \
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = spread.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")) \
        .select("t", "label", "cell", "i", "j", "part", "home", "rep", "n", "vec")
    keys = ["t", "label", "cell", "i", "j"]
    found = written(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _compare(cosine, tables, scale, margin), "rep long, links long, root long"), "vector-links")

    named = member.join(classes, ["label", "h1", "h2"])
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(
        named.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    per_class = found.groupBy("rep").agg(F.sum("links").alias("links"))
    links = named.join(per_class, "rep", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    ids = rows.where("vec_id is not null").select("vec_id").distinct()
    out = ids.join(links, "vec_id", "left").join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component", "vec_id").alias("component_id"))
    none = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                               F.col("vec_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
