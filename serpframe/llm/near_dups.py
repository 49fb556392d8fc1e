"""MinHash near-duplicates with sequential Bayesian verification (operator 9).

1. One pass over the texts gives each document its distinct word shingles (as
   64-bit hashes), a 128-bit hash of the set, and banded MinHash keys.
2. Documents with equal sets form a class; the smallest doc_id stands for it.
3. Classes that share a band key are candidates. Each bucket links its
   members to its smallest id only, and the connected groups of those links
   hold every candidate pair, so no pairs are listed.
4. Within a group the signatures are compared in batches of ``BATCH`` hashes:
   a pair goes when the posterior probability that its similarity reaches the
   threshold falls below ``miss``; a survivor is decided on the full sets. A
   pair whose ends are already connected needs no test.
5. A group beyond ``BLOCK_ROWS`` documents or ``BLOCK_SHINGLES`` shingles is
   compared with its smallest member first. Only the documents that do not
   link to it meet the whole group again, in blocks, each block pair a task
   of its own. Links between blocks are joined by connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import components, map_batches, written

BATCH = 16
BLOCK_ROWS = 256
BLOCK_SHINGLES = 200_000
VERIFY_HASHES = 128
MISS = 1e-6


def shingle_sets(col: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, distinct shingle hashes, how many of each row) of each chunk."""
    for w in tb.chunks(col, lower=True):
        h = w.hashes()
        g, ok = w.ngrams(h, words)
        row = w.row[:len(g)][ok]
        g = g[ok]
        few = np.flatnonzero((w.count > 0) & (w.count < words))
        if len(few):
            g = np.concatenate([g, tb.range_hash(h, w.first[few], w.first[few + 1])])
            row = np.concatenate([row, few])
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
        yield w.hi - w.lo, g, np.bincount(row, minlength=w.hi - w.lo)


_rng = np.random.default_rng(5)
_MUL = _rng.integers(1, 1 << 62, 512, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 62, 512, dtype=np.int64).astype(np.uint64)


def signatures(g: np.ndarray, counts: np.ndarray, hashes: range) -> np.ndarray:
    """MinHash values, one row per document, of documents that have shingles."""
    at = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=at[1:])
    out = np.empty((len(counts), len(hashes)), np.uint32)
    for k, i in enumerate(hashes):
        v = ((g * _MUL[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(v, at)
    return out


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, keys (one band key per band; null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = tb.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            at = 0
            for n, g, counts in shingle_sets(batch.column(1), words):
                ids = batch.column(0).slice(at, n)
                at += n
                has = counts > 0
                a = np.zeros(n, np.uint64)
                b = np.zeros(n, np.uint64)
                keys = np.zeros((n, bands), np.uint64)
                if has.any():
                    start = np.zeros(int(has.sum()), np.int64)
                    np.cumsum(counts[has][:-1], out=start[1:])
                    a[has] = np.add.reduceat(tb.mix(g), start)
                    b[has] = np.bitwise_xor.reduceat(tb.mix(g ^ np.uint64(0x5851F42D4C957F2D)), start)
                    sig = signatures(g, counts[has], range(bands * rows)).astype(np.uint64)
                    for k in range(bands):
                        key = np.full(len(sig), salt[k])
                        for r in range(rows):
                            key = tb.mix(key ^ sig[:, k * rows + r])
                        keys[has, k] = key
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts.astype(np.int64)), pa.array(tb.signed(a)), pa.array(tb.signed(b)),
                     tb.lists(tb.signed(keys[has].ravel()), np.where(has, bands, 0))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "keys"])

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def least_matches(threshold: float, miss: float, hashes: int) -> list[int]:
    """Fewest equal hashes after each batch that keep a pair.

    With a uniform prior and m of n hashes equal, the posterior probability of
    similarity >= t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        p, m = 0.0, -1
        while p < miss and m <= n:
            m += 1
            p += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def link_group(col: pa.Array, ids: np.ndarray, asks: np.ndarray, words: int, percent: int, miss: float,
               label: np.ndarray | None = None) -> np.ndarray:
    """Smallest connected id of each document, by links between ``asks`` rows and all rows.

    ``label``: rows with equal labels count as connected beforehand.
    """
    sets: list[np.ndarray] = []
    for _, g, counts in shingle_sets(col, words):
        sets += np.split(g, np.cumsum(counts)[:-1])
    order = np.argsort(ids, kind="stable")
    ids, asks = ids[order], asks[order]
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    n = len(ids)
    union = _Union(n)
    same: dict[int, int] = {}
    for i, x in enumerate(ids):  # a document can come in both roles
        union.join(i, same.setdefault(int(x), i))
    if label is not None:
        seen: dict[int, int] = {}
        for i, x in enumerate(label[order]):
            if x >= 0:
                union.join(i, seen.setdefault(int(x), i))
    sig = signatures(np.concatenate(sets), size, range(VERIFY_HASHES))
    least = least_matches(percent / 100, miss, VERIFY_HASHES)
    root = np.array([union.find(i) for i in range(n)])
    for i in np.flatnonzero(asks):
        other = ~asks
        other[i + 1:] = True
        other &= root != root[i]
        other &= (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        rest = np.flatnonzero(other)
        match = np.zeros(len(rest), np.int32)
        for k, need in enumerate(least):
            if not len(rest):
                break
            part = slice(k * BATCH, (k + 1) * BATCH)
            match = match + (sig[rest, part] == sig[i, part]).sum(1, dtype=np.int32)
            keep = match >= need
            rest, match = rest[keep], match[keep]
        for j in rest[np.argsort(-match, kind="stable")]:
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (size[i] + size[j] - both):
                union.join(i, int(j))
                low, high = min(root[i], root[j]), max(root[i], root[j])
                root[root == high] = low
    out = np.empty(n, np.int64)
    out[order] = ids[root]
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
                    miss: float = MISS) -> DataFrame:
    """One row per doc_id: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A and B| >= percent * |A or B| on their shingle
    sets (A-Z lower-cased; a text with fewer words is one shingle). Null and
    empty texts have no shingles and link with nothing. Rows that repeat a
    doc_id are one document: it has the links of all its rows and the largest
    n_shingles. Rows with null doc_id come back each with null component_id
    and kept true. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = written(sketch(docs, words, bands, rows), "sketch")
    full = seen.where("n_shingles > 0 and doc_id is not null")
    # tables of one row per key are written before they are joined back, so that hot keys can be split there
    classes = written(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "reps")
    member = full.select("doc_id", "n_shingles", "set_a", "set_b", "keys").join(classes, ["set_a", "set_b"])
    member = written(member.select("doc_id", "n_shingles", "rep", "set_a",
                                   F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")), "classes")
    reps = member.where("doc_id = rep").dropDuplicates(["rep", "set_a"])

    keyed = reps.select("rep", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top")
    links = keyed.join(written(buckets.select("key", "hub"), "buckets"), "key").where("rep <> hub")
    groups = components(links.select(F.col("rep").alias("a"), F.col("hub").alias("b")))

    sized = groups.join(reps.groupBy(F.col("rep").alias("id")).agg(F.max("n_shingles").alias("n")), "id")
    plan = sized.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    plan = plan.select("component", F.greatest(F.ceil(F.col("docs") / BLOCK_ROWS),
                                               F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    found = written(groups.join(plan, "component"), "groups")
    cand = docs.join(found.withColumnRenamed("id", "doc_id"), "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    cand = written(cand.select("doc_id", "component", "blocks", part.alias("part"), "text"), "candidates")

    small = cand.where("blocks = 1").select("component", "doc_id", "text")
    linked = small.groupBy("component").applyInArrow(_whole_group(words, percent, miss), "a long, b long")
    large = cand.where("blocks > 1")
    far = _large_groups(large, words, percent, miss)
    # texts that share a doc_id, and blocks, may each add links
    joined = components(linked.unionByName(far).unionByName(
        member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))

    rows_ = seen.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    out = rows_.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left") \
        .withColumn("component_id", F.coalesce("component", "doc_id"))
    none = seen.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(none) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _whole_group(words: int, percent: int, miss: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        low = link_group(table.column("text"), ids, np.ones(len(ids), bool), words, percent, miss)
        return pa.table({"a": ids, "b": low}).filter(pa.array(ids != low))
    return run


def _large_groups(large: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """Links of groups of several blocks: to the smallest member first, then block by block."""
    each_part = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")
    hub = large.where("doc_id = component").groupBy("component", "blocks").agg(F.min("text").alias("hub_text")) \
        .select("component", each_part, "hub_text")

    def to_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            mine, theirs = [], []
            for _, g, c in shingle_sets(batch.column("text"), words):
                mine += np.split(g, np.cumsum(c)[:-1])
            for _, g, c in shingle_sets(batch.column("hub_text"), words):
                theirs += np.split(g, np.cumsum(c)[:-1])
            for x, y in zip(mine, theirs):
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "component", "blocks", "part")], pa.array(links, pa.bool_()),
                 batch.column("text")], names=["doc_id", "component", "blocks", "part", "linked", "text"])

    pairs = large.join(hub, ["component", "part"]).select("doc_id", "component", "blocks", "part", "text", "hub_text")
    tested = written(map_batches(
        pairs, to_hub, "doc_id long, component long, blocks int, part int, linked boolean, text string"), "to-hub")
    rest = tested.where("not linked").groupBy("component", "blocks") \
        .agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("ask_blocks")) \
        .select("component", each_part, "ask_blocks")
    open_ = tested.join(rest, ["component", "part"])
    asks = open_.where("not linked").select(
        "component", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("ask_blocks")).cast("int").alias("ask"), each_part,
        F.lit(True).alias("asks"), "doc_id", "linked", "text")
    parts = open_.select(
        "component", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("ask"), "part",
        F.lit(False).alias("asks"), "doc_id", "linked", "text")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        asks_ = table.column("asks").to_numpy(zero_copy_only=False)
        settled = np.where(table.column("linked").to_numpy(zero_copy_only=False), 0, -1)
        low = link_group(table.column("text"), ids, asks_, words, percent, miss, settled)
        return pa.table({"a": ids, "b": low}).filter(pa.array(ids != low))

    met = asks.unionByName(parts).groupBy("component", "ask", "part").applyInArrow(run, "a long, b long")
    direct = tested.where("linked").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    return met.unionByName(direct)
