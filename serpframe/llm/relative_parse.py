"""Substring dedup by relative Lempel-Ziv parsing (operator 3).

Every document is parsed against reference blocks: the stretches of text in
which windows of ``window`` words stand for the first time, that is in the
smallest doc_id that holds them, at their first place there. A factor is a stretch of
words of a document that stands word for word in one block; only factors of
at least ``window`` words matter. Every window stands in the index once, so
from where a factor starts there is one place in the reference to follow, and
following it as far as the words agree gives the longest factor.

1. One pass gives each document's word count, the SHA-256 of its words and
   its block anchors: of the ``window - SEED + 1`` seeds (``SEED`` words) in
   each window the one with the smallest hash. Equal windows have equal
   anchors, and an anchor serves about half a window's length of windows.
2. Documents with equal words need no parse: all but the smallest doc_id are
   one factor from end to end, and that one stands for them.
3. Anchors found in two or more documents are the index of reference blocks.
   Only windows whose anchor is in it can repeat; their 128-bit hashes give
   the reference document and the place in it.
4. Each document is factored greedily: a factor starts at the first position
   whose window is in the index and runs while the following windows follow
   each other in the reference as well. At its end the windows that straddle
   the boundary are checked: one that stands elsewhere in the reference starts
   the next factor before the first one ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import map_batches, written

SEED = 16


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        a = pick(a[:-have], a[have:])
        have *= 2
    return pick(a[:len(a) - (width - have)], a[width - have:]) if have < width else a


def window_anchors(w: tb.Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of each window of a chunk, and whether the window lies in one row."""
    seed = min(SEED, window)
    g, _ = w.ngrams(hashes, seed)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return _slide(g, window - seed + 1, np.minimum), w.row[:n] == w.row[window - 1:]


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _survey(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = tb.texts(batch.column(1))
            for w in tb.chunks(batch.column(1)):
                n = w.hi - w.lo
                low, ok = window_anchors(w, w.hashes(), window)
                low, row = low[ok], w.row[:len(low)][ok]
                order = np.lexsort((low, row))
                low, row = low[order], row[order]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.lo, n), pa.array(w.count.astype(np.int64)),
                     pa.array([digest(next(whole).split()) for _ in range(n)]),
                     tb.lists(tb.signed(low[new]), np.bincount(row[new], minlength=n))],
                    names=["doc_id", "n_words", "sha", "anchors"])
    return run


def _hashed(w: tb.Words, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the first ``n`` windows of a chunk."""
    at = np.arange(n)
    return tb.range_hash(w.hashes(), at, at + window), tb.range_hash(w.hashes(1), at, at + window, 1)


def _windows(window: int):
    """(h1, h2, doc_id, nth, at): each row's distinct windows whose anchor is indexed, at their first place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indexed = batch.column("anchors")
            off = np.asarray(indexed.offsets)
            values = np.asarray(indexed.values).view(np.uint64)
            for w in tb.chunks(batch.column("text")):
                low, ok = window_anchors(w, w.hashes(), window)
                hit = np.zeros(len(low), bool)
                for r in range(w.hi - w.lo):
                    a, b = w.first[r], min(w.first[r + 1], len(low))
                    if a < b:
                        hit[a:b] = np.isin(low[a:b], values[off[w.lo + r]:off[w.lo + r + 1]])
                at = np.flatnonzero(hit & ok)
                if not len(at):
                    continue
                h1, h2 = (h[at] for h in _hashed(w, window, len(low)))
                order = np.lexsort((at, h2, h1, w.row[at]))
                at, h1, h2 = at[order], h1[order], h2[order]
                row = w.row[at]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at, h1, h2, row = at[new], h1[new], h2[new], row[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tb.signed(h1)), pa.array(tb.signed(h2)),
                     batch.column("doc_id").take(pa.array(row + w.lo)), batch.column("nth").take(pa.array(row + w.lo)),
                     pa.array((at - w.first[row]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "nth", "at"])
    return run


def factors(at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, reference doc_id, place in it) from the windows found.

    ``at``: sorted starts of the windows that stand in an earlier document;
    ``ref`` and ``ref_at``: the smallest such doc_id and the place in it.
    """
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (ref[1:] != ref[:-1]) | (ref_at[1:] != ref_at[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    return [(int(at[a]), int(at[b] - at[a]) + window, int(ref[a]), int(ref_at[a])) for a, b in zip(lo, hi)]


def _everywhere(h1: np.ndarray, h2: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of a row's windows that are found, from the first place of each, and which of them each is."""
    order = np.lexsort((h2, h1))
    new = np.ones(len(h1), bool)
    new[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
    code = np.empty(len(h1), np.int64)
    code[order] = np.cumsum(new) - 1
    which = np.full(len(h1), -1)
    which[code[at]] = np.arange(len(at))
    places = np.flatnonzero(which[code] >= 0)
    return places, which[code[places]]


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            hits, refs, spots = (batch.column(c) for c in ("at", "ref", "ref_at"))
            whole = tb.texts(batch.column("text"))
            for w in tb.chunks(batch.column("text")):
                n = max(0, len(w.start) - window + 1)
                h1, h2 = _hashed(w, window, n)
                for r in range(w.hi - w.lo):
                    words = next(whole).split()
                    own = slice(w.first[r], max(w.first[r], w.first[r + 1] - window + 1))  # its windows
                    first, ref, spot = (np.asarray(c[w.lo + r].values) for c in (hits, refs, spots))
                    at, which = _everywhere(h1[own], h2[own], first)
                    found = factors(at, ref[which], spot[which], window)
                    gone = np.zeros(len(words) + 1, np.int32)
                    for start, length, *_ in found:
                        gone[start] += 1
                        gone[start + length] -= 1
                    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                    out.append((len(words) - len(keep), digest([words[k] for k in keep]),
                                [{"start": s, "length": n, "ref": r_, "ref_start": q} for s, n, r_, q in found]))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("nth"), pa.array(cols[0], pa.int64()),
                 pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()),
                                                       ("ref", pa.int64()), ("ref_start", pa.int32())])))],
                names=["doc_id", "nth", "n_removed", "kept_sha256", "factors"])
    return run


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, factors.

    A word goes when a window of ``window`` words that covers it also stands
    in a document with a smaller doc_id; judged on the input. ``factors``
    lists (start, length, ref, ref_start) of the spans that go: the words from
    ``start`` on are those of document ``ref`` from ``ref_start`` on. Null and empty
    texts have no words. Rows with equal doc_id are not earlier than each
    other; repeated rows give equal rows. A row with null doc_id is neither
    earlier nor later than another: it keeps all words and is no reference.
    Where rows with different texts share a doc_id, ``ref_start`` is in one of them.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = written(map_batches(docs, _survey(window), "doc_id long, n_words long, sha string, anchors array<long>"),
                     "survey")
    firsts = survey.where(f"n_words >= {window} and doc_id is not null").groupBy("sha") \
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    # tables of one row per key are written before they are joined back, so that hot keys can be split there
    copies = written(firsts.where("copies > 1").select("sha", "first"), "copies")
    state = survey.join(copies, "sha", "left")
    state = state.withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("first")
    # texts that share a doc_id are told apart by their order
    nth = F.when(F.col("doc_id").isNull(), 0).otherwise(F.dense_rank().over(
        Window.partitionBy(F.coalesce("doc_id", F.xxhash64("sha"))).orderBy("sha")))
    state = written(state.withColumn("nth", nth.cast("int")), "state")

    lone = state.where("not copy and doc_id is not null").select("doc_id", "nth", "sha", F.explode("anchors").alias("anchor"))
    index = lone.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    asked = lone.join(written(index.select("anchor"), "index"), "anchor").groupBy("doc_id", "nth") \
        .agg(F.first("sha").alias("sha"), F.collect_set("anchor").alias("anchors"))
    # rows of one doc_id with different texts meet each other here and part again by sha
    pairs = docs.where("doc_id is not null").join(asked, "doc_id").select("doc_id", "nth", "sha", "anchors", "text")
    blocks = written(map_batches(pairs, _same_words, "doc_id long, nth int, anchors array<long>, text string"), "blocks")
    windows = written(map_batches(blocks, _windows(window), "h1 long, h2 long, doc_id long, nth int, at int"), "windows")
    first = windows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("ref_at")) \
        .where("ref < last").select("h1", "h2", "ref", "ref_at")
    first = written(first, "first")
    hits = windows.join(first, ["h1", "h2"]).where("ref < doc_id").groupBy("doc_id", "nth") \
        .agg(F.collect_set(F.struct("at", "ref", "ref_at")).alias("hits"))
    hits = hits.select("doc_id", "nth", *[F.col(f"hits.{c}").alias(c) for c in ("at", "ref", "ref_at")])
    parsed = map_batches(blocks.select("doc_id", "nth", "text").join(hits, ["doc_id", "nth"]), _parse(window),
                         "doc_id long, nth int, n_removed long, kept_sha256 string, "
                         "factors array<struct<start: int, length: int, ref: long, ref_start: int>>").dropDuplicates(["doc_id", "nth"])
    whole = state.where("copy").select("doc_id", "nth", "sha", "n_words").distinct() \
        .join(copies, "sha").select(
            "doc_id", "nth", F.col("n_words").alias("n_removed"), F.lit(digest([])).alias("kept_sha256"),
            F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"),
                             F.col("first").alias("ref"), F.lit(0).alias("ref_start"))).alias("factors"))
    gone = parsed.unionByName(whole)
    return state.drop("anchors", "copy").join(gone, ["doc_id", "nth"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "factors")


def _same_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the words that ``sha`` stands for."""
    for batch in batches:
        sha = batch.column("sha").to_pylist()
        same = [digest(t.split()) == s for t, s in zip(tb.texts(batch.column("text")), sha)]
        yield batch.select(["doc_id", "nth", "anchors", "text"]).filter(pa.array(same, pa.bool_()))
