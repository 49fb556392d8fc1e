"""Benchmark decontamination by pigeonhole edit matching (operator 10).

An item of m words (letters and digits, lower-cased) matches a document when
some stretch of the document is within ``int(rate * m)`` word edits of it. The
item is split into one piece more than that budget, so at least one piece of
any match is intact. Pieces are found by their word-n-gram hashes; around each
hit Myers' bit-parallel algorithm gives the edit distance.

The items are the stated query set: they are read in blocks of at most
``block_bytes`` of text, each block is broadcast and met with all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import appended, free_name, map_batches, written

FILTER_BITS = 20


def word_hashes(col: pa.Array) -> Iterator[tuple[tb.Words, np.ndarray]]:
    for w in tb.chunks(pc.utf8_lower(col), space=tb.PUNCT):
        yield w, w.hashes()


class Index:
    """Pieces of a block of items, by their length in words."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.words: list[np.ndarray] = []
        self.ids = [i for i, _ in items]
        self.budget: list[int] = []
        self.masks: list[dict[int, int]] = []
        for w, h in word_hashes(pa.array([t for _, t in items], pa.string())):
            self.words += np.split(h, w.first[1:-1])
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, h in enumerate(self.words):
            m = len(h)
            k = int(rate * m)
            self.budget.append(k)
            mask: dict[int, int] = {}
            for at, x in enumerate(h.tolist()):
                mask[x] = mask.get(x, 0) | 1 << at
            self.masks.append(mask)
            cut = [m * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cut, cut[1:]):
                if a < b:
                    key = int(tb.range_hash(h, np.array([a]), np.array([b]))[0])
                    pieces[b - a][key].append((i, a))
        self.pieces = {n: dict(p) for n, p in pieces.items()}
        self.filters = {}
        for n, p in self.pieces.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[np.fromiter(p, np.uint64, len(p)) >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[n] = bits


def best_end(mask: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a stretch of ``text``, and where the first such stretch ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, x in enumerate(text, 1):
        eq = mask.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best, end = score, at
    return best, end


def _matches(index: Index, w: tb.Words, h: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, distance, end word) of a chunk, the best of each row and item."""
    spots: dict[tuple[int, int], set[int]] = defaultdict(set)
    pre_n = len(h)
    for n, table in index.pieces.items():
        if pre_n < n:
            continue
        g, ok = w.ngrams(h, n)
        for at in np.flatnonzero(index.filters[n][g >> np.uint64(64 - FILTER_BITS)] & ok).tolist():
            for item, offset in table.get(int(g[at]), ()):
                spots[int(w.row[at]), item].add(at - offset)
    out = []
    for (row, item), starts in spots.items():
        m, k = len(index.words[item]), index.budget[item]
        lo, hi = int(w.first[row]), int(w.first[row + 1])
        found = None
        spans: list[list[int]] = []
        for s in sorted(starts):  # overlapping neighbourhoods are searched once
            a, b = max(lo, s - k), min(hi, s + m + k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        for a, b in spans:
            d, end = best_end(index.masks[item], m, h[a:b].tolist())
            if d <= k and (found is None or d < found[0]):
                found = (d, a + end - lo)
        if found:
            out.append((row, item, *found))
    return out


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.1, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document and item found: doc_id, item_id, distance, item_words, end_word.

    ``distance`` counts word edits; ``end_word`` is the document's word after
    the first stretch at that distance. Null and empty texts, and items
    without words, match nothing; texts are read whole. Rows that repeat a doc_id or an item_id are
    joined: the smallest distance counts, then the fewest words, then the first end. Other columns are ignored; an empty
    table on either side gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")

    def found(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch in batches:
                for w, h in word_hashes(batch.column(1)):
                    rows = _matches(ix, w, h)
                    if rows:
                        row, item, dist, end = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(np.array(row) + w.lo)),
                             pa.array([ix.ids[i] for i in item], pa.int64()), pa.array(dist, pa.int64()),
                             pa.array([len(ix.words[i]) for i in item], pa.int64()), pa.array(end, pa.int64())],
                            names=["doc_id", "item_id", "distance", "item_words", "end_word"])

        return map_batches(docs, run, "doc_id long, item_id long, distance long, item_words long, end_word long")

    best = F.min(F.struct("distance", "item_words", "end_word")).alias("best")
    return _by_block(items, rate, block_bytes, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _by_block(items: DataFrame, rate: float, block_bytes: int, found) -> DataFrame:
    """``found`` of the broadcast index of each block of about ``block_bytes`` of items, one block after the other.

    The driver and the tasks hold one block at a time: what a block finds is
    written before the next one is read, unless there is only one.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        sent = items.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part], rate))
        got = found(sent)
        if blocks > 1:
            got = written(got, "block-matches")
            sent.destroy()
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.1, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that no item matches, with all their columns, whatever their names.

    Rows with null or empty text stay; texts are read whole; repeated rows
    fare alike, ties are no matter; an empty table gives no rows, an empty
    table of items keeps all.
    """
    flag, row = free_name("is_contaminated", docs.columns), free_name("row", docs.columns)

    def flagged(rows: DataFrame, index) -> DataFrame:
        def flags(col: pa.Array) -> list[pa.Array]:
            hit = np.zeros(len(col), bool)
            for w, h in word_hashes(col):
                for at, *_ in _matches(index.value, w, h):
                    hit[w.lo + at] = True
            return [pa.array(hit)]

        return appended(rows, "text", f"{flag} boolean", flags)

    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:  # one pass, no row numbers
        return _by_block(items, rate, max(block_bytes, 1), lambda index: flagged(docs, index).where(f"not {flag}").drop(flag))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits = _by_block(items, rate, block_bytes, lambda index: flagged(numbered.select(row, "text"), index).where(flag).select(row))
    return numbered.join(hits.distinct(), row, "left_anti").drop(row)
