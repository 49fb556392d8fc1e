"""Quality by a factorisation machine (operator 13).

A text is a sparse vector: its lower-cased words hashed into ``WORD_BUCKETS``
(logarithms of the counts, of length 1), and for each structure statistic (how
the text is made up of letters, symbols, lines, repeated words) and for its
declared length the bucket that it falls in. The model is

    z = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with vectors of ``RANK`` numbers. The pairs cost linear time by
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2.
Weights and vectors are fitted together in numpy by AdaGrad on the logistic
loss, and a calibration on rows that the fit never sees gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import map_batches

WORD_BUCKETS = 1 << 14
RANK = 8
BINS = 16
STATS = ("bytes", "words", "lines", "declared length", "letters", "upper case", "digits", "ASCII symbols", "commas and stops",
         "most frequent symbol", "word length", "words with symbols", "words all upper case", "words like the one before",
         "distinct words", "words with a capital", "words to a line", "stops to a word")


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _classes() -> np.ndarray:
    """Kinds of bytes, a row each: letters (and all bytes beyond ASCII), upper case, digits, symbols, commas and stops."""
    b = np.arange(256)
    upper, digit = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    letter = upper | ((b >= 97) & (b <= 122)) | (b >= 128)
    plain = np.isin(b, list(b",.;:'\"-"))
    symbol = (b > 32) & (b < 127) & ~letter & ~digit
    return np.stack([letter, upper, digit, symbol & ~plain, symbol & plain])


_KINDS = _classes()


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _stats(w: tb.Words, raw: np.ndarray, hashes: np.ndarray, declared: np.ndarray) -> np.ndarray:
    """The structure statistics of each row."""
    n = w.hi - w.lo
    size = np.diff(w.bounds).astype(float)
    ink = np.maximum(_per_row(~tb.SPACE[raw], w.bounds), 1)
    letters, upper, digits, symbols, plain = (_per_row(k[raw], w.bounds) for k in _KINDS)
    row_of = np.repeat(np.arange(n), np.diff(w.bounds))
    odd = np.flatnonzero(_KINDS[3][raw])
    most = np.zeros(n)
    if len(odd):
        kind, many = np.unique(row_of[odd] * 256 + raw[odd], return_counts=True)
        np.maximum.at(most, kind >> 8, many)
    words, of = np.maximum(w.count, 1), w.row
    inside = lambda flags: _per_row(flags, np.append(w.start, len(raw)))[:len(w.start)]  # noqa: E731  of each word, its gap too
    has_symbol, ups, lets = inside(_KINDS[3][raw]) > 0, inside(_KINDS[1][raw]), inside(_KINDS[0][raw])
    share = lambda flags: np.bincount(of, flags, n) / words
    same = np.zeros(len(of), bool)
    same[1:] = (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1])
    distinct = np.bincount(np.unique(np.stack([of.astype(np.uint64), hashes]), axis=1)[0].astype(int), minlength=n) if len(of) \
        else np.zeros(n)
    lines = _per_row(raw == 10, w.bounds) + 1
    stops = _per_row(np.isin(raw, list(b".!?")), w.bounds)
    return np.stack([np.log1p(size), np.log1p(w.count), np.log(1 + lines), declared, letters / ink, upper / ink, digits / ink,
                     symbols / ink, plain / ink, most / ink, np.bincount(of, w.end - w.start, n) / words, share(has_symbol),
                     share((ups == lets) & (lets > 1)), share(same), distinct / words, share(ups > 0),
                     np.log1p(w.count / lines), stops / words], 1)


def features(col: pa.Array, declared: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, word buckets, row of each, how often, statistics) of each chunk.

    ``declared``: the length that the row says it has; null or negative counts as a kind of its own.
    """
    length = declared.fill_null(-1).to_numpy(zero_copy_only=False).astype(float)
    length = np.where(length < 0, -1.0, np.log1p(np.maximum(length, 0)))
    data, off = tb.string_buffers(col)
    for w in tb.chunks(col, lower=True):
        raw = data[off[w.lo]:off[w.hi]]
        h = w.hashes()
        key, count = np.unique(w.row.astype(np.int64) * WORD_BUCKETS + (h >> np.uint64(50)).astype(np.int64), return_counts=True)
        yield w.lo, w.hi - w.lo, (key % WORD_BUCKETS).astype(np.int32), (key // WORD_BUCKETS).astype(np.int32), \
            count.astype(np.int32), _stats(w, raw, h, length[w.lo:w.hi])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, n, ids, rows, count, stats in features(b.column("text"), b.column("n_chars")):
            per = np.bincount(rows, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(lo, n), b.column("quality").slice(lo, n), tb.lists(ids, per), tb.lists(count, per),
                 tb.lists(stats.ravel(), np.full(n, len(STATS)))], names=["doc_id", "quality", "ids", "counts", "stats"])


@dataclass
class Model:
    edges: np.ndarray  # of the bins of each statistic
    bias: float
    weight: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def inputs(self, ids: np.ndarray, rows: np.ndarray, count: np.ndarray, stats: np.ndarray):
        """Feature, row and value of every non-zero of rows that have these words and statistics."""
        n = len(stats)
        value = np.log1p(count)
        value = value / np.sqrt(np.bincount(rows, value * value, n) + 1e-12)[rows]
        bins = np.stack([np.searchsorted(self.edges[k], stats[:, k], side="right") for k in range(len(STATS))], 1)
        spots = WORD_BUCKETS + np.arange(len(STATS)) * BINS + bins
        return np.concatenate([ids, spots.ravel()]), np.concatenate([rows, np.repeat(np.arange(n), len(STATS))]), \
            np.concatenate([value, np.full(n * len(STATS), len(STATS) ** -0.5)])

    def raw(self, feature: np.ndarray, row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weight[feature] * value, n)
        for f in range(self.factors.shape[1]):
            part = self.factors[feature, f] * value
            z += 0.5 * (np.bincount(row, part, n) ** 2 - np.bincount(row, part * part, n))
        return z

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


Row = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # quality, word buckets, counts, statistics


def _packed(rows: list[Row]):
    per = [len(r[1]) for r in rows]
    return np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), per), np.concatenate([r[2] for r in rows]), \
        np.stack([r[3] for r in rows])


def fit(rows: list[Row], shares: tuple[float, float], steps: int = 1500, batch: int = 64, rate: float = 0.1,
        decay: float = 2e-4) -> Model:
    """Fit on rows in a fixed order, in ``steps`` batches or 12 to 100 passes; every fifth row calibrates only.

    ``shares``: of labels 0 and 1 among all labelled rows; the sample may hold
    another mix and is weighed back to them.
    """
    width = WORD_BUCKETS + len(STATS) * BINS
    rng = np.random.default_rng(13)
    prior = (shares[1] + 1e-3) / (sum(shares) + 2e-3)
    model = Model(np.zeros((len(STATS), BINS - 1)), float(np.log(prior / (1 - prior))), np.zeros(width),
                  rng.normal(0, 0.05, (width, RANK)))
    y = np.array([r[0] for r in rows], float)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of the label there is
        model.factors[:] = 0
        return model
    stats = np.stack([r[3] for r in rows])
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    there = np.array([(y == c).mean() for c in (0, 1)])
    weigh = (np.array(shares) / sum(shares) / there)[y.astype(int)]
    cal = np.arange(len(rows)) % 5 == 4
    pick_from = np.flatnonzero(~cal)
    sq_w, sq_v, sq_b = np.full(width, 1e-8), np.full((width, RANK), 1e-8), 1e-8
    ready = [model.inputs(r[1], np.zeros(len(r[1]), int), r[2], r[3][None]) for r in rows]
    for _ in range(int(np.clip(steps * batch / len(pick_from), 12, 100))):
        order = rng.permutation(pick_from)
        for a in range(0, len(order), batch):
            pick = order[a:a + batch]
            feature = np.concatenate([ready[i][0] for i in pick])
            value = np.concatenate([ready[i][2] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(ready[i][0]) for i in pick])
            v = model.factors[feature]
            part = v * value[:, None]
            total = np.stack([np.bincount(row, part[:, f], len(pick)) for f in range(RANK)], 1)
            z = model.bias + np.bincount(row, model.weight[feature] * value, len(pick)) \
                + 0.5 * ((total ** 2).sum(1) - np.bincount(row, (part ** 2).sum(1), len(pick)))
            slope = weigh[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            used, at = np.unique(feature, return_inverse=True)
            g_w = np.bincount(at, slope[row] * value) + decay * model.weight[used]
            pull = (slope[row] * value)[:, None] * (total[row] - part)
            g_v = np.stack([np.bincount(at, pull[:, f]) for f in range(RANK)], 1) + decay * model.factors[used]
            sq_w[used] += g_w ** 2
            sq_v[used] += g_v ** 2
            sq_b += slope.sum() ** 2
            model.weight[used] -= rate * g_w / np.sqrt(sq_w[used])
            model.factors[used] -= rate * g_v / np.sqrt(sq_v[used])
            model.bias -= rate * slope.sum() / sq_b ** 0.5
    _calibrate(model, [r for r, c in zip(rows, cal) if c], y[cal], weigh[cal])
    return model


def _calibrate(model: Model, rows: list[Row], y: np.ndarray, weigh: np.ndarray) -> None:
    """Logistic curve from the model's output to the label, by Newton steps held near the uncalibrated one."""
    if len(set(y.tolist())) < 2:
        return
    ids, row, count, stats = _packed(rows)
    z = model.raw(*model.inputs(ids, row, count, stats), len(rows))
    x = np.stack([z, np.ones(len(z))], 1)
    at, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (weigh * (p - y)) + 0.1 * (at - start)
        curve = x.T @ (x * (weigh * p * (1 - p) + 1e-9)[:, None]) + 0.1 * np.eye(2)
        move = np.linalg.solve(curve, grad)
        at = at - move * min(1.0, 1.0 / (np.abs(move).max() + 1e-12))
    model.slope, model.shift = float(max(at[0], 0.05)), float(at[1])


def _inputs(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", length.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 3000) -> Model:
    """Fit on about ``per_label`` rows of each label, drawn by a hash of doc_id, that are not held out.

    Twice ``per_label`` rows of a label at most. Only word buckets, counts and
    statistics reach the driver. A document with several labels takes the
    larger; labels other than 0 and 1 and rows without text are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    many = dict(known.groupBy("quality").count().collect())
    spot = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 40))
    within = lambda c: spot < int(min(1.0, per_label / max(1, many.get(c, 0))) * (1 << 40))
    one = lambda c: known.where((F.col("quality") == c) & within(c)).orderBy(spot, "doc_id").limit(2 * per_label)
    # a few thousand ids
    sample = _inputs(docs).where("text is not null").join(F.broadcast(one(0).unionByName(one(1))), "doc_id")
    got = map_batches(sample.select("doc_id", "quality", "text", "n_chars"), _feature_rows,
                      "doc_id long, quality int, ids array<int>, counts array<int>, stats array<double>").toArrow()
    flat = lambda c: [np.asarray(x.values) for chunk in got.column(c).chunks for x in chunk]
    rows = list(zip(got.column("quality").to_pylist(), flat("ids"), flat("counts"), flat("stats")))
    keys = got.column("doc_id").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (keys[i] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, len(rows[i][1])))
    return fit([rows[i] for i in order], (many.get(0, 0), many.get(1, 0)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row, over whole texts.

    Null and empty texts have no words and the statistics of an empty text. A
    null n_chars, or no such column, counts as a length of its own kind.
    Repeated rows give equal rows; other columns are ignored; an empty table
    gives no rows; without labels every score is the share of label 1, 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for lo, n, ids, rows, count, stats in features(b.column(1), b.column(2)):
                s = m.score(m.raw(*m.inputs(ids, rows, count, stats), n))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return map_batches(_inputs(docs), run, "doc_id long, score double, predicted int")
