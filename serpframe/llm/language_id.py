"""Language identification by averaged subword embeddings (operator 7).

Features are the byte n-grams (2 to 4 bytes of the lower-cased UTF-8 text, no
white space inside, white space as word edge) hashed into ``BUCKETS``. A
document is the mean of its n-grams' embeddings, a linear softmax on it gives
the language; both are trained by stochastic gradient descent in numpy on a
bounded sample. Scoring needs only the product of the two tables, so a text of
any length is read once. On a part of the sample that training never sees, a
temperature and the confidence below which a document is rejected are fixed.

A softmax is sure of texts in no learned language too. So each document also
has a familiarity: the mean log frequency of its n-grams in the predicted
language, less what is usual in that language, in units of the spread that
texts of its length have. The limit below which it is rejected is fixed for
each language on its own rows, counted without their fold, at a stated loss
``max_loss`` of right documents: a quantile where the rows can carry it, a
fitted tail below that, no limit under ``FEW`` rows. Rows out of any language
(each language left out in turn, texts with their letters shuffled) move the
limit further down, half way to them, where nothing lies between.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import appended, map_batches

BUCKETS = 1 << 15
#: Rows of a language below which nothing is rejected.
FEW = 8
_MULS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def subwords(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, n-gram ids, row of each) of each chunk of a string column."""
    data, off = tb.string_buffers(pc.utf8_lower(col))
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + (tb.CHUNK_BYTES >> 1), side="right")) - 1))
        raw = data[off[lo]:off[hi]]
        gap = tb.SPACE[raw]
        byte = np.where(gap, np.uint8(32), raw).astype(np.uint32)
        row = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(off[lo:hi + 1]))
        ids, rows = [], []
        for size in (2, 3, 4):
            m = len(raw) - size + 1
            if m <= 0:
                continue
            ok = row[:m] == row[size - 1:]
            acc = np.full(m, size, np.uint32)
            for k in range(size):
                acc = (acc ^ byte[k:k + m]) * _MULS[k]
                if 0 < k < size - 1:
                    ok &= ~gap[k:k + m]
            if size == 2:
                ok &= ~(gap[:m] & gap[1:])
            acc ^= acc >> np.uint32(15)
            ids.append(((acc * np.uint32(0x2C1B3C6D)) >> np.uint32(17))[ok].astype(np.int32))
            rows.append(row[:m][ok])
        yield lo, hi - lo, np.concatenate(ids) if ids else np.zeros(0, np.int32), \
            np.concatenate(rows) if rows else np.zeros(0, np.int32)
        lo = hi


def _shuffled(text: str) -> str:
    """The text with its letters in another order, always the same; other characters stay."""
    chars = np.array(list(text) or [""], object)
    letters = np.flatnonzero([c.isalpha() for c in chars])
    chars[letters] = chars[np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace"))).permutation(letters)]
    return "".join(chars)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts by row, and without a language those of every fifth text with shuffled letters."""
    for real in batches:
        noise = [_shuffled(t.as_py()) for t in real.column("text") if zlib.crc32((t.as_py() or "").encode("utf-8", "replace")) % 5 == 0]
        text = pa.concat_arrays([real.column("text"), pa.array(noise, real.column("text").type)])
        lang = pa.concat_arrays([real.column("lang"), pa.nulls(len(noise), real.column("lang").type)])
        for lo, n, ids, rows in subwords(text):
            key, count = np.unique(rows.astype(np.int64) * BUCKETS + ids, return_counts=True)
            per = np.bincount(key // BUCKETS, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [lang.slice(lo, n), tb.lists((key % BUCKETS).astype(np.int32), per),
                 tb.lists(count.astype(np.int32), per)], names=["lang", "ids", "counts"])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float
    usual: np.ndarray | None = None  # BUCKETS x languages: log frequency less the language's median familiarity
    spread: tuple[float, float] = (1.0, 0.0)  # variance of the familiarity: the same for all texts, and by length
    unfamiliar_below: np.ndarray | None = None  # of each language

    def familiarity(self, mean: np.ndarray, count: np.ndarray) -> np.ndarray:
        return mean / np.sqrt(self.spread[0] + self.spread[1] / np.maximum(count, 1))

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, least_steps: int = 512, rate: float = 8.0,
        max_reject: float = 0.001, max_loss: float = 0.005) -> Model:
    """Train on (language, n-gram ids, counts) rows in a fixed order; every fifth row calibrates.

    The rows are gone through 8 times, or more often (150 times at most) where ``least_steps`` batches need it.

    Rows without a language are out of any and calibrate only.
    """
    rng = np.random.default_rng(3)
    noise = [r for r in rows if r[0] is None]
    rows = [r for r in rows if r[0] is not None]
    langs = sorted({r[0] for r in rows})
    if len(langs) < 2:
        c = len(langs)
        model = Model(langs, np.zeros((BUCKETS, c), np.float32), np.zeros(c), 1.0, 0.0)
        if c:
            _familiarity(model, rows, noise, np.zeros(len(rows), int), np.ones(len(rows), bool), max_loss)
        return model
    y = np.array([langs.index(r[0]) for r in rows])
    fold = np.arange(len(rows)) % 5 == 4
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    train = np.flatnonzero(~fold)

    def pack(pick):
        ids = np.concatenate([rows[i][1] for i in pick])
        n = np.array([len(rows[i][1]) for i in pick])
        w = np.concatenate([rows[i][2] / max(1, rows[i][2].sum()) for i in pick]).astype(np.float32)
        return ids, w, np.repeat(np.arange(len(pick)), n), n

    epochs = int(np.clip(-(-least_steps * 32 // max(1, len(train))), 8, 150))
    steps = epochs * -(-len(train) // 32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for a in range(0, len(order), 32):
            pick = order[a:a + 32]
            ids, w, of, _n = pack(pick)
            vec = np.stack([np.bincount(of, w * emb[ids, d], len(pick)) for d in range(dim)], 1).astype(np.float32)
            z = vec @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            lr = rate * (1 - step / steps)
            step += 1
            back = p @ soft.T
            soft -= lr * 0.1 * (vec.T @ p)
            bias -= lr * 0.1 * p.sum(0)
            np.subtract.at(emb, ids, (lr * len(langs)) * w[:, None] * back[of])
    table = emb @ soft
    logits = np.stack([(r[2] / max(1, r[2].sum())) @ table[r[1]] + bias for r in rows])
    model = Model(langs, table.astype(np.float32), bias.astype(float), 1.0, 0.0)
    cal = np.flatnonzero(fold)
    if not len(cal):
        return model

    def loss(t):
        model.temperature = t
        return -np.log(model.probabilities(logits[cal])[np.arange(len(cal)), y[cal]] + 1e-12).mean()

    model.temperature = min(np.geomspace(0.1, 4, 30), key=loss)
    p = model.probabilities(logits)
    right = p.argmax(1) == y
    top = np.clip(p[cal][right[cal]].max(1), 1e-9, 1 - 1e-9)
    model.reject_below = float(1 / (1 + np.exp(-lowest(np.log(top / (1 - top)), max_reject))))
    _familiarity(model, rows, noise, y, right, max_loss)
    return model


def lowest(values: np.ndarray, loss: float) -> float:
    """A value that a share of about ``loss`` of further values lies below, or fewer.

    The quantile where ten values lie below it. With fewer values the normal
    tail with Student's allowance for their number, or the least value if that
    is lower; minus infinity under ``FEW`` values.
    """
    n = len(values)
    if n < FEW:
        return -np.inf
    if n * loss >= 10:
        return float(np.quantile(values, loss))
    z, v = -NormalDist().inv_cdf(loss), n - 1
    t = z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v * v)
    return float(min(values.mean() - t * values.std(ddof=1) * (1 + 1 / n) ** 0.5, values.min()))


def _familiarity(model: Model, rows: list, noise: list, y: np.ndarray, right: np.ndarray, max_loss: float) -> None:
    """Set the log frequencies of the n-grams, the spread and the limits; ``right``: rows predicted rightly."""
    n_langs, folds = len(model.langs), np.arange(len(rows)) % 5
    seen = np.zeros((5, BUCKETS, n_langs), np.float32)
    for r, c, f in zip(rows, y, folds):
        seen[f, r[1], c] += r[2]
    every = seen.sum(0)
    log = lambda s: np.log(s + 0.5) - np.log(s.sum(0) + 0.5 * BUCKETS)
    mean = lambda r, at: (r[2] / max(1, r[2].sum())) @ at[r[1]]
    got = np.zeros((len(rows), n_langs))
    for f in range(5):
        without = log(every - seen[f])
        for i in np.flatnonzero(folds == f):
            got[i] = mean(rows[i], without)
    del seen
    size = np.array([r[2].sum() for r in rows], float)
    own = got[np.arange(len(rows)), y]
    middle = np.array([np.median(own[right & (y == c)]) if (right & (y == c)).any() else np.median(own) for c in range(n_langs)])
    off = own - middle[y]
    model.spread = _spread(off[right], size[right])
    others = got - middle
    others[np.arange(len(rows)), y] = -np.inf  # the row's own language left out
    full = log(every)
    limits = []
    for c in range(n_langs):
        low = lowest(model.familiarity(off, size)[right & (y == c)], max_loss)
        best = np.flatnonzero((y != c) & (others.argmax(1) == c))
        out = [model.familiarity(others[best, c], size[best])]
        if noise:
            out.append(model.familiarity(np.array([mean(r, full[:, c]) for r in noise]) - middle[c],
                                         np.array([r[2].sum() for r in noise])))
        out = np.concatenate(out)
        high = float(np.quantile(out, 0.99)) if len(out) else low
        limits.append((low + high) / 2 if np.isfinite(low) and high < low else low)  # half way if nothing lies between
    model.usual = (full - middle).astype(np.float32)
    model.unfamiliar_below = np.array(limits)


def _spread(off: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """a and b of a variance a + b / size, by least squares of the squares against 1 and 1 / size, none negative."""
    if not len(off):
        return 1.0, 0.0
    inverse, square = 1 / np.maximum(size, 1), off ** 2
    weight = 1 / (inverse + inverse.mean())  # the squares of short texts scatter more
    x = np.stack([np.ones(len(off)), inverse], 1) * weight[:, None]
    a, b = np.linalg.lstsq(x, square * weight, rcond=None)[0]
    if b < 0:
        a, b = square.mean(), 0.0
    if a < 0:
        a, b = 0.0, (square * inverse).sum() / (inverse ** 2).sum()
    return float(a) + 1e-9, float(b)


def train(docs: DataFrame, per_lang: int = 500, max_rows: int = 20_000, max_langs: int = 1000) -> Model:
    """Fit on about ``per_lang`` documents of each language, ``max_rows`` in all.

    The sample is drawn by a hash of the text among rows that are not held out
    and have a language and a text; copies count once. With many languages
    each gets max_rows / languages; beyond ``max_langs`` languages the most
    frequent ones are learnt (ties by name). Only n-gram counts reach the
    driver.
    """
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang") \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "")
               & ~is_held_out(F.col("doc_id")))
    many = pool.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("many")).orderBy(F.col("many").desc(), "lang").limit(max_langs)
    many = [(r["lang"], r["many"]) for r in many.collect()]
    each = min(per_lang, max_rows // max(1, len(many)))
    share = docs.sparkSession.createDataFrame([(c, min(1.0, each / max(1, n))) for c, n in many], "lang string, share double")
    spot = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    picked = pool.join(F.broadcast(share), "lang").where(spot < F.col("share")).select("lang", "text").distinct()
    got = map_batches(picked, _count_features, "lang string, ids array<int>, counts array<int>") \
        .toArrow()
    rows = list(zip(got.column("lang").to_pylist(),
                    [np.asarray(x.values) for c in got.column("ids").chunks for x in c],
                    [np.asarray(x.values) for c in got.column("counts").chunks for x in c]))
    rows = [r for r in rows if len(r[1])]
    rows.sort(key=lambda r: (int(r[1][0]), len(r[1]), int(r[2].sum()), r[0] or ""))  # reruns train in the same order
    order = np.random.default_rng(1).permutation(len(rows))
    return fit([rows[i] for i in order])


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _classifier():
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = True

    def classify(m: Model, col: pa.Array) -> list[pa.Array]:
        columns = [np.ascontiguousarray(m.table[:, c]) for c in range(len(m.langs))]
        data, off = tb.string_buffers(col)
        langs, scores, usual = np.full(len(col), "und", object), np.zeros(len(col)), np.zeros(len(col))
        for lo, n, ids, rows in subwords(col):
            if m.langs:
                count = np.bincount(rows, minlength=n)
                logits = np.stack([np.bincount(rows, t[ids], n) for t in columns], 1) / np.maximum(count, 1)[:, None]
                p = m.probabilities(logits + m.bias)
                best = p.argmax(1)
                if m.usual is not None:
                    mean = np.bincount(rows, m.usual[ids, best[rows]], n) / np.maximum(count, 1)
                    usual[lo:lo + n] = m.familiarity(mean, count) - m.unfamiliar_below[best]
                langs[lo:lo + n] = np.array(m.langs, object)[best]
                scores[lo:lo + n] = p.max(1)
            for i in range(lo, lo + n):
                text = data[off[i]:off[i + 1]]
                if not letters[text].any() and not has_letter(text.tobytes()):
                    langs[i], scores[i] = "und", 0.0
        ok = (langs != "und") & (scores >= m.reject_below) & (usual >= 0)
        return [pa.array(langs, pa.string()), pa.array(scores), pa.array(ok.astype(bool))]

    return classify


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and accepted, or ``names`` in their place.

    ``und`` with score 0 and not accepted: null, empty, or no letter in the
    text. ``accepted`` is false where the confidence or the familiarity is
    below its calibrated limit. Repeated rows give equal rows; other columns pass through, but for
    those named like the new ones; an empty table gives no rows; a model
    without languages calls everything ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    classify = _classifier()
    fields = ", ".join(f"{n} {t}" for n, t in zip(names, ("string", "double", "boolean")))
    return appended(docs, "text", fields, lambda col: classify(sent.value, col))
