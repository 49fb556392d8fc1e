"""Toxicity by non-negative positive-unlabelled learning (operator 5).

Features of a text are which hashed words and word beginnings (4 to 6 bytes)
it holds. From confirmed toxic documents (P) and unlabelled documents (U) the
features that P holds clearly more often than U are chosen, and a logistic
model is fitted in numpy on the class-prior-corrected risk

    prior * E_P[loss(z)] + max(0, E_U[loss(-z)] - prior * E_P[loss(-z)])

whose second term, the risk on the unseen negatives, is kept from going below
zero: when it does, the step goes against its gradient only. The prior is the
share of toxic rows among the labelled ones learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.language_id import is_held_out
from serpframe.llm.tables import map_batches

SCREEN_BITS = 20
HEADS = (4, 5, 6)


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, feature ids, row of each) of each chunk; repeats stay."""
    for w in tb.chunks(pc.utf8_lower(col), space=tb.PUNCT):
        vals = tb._TABLES[0][w.data]
        ids, rows = [tb.range_hash(vals, w.start, w.end)], [w.row]
        for k in HEADS:
            long = w.end - w.start > k
            ids.append(tb.range_hash(vals, w.start[long], w.start[long] + k) ^ np.uint64(k << 60))
            rows.append(w.row[long])
        yield w.lo, w.hi - w.lo, (np.concatenate(ids) >> np.uint64(32)).astype(np.uint32), np.concatenate(rows)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, n, ids, rows in features(batch.column("text")):
            key = np.unique(rows.astype(np.int64) << 32 | ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").slice(lo, n),
                 tb.lists(key.astype(np.uint32).view(np.int32), np.bincount(key >> 32, minlength=n))],
                names=["toxic", "ids"])


@dataclass
class Model:
    ids: np.ndarray  # of the chosen features, sorted
    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.screen = np.zeros(1 << SCREEN_BITS, bool)
        self.screen[self.ids & ((1 << SCREEN_BITS) - 1)] = True

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` that are chosen features, and which."""
        at = np.flatnonzero(self.screen[ids & np.uint32((1 << SCREEN_BITS) - 1)])
        if not len(at):
            return at, at
        which = np.minimum(np.searchsorted(self.ids, ids[at]), len(self.ids) - 1)
        ok = self.ids[which] == ids[at]
        return at[ok], which[ok]


def _descend(pos: list[np.ndarray], unl: list[np.ndarray], ids: np.ndarray, prior: float, steps: int, rate: float,
             decay: float) -> Model:
    """Non-negative PU risk on the features ``ids``, minimised with Adam on full batches."""
    model = Model(ids, np.zeros(len(ids)), 0.0)

    def pack(rows):
        at = [model.find(r)[1] for r in rows]
        return np.concatenate(at), np.repeat(np.arange(len(rows)), [len(a) for a in at])

    (pi, pr), (ui, ur) = pack(pos), pack(unl)
    w, b = np.zeros(len(ids)), float(np.log(prior / (1 - prior)))
    mom, var = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        zp = np.bincount(pr, w[pi], len(pos)) + b
        zu = np.bincount(ur, w[ui], len(unl)) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        dp, du = np.zeros(len(pos)), sig(zu) / len(unl)
        if negative >= 0:
            dp += prior * (sig(zp) - 1) / len(pos)  # pull up what is confirmed toxic
            dp -= prior * sig(zp) / len(pos)
        else:
            dp += prior * sig(zp) / len(pos)
            du = -du
        grad = np.append(np.bincount(pi, dp[pr], len(w)) + np.bincount(ui, du[ur], len(w)) + decay * w / len(w) ** 0.5,
                         dp.sum() + du.sum())
        mom = 0.9 * mom + 0.1 * grad
        var = 0.999 * var + 0.001 * grad * grad
        step = rate * (mom / (1 - 0.9 ** t)) / (np.sqrt(var / (1 - 0.999 ** t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return Model(ids, w, float(b))


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, least: int = 4, least_share: float = 0.005,
        sure: float = 5.0, slight: float = 0.5, steps: int = 800, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Choose features, fit, leave out the ones that turned out slight, fit again.

    A feature of toxic texts alone is 1 / prior times as frequent in P as in U.
    Chosen is what reaches a third of that in ``least`` documents of P, a share
    ``least_share`` of them, and ``sure`` standard errors. Copies count once.
    """
    none = Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    pos, unl = (list({r.tobytes(): r for r in rows}.values()) for rows in (pos, unl))
    if not pos or not unl:
        return none
    seen, in_p = np.unique(np.concatenate(pos), return_counts=True)
    often = in_p >= max(least, least_share * len(pos))
    seen, in_p = seen[often], in_p[often]
    all_u = np.sort(np.concatenate(unl))
    in_u = np.searchsorted(all_u, seen, side="right") - np.searchsorted(all_u, seen)
    p, u = in_p / len(pos), in_u / len(unl)
    pooled = (in_p + in_u) / (len(pos) + len(unl))
    z = (p - u) / np.sqrt(pooled * (1 - pooled) * (1 / len(pos) + 1 / len(unl)) + 1e-12)
    chosen = seen[(p >= max(2.0, 0.35 / prior) * u) & (z >= sure)]
    for _ in range(2):
        if not len(chosen):
            return none
        model = _descend(pos, unl, chosen, prior, steps, rate, decay)
        chosen = chosen[model.weight >= slight]
    return model


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 9000) -> Model:
    """Fit on bounded samples, drawn by a hash of doc_id, of rows that are not held out.

    P: up to ``positives`` documents whose label is toxic. U: up to
    ``unlabelled`` documents, labelled or not. Only feature ids reach the
    driver.
    """
    open_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not n["p"]:
        return fit([], [], 1e-3)
    prior = min(0.9, n["p"] / n["n"])
    total = open_.agg(F.count("*")).first()[0]
    spot = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40))

    def within(want: int, there: int):
        return spot < int(min(1.0, want / max(1, there)) * (1 << 40))

    chosen = known.where("toxic = 1").where(within(positives, n["p"])).select("doc_id").limit(2 * positives)
    sample = open_.join(F.broadcast(chosen), "doc_id").select(F.lit(1).alias("toxic"), "text") \
        .unionByName(open_.where(within(unlabelled, total)).limit(2 * unlabelled).select(F.lit(0).alias("toxic"), "text"))
    got = map_batches(sample, _feature_rows, "toxic int, ids array<int>").toArrow()
    toxic = got.column("toxic").to_pylist()
    ids = [np.asarray(x.values).view(np.uint32) for c in got.column("ids").chunks for x in c]
    order = sorted(range(len(ids)), key=lambda i: (len(ids[i]), ids[i].tobytes()))
    return fit([ids[i] for i in order if toxic[i]], [ids[i] for i in order if not toxic[i]], prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row, over whole texts.

    Null and empty texts hold no feature: their score is that of the bias.
    Repeated rows give equal rows; other columns are ignored; an empty table
    gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo, n, ids, rows in features(batch.column(1)):
                at, which = m.find(ids)
                key = np.unique(rows[at].astype(np.int64) << 32 | which)
                z = np.bincount(key >> 32, m.weight[key & 0xFFFFFFFF], n) + m.bias
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")
