"""Phrase collocations by dynamic itemset counting (operator 12).

The corpus is dealt into shards that are scanned in a cycle, one a step.
Counters of all lengths run side by side: words from the first step on, a
longer phrase from the step after both its subphrases (without its last,
without its first word) have reached the threshold in what was counted so far.
Every counter runs until it has met each shard once; the scan ends when no
counter is left that has not completed its cycle.

A shard holds the texts as 32-bit hashes of (language, word), cut into pieces
once, so a scan reads numbers. Counters are 64-bit hashes of runs of them. A
scan's counts are summed by counter in a shuffle and added to the written
state of all counters. Tasks learn which subphrases have reached the
threshold, and when, from a table of fixed size: for two places of each
counter the first and the last step at which one of that place got there. That tells a
step at or before a counter's start and one at or after its end. So a counter
may run too early or too long, never too short; a state bit for each shard
keeps what is met twice from counting twice. Phrases that share a hash only
make a counter too high. So the counters that end at or above the threshold
hold every frequent phrase, and the texts are read once more to count these
by their words: that count is exact. When more phrases are frequent than the
table has places, more is counted in vain, nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import map_batches, written
from serpframe.session import remove_folder, scratch_path

#: Bytes at which a text is cut into pieces, and those between words.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = PIECE_END.copy()
GAP[[0x20, 0x09]] = True
#: Bytes of text, and words, that a task works on at a time; a longer text is taken by itself.
BLOCK_BYTES = 1 << 20
BLOCK_WORDS = 1 << 20
_NEVER = 255
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _lang_marks(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    codes = langs.dictionary_encode()
    per = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                    for x in codes.dictionary.to_pylist()], np.uint64)
    return per[codes.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0, np.uint64)


def _numbers(w: tb.Words, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a chunk as numbers above 0 with a 0 between pieces, and where each word is."""
    piece = np.cumsum(PIECE_END[w.data])[w.start] + w.row  # equal for words of one piece only
    at = np.arange(len(w.start)) + np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)
    ids = np.zeros(int(at[-1]) + 2 if len(at) else 1, np.uint32)
    ids[at] = np.maximum(tb.mix(w.hashes() ^ marks[w.lo:w.hi][w.row]) >> np.uint64(32), 1)
    return ids, at


def _dealt(shards: int):
    """Blocks of texts as numbers, dealt to the shards in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            marks = _lang_marks(batch.column(0))
            for w in tb.chunks(batch.column(1), lower=True, limit=BLOCK_BYTES, space=GAP):
                if len(w.start):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([turn % shards], pa.int32()), pa.array([_numbers(w, marks)[0].tobytes()], pa.binary())],
                        names=["shard", "ids"])
                    turn += 1

    return run


class Reached:
    """When counters reached the threshold: first and last step for each place, in the bytes of one number."""

    def __init__(self, bits: int):
        self.bits = bits
        self.steps = np.full(1 << bits, _NEVER, np.uint16)  # last step in the upper byte, first in the lower

    def add(self, places: np.ndarray, step: int) -> None:
        self.steps[places] = np.minimum(self.steps[places] & 0xFF, step) | step << 8

    def span(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The latest first step and the earliest last step of the two places of each counter."""
        mask = np.uint64((1 << self.bits) - 1)
        a, b = self.steps[(h & mask).astype(np.int64)], self.steps[((h >> np.uint64(32)) & mask).astype(np.int64)]
        return np.maximum(a & 0xFF, b & 0xFF), np.minimum(a >> 8, b >> 8)


def _places(counters: DataFrame, bits: int) -> np.ndarray:
    """The places of the counters ``h``: at most all places reach the driver."""
    mask = (1 << bits) - 1
    both = counters.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)),
                                             F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))).alias("p"))
    return both.select(F.col("p").cast("int").alias("p")).distinct().toArrow().column("p").to_numpy()


def _longer(ids: np.ndarray, at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of k numbers from runs of k - 1 at places ``at``: which of these start one, and its hash."""
    both = np.flatnonzero(at[1:] == at[:-1] + 1)
    return both, tb.mix(h[both] * _NEXT + ids[at[both] + (k - 1)])


def _active(ids: np.ndarray, reached: Reached, step: int, shards: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hash of each run) of the runs whose counters are on in this step."""
    at = np.flatnonzero(ids)
    h = tb.mix(ids[at].astype(np.uint64))
    if step < shards:
        yield 1, h
    for k in range(2, longest + 1):
        first, last = reached.span(h)
        ok = np.flatnonzero(first < step)
        at, h, last = at[ok], h[ok], last[ok]
        both, run = _longer(ids, at, h, k)
        if not len(both):
            return
        on = step <= np.maximum(last[both], last[both + 1]) + np.uint16(shards)
        at, h = at[both], run
        yield k, run[on]


def _counter(reached, step: int, shards: int, longest: int):
    """Counts of the active runs of a task's blocks, a stretch of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(0)]
            size = np.cumsum([len(b) for b in blobs]) // BLOCK_WORDS
            for part in np.unique(size):
                ids = np.concatenate([b for b, p in zip(blobs, size) if p == part])
                for k, h in _active(ids, reached.value, step, shards, longest):
                    counter, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(counter.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.full(len(n), k, np.int64))],
                        names=["h", "more", "info"])

    return run


def _exact(kept, longest: int):
    """Counts by language and words of the runs that ``kept`` may hold; of all words under the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "c"]
        for batch in batches:
            lang = batch.column(0)
            marks = _lang_marks(lang)
            for w in tb.chunks(batch.column(1), lower=True, limit=BLOCK_BYTES, space=GAP):
                if not len(w.start):
                    continue
                yield pa.RecordBatch.from_arrays([lang.slice(w.lo, w.hi - w.lo), pa.array([""] * (w.hi - w.lo)),
                                                  pa.array(w.count.astype(np.int64))], names=names)
                ids, at = _numbers(w, marks)
                word, h = np.arange(len(at)), tb.mix(ids[at].astype(np.uint64))
                size = np.zeros(len(at) + 1, np.int32)
                np.cumsum(w.end - w.start, out=size[1:])
                strings = pa.StringArray.from_buffers(len(at), pa.py_buffer(size), pa.py_buffer(w.data[~GAP[w.data]]))
                for k in range(1, longest + 1):
                    ok = np.flatnonzero(kept.value.span(h)[0] < _NEVER)
                    at, word, h = at[ok], word[ok], h[ok]
                    # a hash tells runs apart well enough to count within a block; one that two phrases share is not used
                    _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    code = _checks(w, word, k)
                    if (code != code[first][which]).any():
                        first, n = np.arange(len(h)), np.ones(len(h), np.int64)
                    parts = [strings.take(pa.array(word[first] + j)) for j in range(k)]
                    text = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays([lang.take(pa.array(w.lo + w.row[word[first]])), text,
                                                      pa.array(n.astype(np.int64))], names=names)
                    if k < longest:
                        both, h = _longer(ids, at, h, k + 1)
                        at, word = at[both], word[both]
                    if not len(at):
                        break

    return run


def _checks(w: tb.Words, word: np.ndarray, k: int) -> np.ndarray:
    """A second hash of the k words from each word on, independent of the numbers."""
    if not hasattr(w, "second"):
        w.second = w.hashes(1)
    return tb.range_hash(w.second, word, word + k, 1)


def frequent(docs: DataFrame, least: int = 100, longest: int = 5, shards: int = 2, slot_bits: int = 22) -> DataFrame:
    """lang, k, phrase, c of every phrase of up to ``longest`` words that occurs ``least`` times in its language.

    Rows with k = 0 hold the number of all words of a language (if it has
    any). A null language is ``und``; null and empty texts have no words;
    repeated rows count again; texts are read whole, other columns ignored;
    an empty table gives no rows. ``shards`` is at most 24, and
    2**``slot_bits`` places (two bytes each) are broadcast in each step.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    place = scratch_path(spark, "phrase-shards")
    map_batches(texts, _dealt(shards), "shard int, ids binary").write.partitionBy("shard").parquet(place)
    reached, state, held, step, until = Reached(slot_bits), None, None, 0, shards - 1
    while step <= until:
        shard = spark.read.schema("ids binary, shard int").parquet(place).where(F.col("shard") == step % shards)
        sent = spark.sparkContext.broadcast(reached)
        state = _with_counts(state, map_batches(shard.select("ids"), _counter(sent, step, shards, longest),
                                                "h long, more long, info long"), step, shards, least)
        to = scratch_path(spark, "phrase-counts")
        state.write.parquet(to)
        state = spark.read.schema(state.schema).parquet(to)
        if held:
            remove_folder(spark, held)
        held = to
        places = _places(state.where((F.shiftright("info", 48) == step + 1) & (F.col("info").bitwiseAND(255) < longest)), slot_bits)
        if len(places):
            reached.add(places, step)
            until = max(until, step + shards)
        sent.destroy()
        step += 1
    remove_folder(spark, place)
    kept = Reached(slot_bits)
    kept.add(_places(state.where(F.col("c") >= least), slot_bits), 0)
    exact = map_batches(texts, _exact(spark.sparkContext.broadcast(kept), longest), "lang string, phrase string, c long") \
        .groupBy("lang", "phrase").agg(F.sum("c").alias("c"))
    k = F.expr("cast(if(phrase = '', 0, length(phrase) - length(replace(phrase, ' ', '')) + 1) as int)")
    return exact.where((F.col("c") >= least) | (F.col("phrase") == "") & (F.col("c") > 0)).select("lang", k.alias("k"), "phrase", "c")


def _with_counts(state: DataFrame | None, counts: DataFrame, step: int, shards: int, least: int) -> DataFrame:
    """The state of all counters (h, c, info) after a step.

    info, from its highest bits: the step of reaching the threshold + 1, the
    step of the last count + 1, a bit for each shard that is counted, the
    number of words. Counters that ended their cycle below the threshold go:
    nothing was counted for ``shards`` steps, or they are words.
    """
    rows = counts.select("h", F.lit(0).cast("long").alias("c"), "more", "info")
    if state is not None:
        rows = state.select("h", "c", F.lit(0).cast("long").alias("more"), "info").unionByName(rows)
    bit, info = 1 << (step % shards), F.col("info")
    at, last = F.shiftright(info, 48), F.shiftright(info, 32).bitwiseAND(65535)
    met, k = F.shiftright(info, 8).bitwiseAND((1 << 24) - 1), info.bitwiseAND(255)
    fresh = (F.col("more") > 0) & (met.bitwiseAND(F.lit(bit)) == 0)
    new = rows.groupBy("h").agg(F.sum("c").alias("c"), F.sum("more").alias("more"), F.max("info").alias("info")) \
        .select("h", (F.col("c") + F.when(fresh, F.col("more")).otherwise(0)).alias("c"),
                F.when(F.col("more") > 0, F.lit(step + 1)).otherwise(last).alias("last"), at.alias("at"), k.alias("k"),
                F.when(fresh, met.bitwiseOR(F.lit(bit))).otherwise(met).alias("met"))
    over = F.col("last") <= step + 1 - shards
    if step >= shards - 1:
        over = over | (F.col("k") == 1)  # words have run since the first step
    reach = F.when(F.col("at") > 0, F.col("at")).when(F.col("c") >= least, F.lit(step + 1)).otherwise(0)
    wide = lambda c, n: F.shiftleft(c.cast("long"), n)
    return new.where((F.col("c") >= least) | ~over) \
        .select("h", "c", (wide(reach, 48) + wide(F.col("last"), 32) + wide(F.col("met"), 8) + F.col("k")).alias("info"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000,
                 shards: int = 2, slot_bits: int = 22) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words scores floor(1000 * a * n / (l * r)) at
    the cut into l and r that scores lowest (ties: the first cut). Phrases in
    a longer one that occurs ``percent`` % as often are left out. Ordered by
    score, a, phrase (bytes); ``rank`` is from 1. See ``frequent`` for nulls,
    empty and long texts, repeated rows and empty tables.
    """
    return scored(written(frequent(docs, least, longest, shards, slot_bits), "phrase-frequent"), percent, top)


def scored(all_: DataFrame, percent: int, top: int) -> DataFrame:
    """The rows of ``collocations`` from those of ``frequent``."""
    words = all_.where("k = 0").select("lang", F.col("c").alias("n"))
    known = all_.where("k > 0")
    w = F.split("phrase", " ")
    cand = known.where("k > 1").withColumn("w", w)
    inner = cand.where("k > 2").select(
        "lang", "c", F.explode(F.expr(
            "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> "
            "concat_ws(' ', slice(w, i, m)))))")).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("c").alias("above"))
    cuts = cand.select("lang", "phrase", F.col("c").alias("a"), "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")) \
        .select("lang", "phrase", "a", "cut", F.concat_ws(" ", F.expr("slice(w, 1, cut)")).alias("left"),
                F.concat_ws(" ", F.expr("slice(w, cut + 1, k - cut)")).alias("right"))
    cuts = written(cuts, "phrase-cuts")
    part = known.select("lang", F.col("phrase"), F.col("c"))
    met = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")), ["lang", "left"]) \
        .join(part.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")), ["lang", "right"]) \
        .join(words, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of three stay below 10**38
    met = met.withColumn("num", (whole("a") * whole("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")) \
        .withColumn("den", whole("l") * whole("r")).withColumn("score", F.expr("num div den"))
    best = met.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")) \
        .select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    kept = best.join(inner, ["lang", "phrase"], "left") \
        .where(F.col("above").isNull() | (F.lit(100) * F.col("above") < F.lit(percent) * F.col("a")))
    order = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    return kept.withColumn("rank", order.cast("long")).where(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
