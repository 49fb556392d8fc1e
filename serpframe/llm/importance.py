"""Importance resampling towards a target corpus by bit-sliced aggregation (operator 11).

Features are words and pairs of neighbouring words, hashed by crc32 into
``BUCKETS``. How much more frequent a bucket is in the target than in the
corpus is its gain, a whole number. The weight of a document is the mean gain
of its features. It is summed without looking a gain up for each feature: the
bucket counts of a document are written as bit planes (plane j holds bit j of
every count), the gains as planes of their two's complement, and

    sum of count * gain = sum over j, k of +-2**(j+k) * popcount(count plane j AND gain plane k)

which is exact. Gumbel noise from a hash of the id turns the highest scores
into a sample without replacement. Only the bucket totals, a row for each
bucket, and one count for each sorted partition reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import map_batches, written

BUCKETS = 10_000
SLOTS = -(-BUCKETS // 64)  # 64-bit pieces of a plane
#: Words of more bytes go through zlib one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    acc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        acc = (acc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (acc & np.uint32(1)))
    return acc


_STEP = _crc_table()


def _zero_tables() -> np.ndarray:
    """[n, j, byte]: what a crc register holding ``byte`` at place j becomes after n zero bytes."""
    at = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
    out = [at]
    for _ in range(LONG + 1):
        at = _STEP[at & 0xFF] ^ (at >> np.uint32(8))
        out.append(at)
    return np.stack(out)


_ZEROS = _zero_tables()
_BLANK = np.uint32(zlib.crc32(b" "))


def _append_zeros(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = _ZEROS[n, 0, crc & 0xFF]
    for j in (1, 2, 3):
        out = out ^ _ZEROS[n, j, (crc >> np.uint32(8 * j)) & 0xFF]
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of the byte ranges, a byte place of all words at a time."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    first, size = start[order], size[order]
    acc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for p in range(min(int(size[0]), LONG) if len(size) else 0):
        m = int(np.searchsorted(-size, -p, side="left"))
        a = acc[:m]
        acc[:m] = _STEP[(a ^ data[first[:m] + p]) & 0xFF] ^ (a >> np.uint32(8))
    acc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -LONG, side="left"))):
        acc[i] = zlib.crc32(data[first[i]:first[i] + size[i]].tobytes())
    out = np.empty_like(acc)
    out[order] = acc
    return out


def pair_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """crc32 of ``word i, space, word i + 1`` for the words i in ``left``, put together from those of the words."""
    size = (end - start)[left + 1]
    fits = np.minimum(size, LONG)
    out = _append_zeros(crc[left], fits + 1) ^ _append_zeros(np.full(len(left), _BLANK), fits) ^ crc[left + 1]
    for i in np.flatnonzero(size > LONG):
        k = left[i] + 1
        out[i] = zlib.crc32(b" " + data[start[k]:end[k]].tobytes(), int(crc[left[i]]))
    return out


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, words of each row, buckets, row of each bucket) of each chunk; repeats stay."""
    for w in tb.chunks(col, lower=True, space=tb.PUNCT):
        crc = word_crcs(w.data, w.start, w.end)
        left = np.flatnonzero(w.row[:-1] == w.row[1:])
        pairs = pair_crcs(w.data, w.start, w.end, crc, left)
        yield w.lo, w.hi - w.lo, w.count, (np.concatenate([crc, pairs]) % np.uint32(BUCKETS)).astype(np.int64), \
            np.concatenate([w.row, w.row[left]])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends one row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, bucket, _ in features(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    got = map_batches(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in got:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + BUCKETS) / ((float(a) + 1) * (t + BUCKETS))))
                     for a, b in zip(corpus, target)], np.int64)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Two's complement bit planes of whole numbers, 64 buckets in a piece; the last plane is the sign."""
    width = int(np.abs(values).max(initial=0)).bit_length() + 1
    bits = (values[None, :] >> np.arange(width)[:, None]) & 1
    flat = np.zeros((width, SLOTS * 64), np.uint8)
    flat[:, :len(values)] = bits
    return np.packbits(flat, axis=1, bitorder="little").view(np.uint64).reshape(width, SLOTS)


def weigh(bucket: np.ndarray, row: np.ndarray, rows: int, planes: np.ndarray) -> np.ndarray:
    """Sum of the gains of all features of each row, from bit planes of its bucket counts."""
    key, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    of, spot = key // BUCKETS, key % BUCKETS
    slot, bit = of * SLOTS + (spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64)
    total = np.zeros(rows, np.int64)
    for j in range(int(count.max(initial=0)).bit_length()):
        on = np.flatnonzero(count >> j & 1)
        if not len(on):
            continue
        head = np.flatnonzero(np.diff(slot[on], prepend=-1))
        plane, at = np.bitwise_or.reduceat(bit[on], head), slot[on][head]
        piece = at % SLOTS
        ones = np.zeros(len(at), np.int64)
        for k, gain in enumerate(planes):
            there = np.bitwise_count(plane & gain[piece]).astype(np.int64) << k
            ones += -there if k == len(planes) - 1 else there
        r = at // SLOTS
        first = np.flatnonzero(np.diff(r, prepend=-1))
        total[r[first]] += np.add.reduceat(ones, first) << j
    return total


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``.

    Of the N rows with ``least_words`` words, the floor(percent * N / 100) of
    the highest scores are drawn and ranked from 1; ties go to the smaller
    doc_id, a null one last, rows that agree in both in any order. The rank of
    other rows is null. Null, empty and wordless texts have no features and
    weight 0. Repeated rows count and are drawn each for itself. Texts are
    read whole; other columns are ignored; an empty table gives no rows, an
    empty target lets all buckets be equally frequent.
    """
    spark = docs.sparkSession
    planes = spark.sparkContext.broadcast(bit_planes(gains(bucket_counts(docs), bucket_counts(target))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, words, bucket, row in features(batch.column(1)):
                many = np.bincount(row, minlength=n)
                total = weigh(bucket, row, n, planes.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(words), pa.array(many), pa.array(total // np.maximum(many, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    weighed = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                          "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256),
                           1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("score", (F.col("weight") + noise).cast("long"))
                     .withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    able = F.col("n_words") >= least_words
    take = percent * scored.where(able).count() // 100
    # sorted partitions in order: the id tells the partition and the place in it
    line = written(scored.where(able).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
                   .withColumn("place", F.monotonically_increasing_id()), "resample-sorted")
    sizes = line.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    before, ahead = [], 0
    for r in sizes:
        before.append((r["part"], ahead))
        ahead += r["count"]
    before = spark.createDataFrame(before, "part long, ahead long")  # a row for each partition
    rank = F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = line.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before), "part") \
        .withColumn("rank", F.when(rank <= take, rank))
    cols = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(cols).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(cols))
