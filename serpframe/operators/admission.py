"""Admission of requests of several units against a daily quota.

A request of n units passes while ``used + n <= quota``; a passed and
successful one uses its units up, a refused one leaves room for a smaller one
after it. So what passes depends on everything before it on that day, and a
running sum is wrong.

What a stretch of requests does to the units used on entry is a map from
0..quota to 0..quota that adds the same number over whole intervals: at most
quota + 1 of them, and few in practice. The day is cut into chunks of rows in
order; the map of each chunk is found by itself, the maps of a range are
composed, the ranges are followed from the start of the day, then the chunks
of each range, and each chunk is gone through once more from what it is
entered with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.operators.ordered import CHUNK_ROWS, in_order

Steps = tuple[np.ndarray, np.ndarray]  # first entry value of each interval, what is added in it
_MAP = "_dk int, _part long, _chunk long, start array<long>, shift array<long>"


def chunk_map(units: np.ndarray, quota: int) -> Steps:
    """What requests of these units, all successful, add to the units used on entry."""
    start, shift = np.zeros(1, np.int64), np.zeros(1, np.int64)
    last = max(quota, 0)
    for n in units[units > 0]:
        fits = quota - n - shift  # entry values up to this pass
        some = start <= fits
        if not some.any():
            continue
        end = np.append(start[1:] - 1, last)
        cut = some & (end > fits)
        at = np.concatenate([start, fits[cut] + 1])
        add = np.concatenate([shift + np.where(some, n, 0), shift[cut]])
        order = np.argsort(at, kind="stable")
        start, shift = _joined(at[order], add[order])
    return start, shift


def _joined(start: np.ndarray, shift: np.ndarray) -> Steps:
    """Neighbouring intervals that add the same become one."""
    keep = np.append(True, shift[1:] != shift[:-1])
    return start[keep], shift[keep]


def then(f: Steps, g: Steps, quota: int) -> Steps:
    """The map that goes through ``f``, then ``g``."""
    end = np.append(f[0][1:] - 1, max(quota, 0))
    at, add = [], []
    for a, b, c in zip(f[0], end, f[1]):
        inner = g[0][(g[0] > a + c) & (g[0] <= b + c)] - c
        cuts = np.append(a, inner)
        at.append(cuts)
        add.append(c + g[1][np.searchsorted(g[0], cuts + c, side="right") - 1])
    return _joined(np.concatenate(at), np.concatenate(add))


def leave(f: Steps, used: int) -> int:
    return int(used + f[1][np.searchsorted(f[0], used, side="right") - 1])


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _maps(table: pa.Table) -> list[Steps]:
    """The maps of a table in the order of its chunks."""
    lists = zip(table.column("start").to_pylist(), table.column("shift").to_pylist())
    return [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in lists]


def quota_admission(requests: DataFrame, quota: int, units: str = "units", ts: str = "ts", id_col: str = "request_id",
                    ok: str = "ok", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every request with ``day``, ``used_before`` and ``accepted``, in order of time and id within its day.

    Null units count as one. Fewer than zero units pass without a test and use
    nothing; zero units pass while the quota is kept. Only an accepted request
    with ``ok`` 1 uses its units up. Rows without a time are a day of their
    own; rows that agree in time and id are taken by their other columns.
    """
    quota, given = int(quota), requests.columns
    day = F.to_date(ts)
    line = requests.withColumn("_dk", F.coalesce(F.unix_date(day), F.lit(-(1 << 31)))) \
        .withColumn("_n", F.coalesce(F.col(units).cast("long"), F.lit(1))) \
        .withColumn("_took", F.coalesce(F.col(ok) == 1, F.lit(False)))
    line = in_order(line, ["_dk", ts, id_col, "_n", "_took"], "admission", chunk_rows) \
        .withColumn("_part", F.shiftright("_at", 33))

    def one_chunk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        start, shift = chunk_map(_numbers(table, "_n")[_numbers(table, "_took")], quota)
        return pa.table({"_dk": table["_dk"][:1], "_part": table["_part"][:1], "_chunk": table["_chunk"][:1],
                         "start": [start], "shift": [shift]})

    def one_range(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        first, *rest = _maps(table)
        for g in rest:
            first = then(first, g, quota)
        return pa.table({"_dk": table["_dk"][:1], "_part": table["_part"][:1], "_chunk": table["_chunk"][:1],
                         "start": [first[0]], "shift": [first[1]]})

    def entered(table: pa.Table, used: int, by: str) -> pa.Table:
        table = table.sort_by(by)
        at = []
        for f in _maps(table):
            at.append(used)
            used = leave(f, used)
        return pa.table({"_dk": table["_dk"], by: table[by], "used": pa.array(at, pa.int64())})

    def of_range(key, chunks: pa.Table, entry: pa.Table) -> pa.Table:
        return entered(chunks, entry["used"][0].as_py(), "_chunk")

    def replay(key, rows: pa.Table, entry: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        used, before, passed = entry["used"][0].as_py(), [], []
        for n, took in zip(_numbers(rows, "_n").tolist(), _numbers(rows, "_took").tolist()):
            fits = n < 0 or used + n <= quota
            before.append(used)
            passed.append(fits)
            if fits and took and n > 0:
                used += n
        return rows.select(given).append_column("used_before", pa.array(before, pa.int64())) \
            .append_column("accepted", pa.array(passed, pa.bool_()))

    maps = line.select("_dk", "_part", "_chunk", "_at", "_n", "_took").groupBy("_dk", "_chunk").applyInArrow(one_chunk, _MAP)
    path_maps = maps.groupBy("_dk", "_part").applyInArrow(one_range, _MAP)
    ranges = path_maps.groupBy("_dk").applyInArrow(lambda t: entered(t, 0, "_part"), "_dk int, _part long, used long")
    chunks = maps.groupBy("_dk", "_part").cogroup(ranges.groupBy("_dk", "_part")) \
        .applyInArrow(of_range, "_dk int, _chunk long, used long")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    out = line.groupBy("_dk", "_chunk").cogroup(chunks.groupBy("_dk", "_chunk")) \
        .applyInArrow(replay, f"{fields}, used_before long, accepted boolean")
    return out.withColumn("day", F.to_date(ts))
