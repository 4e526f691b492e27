"""Greedy batches of bounded size over an order, worked out in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.session import shared_folder

#: Sets and listings of one batch at most.
SETS, LISTINGS = 25, 250


def _ends(sizes: np.ndarray, most: int, total: int) -> np.ndarray:
    """Of a batch that begins at each place: where the next one begins, if all that follows were there. A set above total alone is a batch of its own."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    by_total = np.searchsorted(sums, sums[:-1] + total, "right") - 1
    return np.maximum(np.minimum(by_total, np.arange(len(sizes)) + most), np.arange(len(sizes)) + 1)


def _walk(sizes: np.ndarray, most: int, total: int) -> tuple[np.ndarray, int, int]:
    """The batch of each set, from 1, if the first one begins a batch; the sets and the sizes of the last batch."""
    new = np.zeros(len(sizes), np.int64)
    ends, at, begin = _ends(sizes, most, total), 0, 0
    while at < len(sizes):
        new[at], begin = 1, at
        at = int(ends[at])
    return np.cumsum(new), len(sizes) - begin, int(sizes[begin:].sum())


def batched(sets: DataFrame, order: str, size: str, most: int = SETS, total: int = LISTINGS) -> DataFrame:
    """sets and the number of each one's batch, from 0, as by going through them in order (a unique column): a batch closes before the set that would give
    it more than most sets or total listings; a set above total alone is a batch of its own.

    Sets are sorted by ranges, a task each. What a range does depends on how many of its first sets still fit into the batch that is open before it: none up to most. So
    each range gives a row for each such number: the batches it begins then, and what is open behind it. The driver reads these rows range by range, most + 1 of them at a
    time, and keeps two numbers a range; then the sets of each range are numbered. Null sizes count as 0.
    """
    spark = sets.sparkSession
    shared_folder(spark)
    placed = sets.withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("long")).repartitionByRange(order).sortWithinPartitions(order).withColumn("__range", F.spark_partition_id()).checkpoint()

    def beginnings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            sizes = np.concatenate([f["__size"].to_numpy(np.int64) for f in held])
            number = int(held[0]["__range"].iloc[0])
            rows = []
            # The open batch takes the first p sets, whatever it holds already; p is most at most.
            for p in range(min(most, len(sizes)) + 1):
                own, count, filled = _walk(sizes[p:], most, total)
                rows.append((number, p, int(sizes[:p].sum()), int(own[-1]) if len(own) else 0, count, filled, len(sizes)))
            yield pd.DataFrame(rows, columns=["range", "taken", "taken_size", "begun", "open_sets", "filled", "n"])

    table = placed.select("__range", "__size").mapInPandas(beginnings, "range int, taken int, taken_size long, begun long, open_sets int, filled long, n long").orderBy("range", "taken")
    first: dict[int, tuple[int, int]] = {}
    batch, count, filled, now = -1, 0, 0, []

    def passed(rows: list) -> None:
        nonlocal batch, count, filled
        # How many of the range's first sets the open batch takes.
        fits = [r for r in rows if count and count + r.taken <= most and filled + r.taken_size <= total]
        r = fits[-1] if fits else rows[0]
        first[r.range] = (batch, r.taken)
        if r.taken < r.n:
            batch, count, filled = batch + r.begun, r.open_sets, r.filled
        else:
            count, filled = count + r.taken, filled + r.taken_size

    for row in table.toLocalIterator():
        if now and now[0].range != row.range:
            passed(now)
            now = []
        now.append(row)
    if now:
        passed(now)

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            frame = pd.concat(held, ignore_index=True)
            before, taken = first[int(frame["__range"].iloc[0])]
            own, _, _ = _walk(frame["__size"].to_numpy(np.int64)[taken:], most, total)
            frame["batch"] = before + np.concatenate([np.zeros(taken, np.int64), own])
            yield frame.drop(columns=["__size", "__range"])

    return placed.mapInPandas(numbered, T.StructType([*sets.schema.fields, T.StructField("batch", T.LongType())]))
