"""Order-dependent operators: one key's rows are folded in the order of an explicit ordinal."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspan.operators.runs import fold_runs


def build_blocks(lines: DataFrame, key: str, ordinal: str, text: str, page: str) -> DataFrame:
    """n_lines, text in order and number of pages of each block."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(ordinal), F.col(text))))
    return lines.groupBy(key).agg(F.count("*").alias("n_lines"), F.array_join(F.transform(rows, lambda r: r[text]), " ").alias("text"), F.size(F.collect_set(page)).cast("long").alias("pages"))


def admit(calls: DataFrame, key: str, call: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Sequential admission: fewer than limit admitted calls within the seconds before.

    The state is the admitted calls of one window; a key's calls stream through in parts.
    """

    def fold(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        open_: deque[int] = deque()
        for part in parts:
            out = []
            for t in part.column("t").to_pylist():
                while open_ and open_[0] <= t - seconds * 1_000_000:
                    open_.popleft()
                out.append(len(open_) < limit)
                if out[-1]:
                    open_.append(t)
            yield pa.RecordBatch.from_arrays([part.column(call).combine_chunks(), pa.array(out, pa.bool_())], names=[call, "allowed"])

    rows = calls.select(key, call, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return fold_runs(rows, key, ["t", call], fold, f"{call} long, allowed boolean")


def longest_run(rows: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """Length of the longest non-decreasing subsequence (patience sorting); the state is its tails."""

    def fold(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        tails: list[float] = []
        for part in parts:
            name = part.column(key)[0].as_py()
            for v in part.column(value).to_pylist():
                at = bisect_right(tails, v)
                tails[at : at + 1] = [v]
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([len(tails)], pa.int32())], names=[key, "longest"])

    return fold_runs(rows.select(key, ordinal, value), key, [ordinal], fold, f"{key} long, longest int")


def in_longest_run(rows: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """key, ordinal, in_order: whether a row is on the longest non-decreasing subsequence (the one that patience sorting
    ends with; with fewer than two rows none is)."""

    def fold(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        tails: list[float] = []
        ends: list[int] = []
        before: list[int] = []
        ordinals: list[int] = []
        for part in parts:
            name = part.column(key)[0].as_py()
            ordinals += part.column(ordinal).to_pylist()
            for v in part.column(value).to_pylist():
                at = bisect_right(tails, v)
                tails[at : at + 1] = [v]
                before.append(ends[at - 1] if at else -1)
                ends[at : at + 1] = [len(before) - 1]
        on = [False] * len(before)
        i = ends[-1] if len(before) > 1 else -1
        while i >= 0:
            on[i] = True
            i = before[i]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(on), pa.int64()), pa.array(ordinals, pa.int64()), pa.array(on)], names=[key, ordinal, "in_order"])

    return fold_runs(rows.select(key, ordinal, value), key, [ordinal], fold, f"{key} long, {ordinal} long, in_order boolean")


def _inversions(values: np.ndarray) -> tuple[int, int]:
    """(rising pairs, falling pairs) of a sequence, by merging ranks from the bottom up."""
    n, rank = len(values), np.unique(values, return_inverse=True)[1]
    counts = np.bincount(rank)
    equal = int((counts * (counts - 1) // 2).sum())
    falling, size = 0, 1
    rank = rank.astype(np.int64)
    while size < n:
        block = np.arange(n) // (2 * size)
        left = (np.arange(n) // size) % 2 == 0
        keys = block * (n + 1) + rank
        for_left = np.sort(keys[left])
        right = keys[~left]
        ends = np.searchsorted(for_left, (block[~left] + 1) * (n + 1))
        falling += int((ends - np.searchsorted(for_left, right, side="right")).sum())
        size *= 2
    return n * (n - 1) // 2 - equal - falling, falling


def kendall(rows: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """Kendall tau of value against ordinal by key, in n log² n; keys with two rows or more."""

    def fold(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        held = list(parts)
        values = np.concatenate([p.column(value).to_numpy() for p in held])
        if len(values) > 1:
            up, down = _inversions(values)
            tau = round((up - down) / (up + down), 6) if up + down else None
            yield pa.RecordBatch.from_arrays([pa.array([held[0].column(key)[0].as_py()], pa.int64()), pa.array([tau], pa.float64())], names=[key, "tau"])

    return fold_runs(rows.select(key, ordinal, value), key, [ordinal], fold, f"{key} long, tau double")


def stratified(rows: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """A seeded sample with each stratum's share of size rows: the smallest hashes of each stratum."""
    w = Window.partitionBy(stratum)
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    quota = F.bround(size * F.col("n") / rows.agg(F.count("*")).scalar(), 0)
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    ranked = rows.join(counts, stratum).withColumn("k", F.row_number().over(w.orderBy(order, key)))
    return ranked.where(F.col("k") <= quota).select(key, stratum)


def claim_in_order(rows: DataFrame, key: str, ordinal: str, left: str, right: str) -> DataFrame:
    """The rows that claim both their sides, in order: each side is claimed once a key. The state is what is claimed."""

    def fold(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        lefts: set = set()
        rights: set = set()
        for part in parts:
            keep = []
            for a, b in zip(part.column(left).to_pylist(), part.column(right).to_pylist()):
                keep.append(a not in lefts and b not in rights)
                if keep[-1]:
                    lefts.add(a)
                    rights.add(b)
            yield from part.filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()

    return fold_runs(rows.select(key, ordinal, left, right), key, [ordinal], fold, f"{key} long, {ordinal} long, {left} long, {right} long")
