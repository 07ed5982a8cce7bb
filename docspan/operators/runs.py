"""Ordered folds: one Python call a partition, whose rows arrive sorted by key and ordinal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly where it has fewer partitions than the cluster has cores (a small table in one file).

    What comes out of a shuffle is left as it is; asking for its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


Fold = Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]]


def fold_runs(rows: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """Rows of a key meet in one task in the given order; fold gets the parts of one key's rows as they stream in.

    A key's rows are never held together here, so a fold with a small state takes keys of any size.
    """
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(batches, key)
        following = next(parts, None)
        while following is not None:
            current = following[0]

            def own() -> Iterator[pa.Table]:
                nonlocal following
                while following is not None and following[0] == current:  # noqa: B023
                    yield following[1]
                    following = next(parts, None)

            mine = own()
            yield from fold(mine)
            for _ in mine:  # what the fold left unread
                pass

    return dealt.mapInArrow(_joined(per_partition), schema)


def _parts(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) of each stretch of equal keys in each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key))
        plain = np.array(values.to_pylist(), object)
        new = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
        table = pa.Table.from_batches([batch])
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows]):
            yield plain[lo], table.slice(lo, hi - lo)


def _joined(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 10_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Small batches put together."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for out in make(batches):
            held.append(out)
            n += out.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined
