"""Whole groups of rows, many small ones at once, handed to workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ; nulls are equal to each other, and so are NaN."""
    if pa.types.is_nested(a.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], bool)
    out = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        out = pc.and_(out, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
    return out.to_numpy(zero_copy_only=False)


def _ends(rows: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """The rows whose keys are not those of the row before, but for the first row."""
    n, out = rows.num_rows, np.zeros(max(0, rows.num_rows - 1), bool)
    for k in keys:
        c = rows.column(k)
        out |= differing(c.slice(0, n - 1), c.slice(1))
    return np.flatnonzero(out) + 1


def whole(df: DataFrame, keys: Sequence[str], work: Callable[[pa.RecordBatch, np.ndarray], Iterable[pa.RecordBatch]], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows with the same ``keys`` lie together, sorted by ``order``, and ``work`` gets whole groups: their rows, and where each group begins, the end last.

    A call takes as many groups as end in a batch of Arrow rows, so that small
    ones cost no exchange with a worker each; of a large one no more is held
    than of a group alone. Rows that are dealt by some of ``keys`` already are
    not shuffled.
    """

    def batches_of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            return work(rows, np.r_[0, _ends(rows, keys), rows.num_rows])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(columns)
            if held and any(differing(held[-1].column(k).slice(held[-1].num_rows - 1), batch.column(k).slice(0, 1))[0] for k in keys):
                yield from done(held)
                held = []
            ends = _ends(batch, keys)
            if len(ends):  # the last group may go on in the next batch
                yield from done([*held, batch.slice(0, ends[-1])])
                held = []
            held.append(batch.slice(ends[-1] if len(ends) else 0))
        if held:
            yield from done(held)

    columns = df.columns
    # A window brings groups together and sorts them as repartition would, but shuffles only what is not dealt by keys.
    group = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("_rows", F.count(F.lit(1)).over(group)).mapInArrow(batches_of_groups, schema)
