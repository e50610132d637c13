"""Segmented scans: running compositions of maps along an order, a hot key cut into blocks.

A step of a recurrence is a map of the state before it. Maps compose, so a key's rows are cut
into blocks that different tasks take: each block is reduced to one map, the few maps of a key
are scanned, and every block then starts from the state that the blocks before it leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_affine(scale: np.ndarray, shift: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of the maps x -> scale * x + shift up to each row, anew where ``first`` is
    set: log-many passes, each joins every row to what lies 1, 2, 4, ... rows before."""
    r, m, open_ = scale.astype(float), shift.astype(float), ~first
    step = 1
    while step < len(r) and open_.any():
        at = np.flatnonzero(open_[step:]) + step
        before = at - step
        r_new, m_new, o_new = r[at] * r[before], r[at] * m[before] + m[at], open_[before]
        r[at], m[at], open_[at] = r_new, m_new, o_new
        step *= 2
    return r, m


def affine_scan(rows: DataFrame, by: list[str], order: list[str], scale: str, shift: str) -> DataFrame:
    """``rows`` with ``scale`` and ``shift`` replaced by those of the map from the state before
    the first row of its ``by`` group to the state after the row. A group is read as a stream;
    only the last map is held between Arrow batches. No division, so long products may fade to 0."""
    names = rows.columns
    ids = F.xxhash64(*by).alias("__group")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = [table.column(c).combine_chunks() for c in ["__group", *by]]
            first = np.zeros(batch.num_rows, bool)
            first[0] = True
            for k in keys:  # a null is a value of its own
                a, b = k.slice(1), k.slice(0, len(k) - 1)
                same = pa.compute.fill_null(pa.compute.equal(a, b), False)
                both = pa.compute.and_(pa.compute.is_null(a), pa.compute.is_null(b))
                first[1:] |= ~pa.compute.or_(same, both).to_numpy(zero_copy_only=False)
            head = tuple(k[0].as_py() for k in keys)
            r, m = (table.column(c).to_numpy().astype(float) for c in (scale, shift))
            if last and last[0] == head:
                r[0], m[0] = r[0] * last[1], r[0] * last[2] + m[0]
            r, m = running_affine(r, m, first)
            last = (tuple(k[-1].as_py() for k in keys), r[-1], m[-1])
            out = [pa.array(r) if c == scale else pa.array(m) if c == shift else table.column(c).combine_chunks() for c in names]
            yield pa.RecordBatch.from_arrays(out, names)

    sorted_ = rows.select("*", ids).repartition(*by).sortWithinPartitions("__group", *by, *order)
    return sorted_.mapInArrow(task, rows.schema)


def clamped_sum(rows: DataFrame, by: list[str], block: str, order: list[str], change: str, out: str) -> DataFrame:
    """``out``: the running sum of ``change`` that never falls under 0, and ``out``_before.

    Inside a block that begins with h the sum is s + max(h, m), s the block's own running sum
    and m the running maximum of -s; both maps of a block's end compose in the same way.
    """
    key = [*by, block]
    w = Window.partitionBy(*key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("__s", F.sum(change).over(run)).withColumn("__m", F.max(-F.col("__s")).over(run))
    v = Window.partitionBy(*by).orderBy(block)
    past = v.rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(*key).agg(F.max_by("__s", F.struct(*order)).alias("s"), F.max("__m").alias("m"))
    ends = ends.withColumn("a", F.coalesce(F.sum("s").over(past), F.lit(0.0))).withColumn("__h", F.col("a") + F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("m") - F.col("a")).over(past), F.lit(0.0))))
    starts = ends.select(*key, "__h")
    x = x.join(starts, key)
    x = x.withColumn(out, F.col("__s") + F.greatest("__h", "__m"))
    return x.withColumn(f"{out}_before", F.coalesce(F.lag(out).over(w), "__h")).drop("__s", "__m", "__h")
