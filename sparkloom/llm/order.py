"""Places in a total order over all rows, without a task that sees them all."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def _numbered(weight: str | None):
    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            w = b.column(weight).to_numpy() if weight else np.ones(b.num_rows, np.int64)
            ends = before + np.cumsum(w)
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(ends - w)], [*b.schema.names, "_part", "_place"])

    return run


def placed(df: DataFrame, order: list[Column], ws: Workspace, *, weight: str | None = None) -> DataFrame:
    """``df`` with ``place``: how many rows (or how much ``weight``, a long) come before it in ``order``.

    Rows are dealt by ranges of ``order`` and counted in their range; the ranges' totals, one
    row for each partition, are added up on the driver.  The ranges are written first, so that
    a repeated task finds the same ones.  Rows that are equal in ``order`` share a range.
    ``df`` is read twice (once for the sample of the ranges): pass a written table.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _part int, _place long"
    table = ws.save(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered(weight), schema), "ranges")
    total = F.sum(F.col(weight) if weight else F.lit(1))
    sizes = sorted((r[0], r[1]) for r in table.groupBy("_part").agg(total).collect())  # a row for each partition
    starts = [0, *itertools.accumulate(n for _, n in sizes)]
    before = ws.spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "_part int, _before long")
    return table.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_place") + F.col("_before")).alias("place"))
