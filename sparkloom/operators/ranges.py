"""Places in a total order, by ranges of it, so that no task sees more than a range."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialise

#: Targets that one page of a list holds.
PAGE = 1024


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``place``: how many rows come before it in ``order``, from 0.

    Rows are dealt by ranges of ``order`` and sorted in them; the ranges are written, and their sizes, one number
    for each, are added up on the driver.  Rows that are equal in ``order`` share a range.  ``df`` is
    read twice, once for the sample of the ranges.
    """
    # The number of a row holds its range above bit 33 and its place in the range below.
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = materialise(rows)
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in table.groupBy(part.alias("part")).count().collect())
    starts = itertools.accumulate((n for _, n in sizes), initial=0)
    before = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "_part long, _before long")
    out = table.join(F.broadcast(before), part == F.col("_part"))  # a row for each range
    return out.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("place"))


def paged(pairs: DataFrame, key: str, value: str, size: int = PAGE) -> DataFrame:
    """(key, page, values): each key's values in order, at most ``size`` a page, pages from 0.

    A hub's values lie in as many pages as they need, dealt over tasks by range, so no row and no
    task holds a whole list.
    """
    at = materialise(placed(pairs.select(key, value), [F.asc(key), F.asc(value)]))
    first = at.groupBy(key).agg(F.min("place").alias("first"))
    numbered = at.join(materialise(first), key).withColumn("page", F.floor((F.col("place") - F.col("first")) / size).cast("int"))
    return numbered.groupBy(key, "page").agg(F.array_sort(F.collect_list(value)).alias("values"))
