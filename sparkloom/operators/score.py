"""Importance of nodes from their typed incoming edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import tables
from sparkloom.functions.text import lookup


def relationship_weight(rel: Column, weights: dict[str, int] | None = None) -> Column:
    w = weights or tables.WEIGHTS
    pairs = [x for k, v in w.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), rel), F.lit(tables.DEFAULT_WEIGHT))


def confidence_factor(confidence: Column) -> Column:
    pairs = [x for k, v in tables.CONFIDENCE.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), confidence), F.lit(1.0))


def importance(depths: DataFrame, edges: DataFrame, roots: DataFrame, tests: DataFrame | None = None, weights: dict[str, int] | None = None) -> DataFrame:
    """(id, depth, importance) of every reached node.

    All incoming edges count, also those of nodes that no root reaches: weights
    times confidence, less with depth, and more for a direct edge from a root, for
    several edges and for several kinds.  Roots have 1000; nodes of ``tests`` a
    base of 30.
    """
    e = edges.dropDuplicates(["src", "dst", "rel"])
    direct = roots.select(F.col("id").alias("src"), F.lit(True).alias("from_root"))
    sums = (
        e.join(direct, "src", "left")
        .groupBy(F.col("dst").alias("id"))
        .agg(
            F.sum(relationship_weight(F.col("rel"), weights) * confidence_factor(F.col("confidence"))).alias("base"),
            F.count("*").alias("n"),
            F.countDistinct("rel").alias("kinds"),
            F.max(F.coalesce("from_root", F.lit(False))).alias("direct"),
        )
    )
    out = depths.select("id", "depth").join(sums, "id", "left")
    if tests is not None:
        out = out.join(tests.select("id", F.lit(True).alias("is_test")), "id", "left").withColumn("base", F.when(F.col("is_test"), F.lit(float(tables.TEST_SCORE))).otherwise(F.col("base")))
    bonus = lambda c, step, most: F.least(F.lit(most), F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) - 1) * step)
    score = (
        F.coalesce("base", F.lit(0.0)) * F.greatest(F.lit(0.2), F.lit(1.0) - (F.col("depth") - 1) * F.lit(0.15))
        + F.when(F.col("direct"), 25).otherwise(0)
        + bonus(F.col("n"), 10, 30)
        + bonus(F.col("kinds"), 12, 25)
    )
    return out.select("id", "depth", F.when(F.col("depth") == 0, F.lit(tables.ROOT_SCORE)).otherwise(F.bround(score, 0)).cast("long").alias("importance"))


def by_file(nodes: DataFrame) -> DataFrame:
    """(path, depth, importance): the least depth (99 where none) and the largest importance (0 where none)."""
    return nodes.groupBy("path").agg(F.coalesce(F.min("depth"), F.lit(99)).alias("depth"), F.coalesce(F.max("importance"), F.lit(0)).alias("importance"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Merge rows of one id: largest importance, least depth, first non-empty content by ``ord``, last metadata by key."""
    content = F.min_by("content", F.when(F.length("content") > 0, F.col("ord")))
    pairs = nodes.select("id", "ord", F.explode_outer("metadata").alias("k", "v")).where("k IS NOT NULL").groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    meta = pairs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return nodes.groupBy("id").agg(F.max("importance").alias("importance"), F.min("depth").alias("depth"), content.alias("content")).join(meta, "id", "left")


def append_new(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``first`` and the rows of ``second`` whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


__all__ = ["relationship_weight", "confidence_factor", "importance", "by_file", "merge_nodes", "append_new", "lookup"]
