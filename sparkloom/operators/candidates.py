"""The files that a selection chooses from: rules, depth, importance, companions, secrets and parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import filters
from sparkloom.functions import text as T

from . import score

#: Files that come with the one that uses them.
COMPANIONS = [".html", ".scss", ".css"]


def parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, parent): the other files with an edge to a file, a row for each, so a hub's are in no one row.

    ``nodes``: id, path.  ``edges``: src, dst.  Paths differ where they do ignoring case; edges from unknown nodes have no parent.
    """
    a, b = (nodes.select(F.col("id").alias(k), F.col("path").alias(p)) for k, p in (("src", "parent"), ("dst", "path")))
    named = edges.select("src", "dst").distinct().join(b, "dst").join(a, "src").where(F.upper("path") != F.upper("parent"))
    return named.groupBy("path", F.upper("parent").alias("_p")).agg(F.min("parent").alias("parent")).drop("_p")


def assemble(files: DataFrame, nodes: DataFrame, edges: DataFrame, roots: DataFrame, config: filters.FilterConfig) -> DataFrame:
    """(path, is_root, is_companion, depth, importance, reason, n_parents, secrets) of every file.

    ``files``: path, content.  ``nodes``: id, path, depth, importance (null where no root reaches one).  ``roots``: path.  A file has the least depth of
    its nodes (99 where none) and the largest importance (0 where none); a root has 0 and 1000.
    ``reason`` is the first rule that leaves it out, null for a candidate; secrets (lines with one) are counted in candidates only.
    """
    held = roots.select("path", F.lit(True).alias("is_root")).distinct()
    links = parents(nodes, edges).groupBy("path").agg(F.count("*").alias("n_parents"))
    facts = files.select("path").distinct().join(score.by_file(nodes), "path", "left").join(held, "path", "left").join(links, "path", "left")
    root = F.coalesce("is_root", F.lit(False))
    facts = facts.select(
        "path", root.alias("is_root"), F.when(root, 0).otherwise(F.coalesce("depth", F.lit(99))).cast("int").alias("depth"),
        F.when(root, 1000).otherwise(F.coalesce("importance", F.lit(0))).cast("long").alias("importance"), F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"),
    )
    reason = filters.exclusion_reason(F.col("path"), F.col("content"), F.col("is_root"), F.col("depth"), config)
    found = F.size(F.filter(F.split("content", "\r\n|\r|\n", -1), lambda line: T.secret_category(line).isNotNull())).cast("long")
    companion = filters.any_of([F.col("path").endswith(x) for x in COMPANIONS])
    rows = files.select("path", "content").join(facts, "path").withColumn("reason", reason)
    return rows.select("path", "is_root", companion.alias("is_companion"), "depth", "importance", "reason", "n_parents", F.when(F.col("reason").isNull(), F.coalesce(found, F.lit(0))).otherwise(0).cast("long").alias("secrets"))
