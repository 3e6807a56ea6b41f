"""Connected components by local union-find and distributed contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix, unmix
from .store import Workspace


class UnionFind:
    """Disjoint sets over hashable items; the smallest item of a set is its root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        p = self.parent
        root = p.setdefault(x, x)
        while p[root] != root:
            root = p[root]
        while p[x] != root:
            p[x], x = root, p[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


#: Edges that one forest holds; a partition of more gives several forests.
FOREST_EDGES = 500_000


def _local_forest(batches):
    """Replace a partition's edges by stars around the roots of its own forests."""
    uf, held = UnionFind(), 0
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            uf.union(x, y)
        held += b.num_rows
        if held >= FOREST_EDGES:
            yield from _stars(uf)
            uf, held = UnionFind(), 0
    yield from _stars(uf)


def _stars(uf: UnionFind):
    pairs = [(x, r) for x in list(uf.parent) if (r := uf.find(x)) != x]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["u", "v"])


def _recoded(code, names):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(code(b.column(c).to_numpy().astype(np.uint64)).astype(np.int64)) for c in range(2)], names)

    return run


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v: long).

    ``component`` is the smallest node of the component.  Nodes are renamed by a
    bijection that mixes their bits, so that an order of names is a random one.
    Each round reduces every partition's edges to a forest, then hooks each node
    to its least neighbour and contracts: the random order makes a round remove
    a constant share of the nodes, chains included.  A round's tables are
    written to the shared folder.  No node's neighbours are collected: hubs
    only meet in ``min`` aggregates and joins.
    """
    named = edges.where("u <> v").select("u", "v").mapInArrow(_recoded(mix, ["u", "v"]), "u long, v long")
    current = ws.save(named.mapInArrow(_local_forest, "u long, v long").distinct(), "edges")
    labels = None
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = ws.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("parent")), "hook")
        if labels is None:
            labels = hook.withColumnRenamed("parent", "root")
        else:
            labels = labels.join(hook.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
            labels = ws.save(labels, "labels")
        a, b = hook.select(F.col("node").alias("u"), F.col("parent").alias("pu")), hook.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = current.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v").distinct()
        current = ws.save(moved.mapInArrow(_local_forest, "u long, v long").distinct(), "edges")
    if labels is None:
        return ws.spark.createDataFrame([], "node long, component long")
    plain = labels.select("node", "root").mapInArrow(_recoded(unmix, ["node", "root"]), "node long, root long")
    plain = ws.save(plain, "plain")
    # Written, so that the join with it holds no aggregate and a hot root's rows can be dealt anew.
    least = ws.save(plain.groupBy("root").agg(F.min("node").alias("component")), "least")
    return ws.save(plain.join(least, "root").select("node", "component"), "components")
