"""Candidates, their parents, paths outside a workspace and views of a graph."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import filters
from sparkloom.operators import candidates
from sparkloom.sources import readers


def test_candidates(spark):
    files = spark.createDataFrame([("a.ts", "x"), ("b.css", "id AK" + "IAABCDEFGHIJKLMNOP"), ("c.spec.ts", "x"), ("d.ts", None)], "path string, content string")
    nodes = spark.createDataFrame([(1, "a.ts", 0, 1000), (2, "b.css", 1, 70), (3, "b.css", 2, 90), (4, "c.spec.ts", None, None), (5, "A.TS", 3, 5)], "id int, path string, depth int, importance int")
    edges = spark.createDataFrame([(1, 2), (5, 2), (4, 2), (2, 3), (9, 2), (5, 1), (None, 2)], "src int, dst int")
    assert {tuple(r) for r in candidates.parents(nodes, edges).collect()} == {("b.css", "A.TS"), ("b.css", "c.spec.ts")}
    got = {r["path"]: r for r in candidates.assemble(files, nodes, edges, nodes.where("id = 1"), filters.FilterConfig()).collect()}
    assert (got["a.ts"]["is_root"], got["a.ts"]["depth"], got["a.ts"]["importance"]) == (True, 0, 1000)
    assert (got["b.css"]["is_companion"], got["b.css"]["depth"], got["b.css"]["importance"], got["b.css"]["n_parents"], got["b.css"]["secrets"]) == (True, 1, 90, 2, 1)
    assert got["c.spec.ts"]["reason"] == "TestFileExcluded" and got["c.spec.ts"]["depth"] == 99
    assert len(got) == 4 and got["d.ts"]["secrets"] == 0 and got["d.ts"]["importance"] == 0
    assert candidates.assemble(files.limit(0), nodes, edges, nodes, filters.FilterConfig()).count() == 0


def test_containment(spark):
    want = {"a/b": None, "a/../b": None, "../b": "OutsideWorkspace", "a/../../b": "OutsideWorkspace", "../../a": "OutsideWorkspace", "/b": "OutsideWorkspace", "c:\\b": "OutsideWorkspace", ".Git/x": "GitInternal", "a\\.git": "GitInternal", ".git/../a": None, "": None, None: None}
    df = spark.createDataFrame([(p,) for p in want], "path string").withColumn("error", filters.containment_error(F.col("path")))
    assert {r["path"]: r["error"] for r in df.collect()} == want
    with pytest.raises(ValueError):
        readers.contained("/w/.GIT/x", "/w")


def test_views(spark):
    df = spark.createDataFrame([(1, "a/Order.ts", ["Pay"], True, "c"), (2, "b.ts", None, False, "d")], "id int, path string, symbols array<string>, god boolean, cluster string")
    see = lambda view, search: {r["id"] for r in df.where(filters.is_visible(view, search, F.col("path"), F.col("symbols"), F.col("god"), F.lit(False), F.lit(False), F.col("cluster"))).collect()}
    assert (see("all", ""), see("god", ""), see("modified", ""), see("cluster:d", ""), see("all", "PAY"), see("all", "order")) == ({1, 2}, {1}, set(), {2}, {1}, {1})
