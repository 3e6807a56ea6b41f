"""Rounds over larger graphs: where walks end, and what goes through the driver."""

import duckdb
import pytest

from sparkloom.operators import graph as G
from sparkloom.plans import graph_queries, registry


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    """918 documents: from document 0, some are more than 60 edges away."""
    d = tmp_path_factory.mktemp("deep")
    duckdb.sql(f"COPY (SELECT i::BIGINT AS doc_id, 'word' AS text, 'en' AS lang, 's' AS source, 4::BIGINT AS n_chars FROM range(918) t(i)) TO '{d}/documents.parquet'")
    return d


@pytest.mark.parametrize("name", ["bfs_depth", "file_rollup"])
def test_deep_walks_end_where_their_sql_does(spark, deep, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{deep}/documents.parquet'")
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(tuple(r) for r in registry.queries()[name](spark, str(deep)).collect()) == sorted(want)


def test_the_sql_lists_cycles_whole(deep):
    """Eight members of a cycle are more than 60 edges from its first."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{deep}/documents.parquet'")
    sql = registry.oracle_sql()
    sizes = dict(con.execute(sql["cycles"]).fetchall())
    got = sorted(con.execute(sql["cycle_list"]).fetchall())
    assert [(scc, at) for scc, at, _ in got] == [(scc, at) for scc in sorted(sizes) for at in range(sizes[scc] + 1)]
    assert sorted((node, scc) for scc, at, node in got if at < sizes[scc]) == sorted(r for r in con.execute(sql["scc_members"]).fetchall() if r[1] in sizes)


def test_the_query_lists_cycles_whole(spark, monkeypatch):
    """A ring of 64 nodes, the last of which is 63 edges from the first."""
    ring = spark.range(64).selectExpr("id AS src", "(id + 1) % 64 AS dst")
    monkeypatch.setattr(graph_queries.B, "edges", lambda *_: ring)
    monkeypatch.setattr(G, "strong_components", lambda *_: spark.range(64).selectExpr("id", "0L AS scc"))
    assert sorted(tuple(r) for r in registry.queries()["cycle_list"](spark, "/root/testdata/sf0.001").collect()) == [*[(0, i, i) for i in range(64)], (0, 64, 0)]


def test_a_cycle_list_may_end_at_a_depth(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src long, dst long")
    sccs = G.strong_components(spark.range(6), edges)
    assert sorted(tuple(r) for r in G.cycle_list(sccs, edges, max_depth=2).collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 6, 0)]
    assert sorted(tuple(r) for r in G.cycle_list(sccs, edges).collect()) == [*[(0, i, i) for i in range(6)], (0, 6, 0)]


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    plans, write = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (4, 6), (6, 7)], "src long, dst long")
    found = G.strong_components(spark.range(9), edges)
    assert {tuple(r) for r in found.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 8)}
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_rounds_of_page_rank_broadcast_nothing(spark, monkeypatch):
    plans, write = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    found = {r["id"]: r["rank"] for r in G.pagerank(spark.range(5), edges, iterations=2).collect()}
    assert len(found) == 5 and abs(sum(found.values()) - 1) < 1e-12
    assert len(plans) == 4 and not [p for p in plans if "Broadcast" in p]


def test_rounds_of_the_closure_do_not_broadcast_the_index(spark, monkeypatch):
    from sparkloom.operators import closure as CL
    from sparkloom.sources.shared import Levels

    plans, write = [], Levels.add
    monkeypatch.setattr(Levels, "add", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df))
    files = spark.createDataFrame([("a/x.ts", 'import y from "./y"'), ("a/y.ts", 'import z from "./z"'), ("a/z.ts", ""), ("a/w.ts", "")], "path string, content string")
    found = CL.closure(files, spark.createDataFrame([("a/x.ts",)], "path string"))
    assert {(r["path"], r["round"], r["parsed"]) for r in found.collect()} == {("a/x.ts", 0, True), ("a/y.ts", 1, True), ("a/z.ts", 2, True)}
    rounds = [p for p in plans if "LeftAnti" in p]
    assert len(rounds) == 3 and not [p for p in rounds if "Broadcast" in p]


def test_a_deep_tree_is_walked_without_its_indents(spark):
    """A chain of 3,000 nodes: its lines take 9 MB, of which the walk holds no indent."""
    import pyarrow as pa

    from sparkloom.plans import render

    n = 3_000
    nodes = spark.range(n).selectExpr("id", "concat('n', id) AS label", "id = 2 AS modified")
    edges = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst", "'Call' AS rel", "'High' AS confidence")
    rows = render.dependency_tree(nodes, edges, nodes.where("id = 0")).orderBy("ord").collect()
    assert [r["depth"] for r in rows] == list(range(n + 1))
    assert rows[2]["line"] == "    - n2 [call, high] [MODIFIED]" and rows[n]["line"] == "  " * n + "- n0 [call, high] (circular)"
    one = {"ws": ["", "", ""], "root": [False, False, True], "src": ["a", "b", None], "dst": ["b", "a", "a"], "rel": ["X", "X", ""], "confidence": ["", "", ""], "label": ["b", "a", "a"], "modified": [False] * 3, "key": ["B", "A", "A"]}
    kinds = pa.schema([(c, pa.bool_() if c in ("root", "modified") else pa.string()) for c in one])
    assert render._walk(pa.table(one, schema=kinds)).column("line").to_pylist() == ["- a", "- b [x, ]", "- a [x, ] (circular)"]


def test_a_deep_tree_is_indented_in_many_tasks(spark, monkeypatch):
    """A chain of 300 nodes: 90,300 bytes of indents, of which a task adds 16,384 on the mean."""
    from pyspark.sql import functions as F

    from sparkloom.plans import render

    monkeypatch.setattr(render, "INDENTS", 1 << 14, raising=False)
    nodes = spark.range(300).selectExpr("id", "concat('n', id) AS label", "false AS modified")
    edges = spark.range(300).selectExpr("id AS src", "(id + 1) % 300 AS dst", "'Call' AS rel", "'High' AS confidence")
    out = render.dependency_tree(nodes, edges, nodes.where("id = 0"))
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert {r["task"] for r in rows} == set(range(6))
    assert [r["line"].rstrip().split("-")[0] for r in sorted(rows, key=lambda r: r["ord"])] == ["  " * i for i in range(301)]
