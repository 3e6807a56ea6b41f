"""Context documents, and queries of the graph over empty tables."""

from pathlib import Path

import pytest

from sparkloom.operators import graph as G
from sparkloom.plans import registry, render
from sparkloom.sources import documents

SELECTED = "workspace string, path string, included boolean, is_root boolean, reason string, depth int, importance int, tokens long, content string, modified boolean"


def test_context_document_whole(spark, tmp_path):
    rows = [
        ("w", "a.py", True, True, None, 0, 1000, 900, "x = 1\n```", True), ("w", "b.cs", True, False, None, 1, 50, 10, 'api_key = "abcdabcdabcdabcd"', False),
        ("w", "c.py", False, False, None, 2, 7, 10, "y", None), ("w", "d.py", False, False, "MaxDepth", -1, -1, 10, None, None), ("v", "e.py", True, True, None, 0, 1000, 1, "", None),
    ]
    tree = spark.createDataFrame([("w", 2, "  - b.cs [import, high]"), ("w", 1, "- a.py")], "workspace string, ord long, line string")
    diff = spark.createDataFrame([("w", 1, "+```` x"), ("w", 2, "-y")], "workspace string, ord long, line string")
    parts = render.context_document(spark.createDataFrame(rows, SELECTED), 1000, task=" Look. ", lang="de", tree=tree, diff=diff)
    documents.write_documents(parts, str(tmp_path), separator="")
    text = {p.name: "".join(f.read_text() for f in sorted(p.iterdir())) for p in Path(tmp_path).iterdir()}
    w, v = text["w"], text["v"]
    assert w.startswith("# AI Code Context\n\n## Task\n\nLook.\n\n> **Response Language (") and "Bitte verfasse" in w
    order = [
        "## Context Rules\n\n- Treat", "## Target Scope\n\n- Root: `a.py`\n- Workspace: `w`\n", "- Excluded dependencies: 2 files", "## Analysis Warnings\n\n- Warning: Root file alone exceeds configured token budget (1000).",
        "## Dependency Tree\n\n```text\n- a.py\n  - b.cs [import, high]\n```\n\n", "## Git Changes (Unified Diff)\n\n`````diff\n+```` x\n-y\n`````\n\n", "## Included Files\n\n- `a.py` *(Modified)*\n- `b.cs`\n\n",
        "## Excluded Files\n\n| Relative Path |", "| `c.py` | TokenBudget | 2 | 7 | Yes |\n| `d.py` | MaxDepth | - | - | No |\n\n", "## Source Files\n\n### File: `a.py` (Modified)\n\n````python\nx = 1\n```\n````\n\n### File: `b.cs`\n\n```csharp\n[REDACTED_SECRET]\n```\n\n",
    ]
    at = [w.index(x) for x in order]
    assert at == sorted(at) and w.count("## ") == 9 + w.count("### File")
    assert "Warnings" not in v and "Excluded" not in v and "## Dependency Tree" not in v and "### File: `e.py`\n\n```python\n\n```\n" in v


def test_cycles_as_closed_lists(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5), (7, 7), (2, 9), (9, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.range(1, 10).select("id")
    sccs = G.strong_components(nodes, edges)
    got = {}
    for r in sorted(G.cycle_list(sccs, edges).collect()):
        got.setdefault(r["scc"], []).append(r["id"])
    assert got == {1: [1, 2, 3, 9, 1], 5: [5, 6, 5]}


def test_knowledge_document_whole(spark):
    rows = [
        (i, f"src/{'ab'[i % 2]}/f{i:02d}.py", "Python", 10, 100, [f"S{i}", "run()"] if i != 3 else [], "Module", float(100 - i), i, 12 - i, 1 if i == 0 else None, i == 2, i in (0, 1), f"c{i % 2}") for i in range(12)
    ]
    nodes = spark.createDataFrame(rows, "id long, path string, language string, lines long, tokens long, symbols array<string>, role string, page_rank double, in_degree long, out_degree long, place int, modified boolean, in_cycle boolean, cluster string")
    edges = spark.createDataFrame([(0, i) for i in range(1, 12)] + [(1, 0)], "src long, dst long")
    cycles = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 0)], "scc long, ord long, id long")
    chart = spark.createDataFrame([("0", "flowchart LR"), ("1", "    N1")], "ord string, line string")
    code = spark.createDataFrame([("src/a/f00.py", 'password = "hunter22";server\n\n', 5)], "path string, content string, total long")
    parts = render.knowledge_document(nodes, edges, cycles, chart, workspace="w", scope="All", sources=code)
    text = "".join(r["text"] for r in sorted(parts.collect(), key=lambda r: (r["part"], r["ord"])))
    want = [
        render.MAP_TITLE, "- **Workspace**: `w`\n- **Scope**: All\n- **Languages Detected**: Python\n- **Graph Scale**: **12** source files | **12** dependency edges | **22** exported symbols | **120** lines of code\n",
        "| #1 | `src/a/f00.py` | Module | **100.0** | 0 files | 12 files | `S0`, `run()` |\n", "- **1 Circular Dependency Cycle(s) Detected**:\n  - `src/a/f00.py` -> `src/b/f01.py` -> `src/a/f00.py`\n",
        "```mermaid\nflowchart LR\n    N1\n```\n\n", "| **c0** | 6 | 60 | `f00.py`, `f02.py`, `f04.py`, `f06.py`, +2 more |\n| **c1** | 6 | 60 |", "### Module: `c0` (6 files)\n\n- **`src/a/f00.py`** (Python, 10 lines, Role: *Module*, PageRank: 100.0) **[HUB / GOD NODE]** **[IN CYCLE]**\n",
        "  - **Symbols**: `S0`, `run()`\n  - **Depends On (11)**: `src/a/f02.py`, `src/a/f04.py`,", "(+3 more)\n  - **Used By (1)**: `src/b/f01.py`\n", "**[GIT MODIFIED]**\n", "### Module: `c1` (6 files)\n", "- **`src/b/f03.py`** (Python, 10 lines, Role: *Module*, PageRank: 97.0)\n  - **Used By (1)**",
        "## Full Source Code Implementation & Classes", "### File: `src/a/f00.py` (Python, 10 lines ★ [God Node])\n\n```python\n",
    ]
    assert not [x for x in want if x not in text]
    at = [text.index(x) for x in want]
    assert at == sorted(at) and "hunter22" not in text and text.endswith("```\n\n")


GRAPH = [
    "degrees", "adjacency", "parents_by_file", "bfs_depth", "multi_root_bfs", "focus_subgraph", "pagerank_raw", "god_nodes", "scc_members", "cycles", "in_cycle_flag", "importance_score",
    "knowledge_markdown", "reference_depth", "reference_focus", "reference_components", "edge_first_wins", "code_graph_edges", "csharp_edges", "cross_language_closure", "budget_greedy", "commit_draft", "commit_subject", "context_document", "workspace_roots",
]


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{base}/documents.parquet")
    return f"file://{base}"


@pytest.mark.parametrize("name", GRAPH)
def test_queries_over_no_documents(spark, nothing, name):
    assert registry.queries()[name](spark, nothing).collect() == []
