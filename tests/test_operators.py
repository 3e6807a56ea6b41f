"""Extraction, graph, scoring, selection and diff operators on small relations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import diff as D
from sparkloom.operators import extract as X
from sparkloom.operators import graph as G
from sparkloom.operators import roots, score
from sparkloom.operators import select as SEL
from sparkloom.plans import extract_queries, render
from sparkloom.sources import readers


def files(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "path string, content string")


def pairs(df):
    return {(r["src"], r["dst"], r["rel"]) for r in df.collect()}


@pytest.mark.parametrize("tree, edge", [
    ({"a/x.ts": 'import {Y} from "./y";', "a/y.ts": ""}, ("a/x.ts", "a/y.ts", "Import")),
    ({"a/x.js": "const z = require('../b/z')", "b/z.js": ""}, ("a/x.js", "b/z.js", "Import")),
    ({"a/x.tsx": "return <Card />", "a/Card.tsx": ""}, ("a/x.tsx", "a/Card.tsx", "ComponentUsage")),
    ({"s/a.scss": "@import 'vars';", "s/_vars.scss": ""}, ("s/a.scss", "s/_vars.scss", "StyleReference")),
    ({"c.component.ts": "templateUrl: './c.component.html'", "c.component.html": ""}, ("c.component.ts", "c.component.html", "Template")),
    ({"p/a.py": "from .models import User", "p/models.py": ""}, ("p/a.py", "p/models.py", "Import")),
    ({"A.java": "import com.x.Repo;", "x/Repo.java": ""}, ("A.java", "x/Repo.java", "Import")),
    ({"src/main.rs": "mod util;", "src/util.rs": ""}, ("src/main.rs", "src/util.rs", "Import")),
    ({"A.kt": "class A : Base()", "Base.kt": ""}, ("A.kt", "Base.kt", "BaseType")),
    ({"a.php": "use App\\Model\\User;", "m/User.php": ""}, ("a.php", "m/User.php", "Import")),
    ({"a.dart": "import 'b.dart';", "b.dart": ""}, ("a.dart", "b.dart", "Import")),
    ({"k/a.cpp": '#include "a.h"', "k/a.h": ""}, ("k/a.cpp", "k/a.h", "Import")),
    ({"P.razor": "", "P.razor.cs": ""}, ("P.razor", "P.razor.cs", "CodeBehind")),
])
def test_language_rules(spark, tree, edge):
    assert edge in pairs(X.rule_edges(files(spark, tree)))


def test_declarations_and_first_kind(spark):
    tree = {"core/Hub.cs": "public class Hub { }\ninterface IHub { }", "a/Order.cs": "class Order : IHub { Hub h; void Go() { } }", "b/None.cs": "x"}
    f = files(spark, tree)
    assert ("Hub", "core/Hub.cs") in {tuple(r) for r in X.declarations(f).collect()}
    e = pairs(X.all_edges(f))
    assert ("a/Order.cs", "core/Hub.cs", "Interface") in e and not any(s == "b/None.cs" for s, _, _ in e)


def test_go_packages_are_in_the_graph(spark):
    tree = {"p/a.go": "", "p/b.go": "", "p/c.go": "", "p/c_test.go": "", "q/d.go": "", "q/e.py": ""}
    want = {(s, d, "Import") for s, d in [("p/a.go", "p/b.go"), ("p/b.go", "p/a.go"), ("p/a.go", "p/c.go"), ("p/c.go", "p/a.go")]}
    assert pairs(X.all_edges(files(spark, tree))) == want


def test_go_packages_are_in_the_graph_whole(spark):
    """Every file of a package with every other, and an importer with every file of the package, whatever its case."""
    head = 'package p\nimport (\n  "fmt"\n  "mod/Deep/Q"\n)\nimport "x/myutil"\n'
    tree = {"p/a.go": head, "p/b.go": "", "p/c.go": "", "p/c_test.go": head, "q/d.go": "", "q/e.py": "", "q/f.go": 'import "p"', "r/Q/g.go": "", "r/myutil/h.go": "", "r/myutil/i.go": "", "j.go": "", "k.go": ""}
    go = [p for p in tree if p.endswith(".go") and not p.endswith("_test.go")]
    want = {(s, d, "Import") for s in go for d in go if s != d and s.rpartition("/")[0] == d.rpartition("/")[0]}
    want |= {("p/a.go", d, "Import") for d in ("q/d.go", "q/f.go", "r/Q/g.go")} | {("p/a.go", f"r/myutil/{x}.go", "ExtensionMethod") for x in "hi"} | {("q/f.go", f"p/{x}.go", "Import") for x in "abc"}
    f = files(spark, tree)
    assert pairs(X.all_edges(f, whole_packages=True)) == want
    leads = pairs(X.go_packages(f))
    assert leads < want and len(leads) == 14


def test_the_query_links_go_files_with_their_whole_package(spark, monkeypatch):
    f = files(spark, {"p/a.go": "", "p/b.go": "", "p/c.go": ""})
    monkeypatch.setattr(extract_queries.B, "files", lambda *_: f)
    assert pairs(extract_queries.code_graph_edges(spark, "")) == {(f"p/{s}.go", f"p/{d}.go", "Import") for s in "abc" for d in "abc" if s != d}


def test_symbols(spark):
    f = files(spark, {"a.ts": "export class A {}\nfunction run(x) {}\nexport const go = (x) => x\nclass A {}"})
    t = X.declared_types(F.col("content"))
    r = f.select(t.alias("t"), "content").select("t", X.symbols(F.col("t"), X.declared_functions(F.col("content"), F.col("t"))).alias("s")).first()
    assert r["t"] == ["A"] and r["s"] == ["A", "run()", "go()"]


def test_python_parser(spark):
    f = files(spark, {"a.py": "import os\nclass A:\n    def m(self): pass\ndef f(): eval('1')", "b.py": "def (", "c.py": None, "d.ts": "x"})
    got = {(r["path"], r["kind"], r["name"]) for r in X.python_symbols(f).collect()}
    assert {("a.py", "class", "A"), ("a.py", "method", "m"), ("a.py", "function", "f"), ("a.py", "import", "os"), ("a.py", "dynamic", "eval"), ("b.py", "error", None)} == got


def graph(spark, edges, n):
    e = spark.createDataFrame([(a, b, "Import", "High", i) for i, (a, b) in enumerate(edges)] or [(0, 0, "x", "x", 0)], "src long, dst long, rel string, confidence string, ord int")
    return e, spark.range(n).select("id")


def test_graph_against_brute_force(spark):
    rng = random.Random(5)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(22)]
    e, nodes = graph(spark, edges, n)
    adj = {i: {b for a, b in edges if a == i and b != i} for i in range(n)}
    depth = {0: 0}
    todo = [0]
    for x in todo:
        for y in sorted(adj[x] - set(depth)):
            depth[y] = depth[x] + 1
            todo.append(y)
    got = {r["id"]: r["depth"] for r in G.bfs(e, nodes.where("id = 0"), nodes).collect()}
    assert got == depth
    reach = {i: set() for i in range(n)}
    for i in range(n):
        stack = [i]
        while stack:
            for y in adj[stack.pop()] - reach[i]:
                reach[i].add(y)
                stack.append(y)
    want = {i: min([i, *[j for j in reach[i] if i in reach[j]]]) for i in range(n)}
    assert {r["id"]: r["scc"] for r in G.strong_components(nodes, e).collect()} == want
    ranks = {r["id"]: r["rank"] for r in G.pagerank(nodes, e, iterations=4).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9


def test_focus_leaves_out_callers_of_dependencies(spark):
    e, nodes = graph(spark, [(1, 2), (3, 2), (0, 1), (4, 0)], 5)
    assert {r["id"] for r in G.focus(e, nodes.where("id = 1")).collect()} == {0, 1, 2, 4}


def test_importance_by_hand(spark):
    e = spark.createDataFrame([(0, 1, "ConstructorDependency", "Verified"), (1, 2, "MethodCall", "High")], "src long, dst long, rel string, confidence string")
    depths = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id long, depth int")
    got = {r["id"]: r["importance"] for r in score.importance(depths, e, depths.where("id = 0")).collect()}
    assert got == {0: 1000, 1: 157, 2: 60}


def test_greedy_budget(spark):
    rows = [("w", "r", True, False, 0, 0, 50, []), ("w", "a", False, False, 1, 9, 30, ["r"]), ("w", "b", False, False, 1, 8, 500, ["r"]), ("w", "c", False, False, 2, 1, 10, ["b"]), ("w", "d", False, False, 2, 1, 10, ["a"]), ("v", "q", True, False, 0, 0, 900, [])]
    c = spark.createDataFrame(rows, "workspace string, path string, is_root boolean, is_companion boolean, depth int, importance int, tokens long, parents array<string>")
    got = SEL.greedy(c, 600)
    assert {r["path"]: r["included"] for r in got.collect()} == {"r": True, "a": True, "b": False, "c": False, "d": True, "q": True}
    s = {r["workspace"]: (r["final_tokens"], r["budget_met"], r["root_alone"]) for r in SEL.summary(got, 600).collect()}
    assert s == {"w": (590, True, False), "v": (1400, True, True)}


def test_greedy_budget_over_rounds(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("w", f"f{i:03d}", i == 0, False, rng.randrange(4), rng.randrange(50), rng.randrange(1, 60), [] if i % 3 else [f"f{rng.randrange(60):03d}"]) for i in range(60)]
    c = spark.createDataFrame(rows, "workspace string, path string, is_root boolean, is_companion boolean, depth int, importance int, tokens long, parents array<string>")
    acc, inc = rows[0][6], {"f000"}
    for r in sorted(rows[1:], key=lambda r: (r[4], -r[5], r[1])):
        if (not r[7] or inc & set(r[7])) and acc + r[6] <= 400:
            acc, inc = acc + r[6], inc | {r[1]}
    monkeypatch.setattr(SEL, "ROUND", 7)
    assert {r["path"] for r in SEL.greedy(c, 900).where("included").collect()} == inc


def changes(spark, rows):
    return spark.createDataFrame(rows, "grp string, path string, status string, n_added int, fixes int, insertions int, deletions int, added array<string>, modified array<string>, removed array<string>")


def test_draft_tells_every_file(spark):
    rows = [("g", f"src/f{i:02d}.cs", "Modified", 0, 0, i, 1, [], [], []) for i in range(40)]
    rows += [("g", "src/new.cs", "Added", 5, 0, 3, 0, list("abcde"), ["m"], list("wxyz")), ("g", "x/moved.cs", "Renamed", 0, 0, 0, 0, [], [], [])]
    got = {r["path"]: r["bullet"] for r in D.draft(changes(spark, rows), "en", "grp").collect()}
    assert len(got) == 42 and got["src/f07.cs"] == "- Update src/f07.cs (+7/-1)" and got["x/moved.cs"] == "- Rename x/moved.cs"
    assert got["src/new.cs"] == "- Add new.cs: add a, b, c, d; update m; remove w, x, y (+3/-0)"


def test_subjects(spark):
    cases = [
        ([("Added", "a.cs", ["A", "B", "C"], [])], "add a.cs (A, B)"), ([("Added", "a.cs", [], [])], "add a.cs"), ([("Deleted", "a.cs", ["A"], [])], "remove a.cs"),
        ([("Modified", "a.cs", ["A"], ["M"])], "add A in a.cs"), ([("Modified", "a.cs", [], ["M", "N", "O"])], "update M, N in a.cs"), ([("Renamed", "a.cs", [], [])], "update a.cs"),
        ([("Added", "a.cs", [], []), ("Added", "b.cs", [], []), ("Added", "c.cs", [], []), ("Modified", "d.cs", [], []), ("Deleted", "e.cs", [], [])], "add a, b and update d"),
        ([("Modified", "a.cs", ["S"], []), ("Deleted", "b.cs", [], [])], "add S and update a"), ([("Renamed", "a.cs", [], ["M"]), ("Deleted", "b.cs", [], [])], "update M and remove b"),
        ([("Renamed", "a.cs", [], []), ("Renamed", "b.cs", [], [])], "update 2 files"),
    ]
    made = changes(spark, [(str(k), p, st, len(a), 0, 1, 1, a, m, []) for k, (rows, _) in enumerate(cases) for st, p, a, m in rows])
    got = {r["grp"]: r["subject"].split(": ", 1)[1] for r in D.subjects(made, "en", "grp").collect()}
    assert got == {str(k): action for k, (_, action) in enumerate(cases)}



def test_diff_sets_and_message(spark):
    lines = ["diff --git a b", "@@ -1,2 +1,3 @@ class Old", "+class New {", "-class Gone {", "+function same(a)", "-function same()", "+ if (x == null) fix", " keep"]
    d = spark.createDataFrame([("shipping/LabelMaker.cs", "Modified", i, x) for i, x in enumerate(lines)], "path string, status string, line_no int, line string")
    s = D.symbol_sets(d).first()
    assert (s["added"], s["modified"], s["removed"]) == (["New"], ["Old", "same"], ["Gone"])
    st = D.stats(d).first()
    assert (st["insertions"], st["deletions"], st["fixes"]) == (3, 2, 1)
    ch = D.summaries(d).withColumn("g", F.lit(1))
    both = ch.first()
    assert (both["added"], both["modified"], both["removed"], both["n_added"]) == (["New"], ["Old", "same"], ["Gone"], 1)
    assert (both["insertions"], both["deletions"], both["fixes"]) == (3, 2, 1)
    assert D.subjects(ch, "en", "g").first()["subject"] == "feat(labelmaker): add New in LabelMaker.cs"
    assert D.draft(ch, "de", "g").first()["bullet"] == "- Aktualisieren LabelMaker.cs: hinzufügen New; aktualisieren Old, same; entfernen Gone (+3/-2)"


def test_lines_are_parsed_once_for_a_subject(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lines = [("a/x.cs", "Added", "+class New {"), ("a/x.cs", "Added", "+  publicclass Odd"), ("a/y.cs", "Modified", "-\tconst f = (a) => a"), ("a/y.cs", "Modified", "+prose, class by class")]
    d = spark.createDataFrame(lines, "path string, status string, line string")
    ch = D.summaries(d.mapInArrow(counted, d.schema)).withColumn("g", F.lit(1))
    assert [r["subject"] for r in D.subjects(ch, "en", "g").collect()] == ["feat(a): add x and update y"]
    assert {(r["path"], *r["added"], *r["removed"]) for r in ch.collect()} == {("a/x.cs", "New", "Odd"), ("a/y.cs", "f")}
    assert seen.value == len(lines)


def test_tree_marks(spark):
    e, _ = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 0)], 3)
    nodes = spark.createDataFrame([(0, "A", False), (1, "B", True), (2, "C", False)], "id long, label string, modified boolean")
    text = [r["line"] for r in render.dependency_tree(nodes, e, nodes.where("id = 0")).orderBy("ord").collect()]
    assert text == ["- A", "  - B [import, high] [MODIFIED]", "    - C [import, high]", "      - A [import, high] (circular)", "  - C [import, high] (already shown)"]


def test_workspace_reader(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1", "node_modules/b.js": "", "tests/c.py": "y", "d.png": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    f = readers.workspace(spark, str(tmp_path))
    assert {r["path"] for r in f.collect()} == {"src/a.py", "tests/c.py", "d.png"}
    assert {r["path"] for r in readers.graph_files(f).collect()} == {"src/a.py"}
    assert {r["path"] for r in readers.graph_files(f.where("path = 'tests/c.py'")).collect()} == {"tests/c.py"}
    with pytest.raises(ValueError):
        readers.contained(str(tmp_path / "../x"), str(tmp_path))


def test_discover(spark):
    p = spark.createDataFrame([("r/.git",), ("r/p/package.json",), ("r/p/a.ts",), ("q/go.mod",), ("q/a.go",), ("z.txt",)], "path string")
    got = {r["path"]: (r["root"], r["kind"]) for r in readers.discover(p).collect()}
    assert got["r/p/a.ts"] == ("r", "repository") and got["q/a.go"] == ("q", "project") and got["z.txt"] == (None, None)


def test_stream(spark, tmp_path):
    from sparkloom.streaming import files as stream

    src = str(tmp_path / "in")
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    spark.sql(f"SELECT 'a.py' AS path, 'x {key} y' AS content, timestamp'2026-01-01 00:00:00' AS seen").write.parquet(src)
    q = stream.secret_alerts(stream.read(spark, src)).writeStream.format("memory").queryName("alerts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("alerts").collect()] == [("a.py", 1, "AWS Access Key")]


def test_registry_without_session_names():
    from sparkloom.plans import registry

    names = registry.queries()
    assert "god_nodes" in names and set(registry.oracle_sql()) <= set(names)
    assert all(a != b for a, b in itertools.combinations(names, 2))


def edge_set(df):
    return {(r["src"], r["dst"], r["rel"]) for r in df.collect()}


def test_lists_of_names_lose_none(spark):
    files = [
        ("w/A.ts", "class A implements B, C {}\nstyleUrls: ['./a.css', './b.scss']\n@Use({ x: Dd })"), ("w/B.ts", ""), ("w/C.ts", ""), ("w/Dd.ts", ""), ("w/a.css", ""), ("w/b.scss", ""),
        ("p/m.py", "from . import x\nclass K(base.Thing, LogMixin):\n    pass"), ("p/__init__.py", ""), ("p/base/Thing.py", ""), ("p/LogMixin.py", ""), ("p/extras.py", ""), ("p/n.py", "import extras"),
        ("r/lib.rs", "mod deep;\n#[derive(Clone, Shape)]\nstruct S;"), ("r/deep/mod.rs", ""), ("r/shape.rs", ""),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    assert edge_set(X.rule_edges(df)) == {
        ("w/A.ts", "w/B.ts", "Interface"), ("w/A.ts", "w/C.ts", "Interface"), ("w/A.ts", "w/a.css", "Style"), ("w/A.ts", "w/b.scss", "Style"), ("w/A.ts", "w/Dd.ts", "Decorator"),
        ("p/m.py", "p/__init__.py", "Import"), ("p/m.py", "p/base/Thing.py", "BaseType"), ("p/m.py", "p/LogMixin.py", "ExtensionMethod"), ("p/n.py", "p/extras.py", "ExtensionMethod"),
        ("r/lib.rs", "r/deep/mod.rs", "Import"), ("r/lib.rs", "r/shape.rs", "Attribute"),
    }
    assert X.rule_edges(df.limit(0)).count() == 0


def test_indexes_of_implementations_handlers_and_prototypes(spark):
    files = [
        ("c/IRepo.cs", "public interface IRepo { }"), ("c/Repo.cs", "public class Repo : IRepo { }"), ("c/Use.cs", "class Use { Use(IRepo r) { Send(new Paid()); } }"),
        ("c/Paid.cs", "class Paid { }"), ("c/PaidHandler.cs", "class PaidHandler : INotificationHandler<Paid> { }"),
        ("c/Marked.cs", "[Map(typeof(Paid))]\nclass Marked { }"),
        ("w/text.extensions.ts", "String.prototype.shout = f\ndeclare global { interface X { calm(a): string } }"), ("w/a.ts", "s.shout()"), ("w/b.ts", "s.calm(1)"), ("w/c.ts", "s.other()"),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    assert edge_set(X.implementations(df)) == {("c/IRepo.cs", "c/Repo.cs", "Implementation"), ("c/Use.cs", "c/Repo.cs", "Implementation"), ("c/Use.cs", "c/PaidHandler.cs", "EventType"), ("c/Paid.cs", "c/PaidHandler.cs", "EventType"), ("c/Marked.cs", "c/PaidHandler.cs", "EventType")}
    assert edge_set(X.prototype_edges(df)) == {("w/a.ts", "w/text.extensions.ts", "ExtensionMethod"), ("w/b.ts", "w/text.extensions.ts", "ExtensionMethod")}
    assert ("c/Marked.cs", "c/Paid.cs", "Attribute") in edge_set(X.rule_edges(df))
    all_ = X.all_edges(df)
    assert all_.groupBy("src", "dst").count().where("count > 1").count() == 0 and ("c/Use.cs", "c/Repo.cs", "Implementation") in edge_set(all_)


def test_tree_of_any_depth_against_recursion(spark):
    rng = random.Random(5)
    n = 40
    links = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(70)} | {(i, i + 1) for i in range(20)})
    nodes = spark.createDataFrame([(i, f"n{i:02d}", i % 7 == 0) for i in range(n)], "id long, label string, modified boolean")
    e = spark.createDataFrame([(a, b, "Import", "High") for a, b in links], "src long, dst long, rel string, confidence string")
    want, shown = [], set()

    def open_(node, depth, path):
        for _, b in [x for x in links if x[0] == node]:
            mark = " (circular)" if b in path else " (already shown)" if b in shown else ""
            want.append("  " * depth + f"- n{b:02d} [import, high]" + (" [MODIFIED]" if b % 7 == 0 else "") + mark)
            if not mark:
                shown.add(b)
                open_(b, depth + 1, [*path, b])

    for root in (0, 3):
        want.append(f"- n{root:02d}" + (" [MODIFIED]" if root % 7 == 0 else ""))
        shown.add(root)
        open_(root, 1, [root])
    got = render.dependency_tree(nodes, e, nodes.where("id IN (0, 3)")).orderBy("ord").collect()
    assert [r["line"] for r in got] == want and max(r["depth"] for r in got) > 10
    ws = lambda df: df.withColumn("ws", F.lit("a")).unionByName(df.withColumn("ws", F.lit("b")))
    both = render.dependency_tree(ws(nodes), ws(e), ws(nodes.where("id IN (0, 3)")), "ws").orderBy("workspace", "ord").collect()
    assert [r["line"] for r in both] == want * 2


def test_roots(spark):
    nodes = spark.createDataFrame(
        [("a/order_svc.ts", "t1", "Class", "Other", 0), ("a/order_svc.ts", "t2", "Class", "OrderSvc", 1), ("a/two.ts", "t3", "Class", "X", 0), ("a/two.ts", "t4", "Function", "Y", 1), ("a/p.razor", "t5", "Class", "P", 0), ("a/t.ts", "t6", "Type", "T", 0)],
        "path string, id string, kind string, name string, ord int",
    )
    files = spark.createDataFrame([(p,) for p in ("a/order_svc.ts", "a/two.ts", "a/p.razor", "a/t.ts", "a/none.md")], "path string")
    got = {r["path"]: r for r in roots.resolve_roots(files, nodes).collect()}
    assert got["a/order_svc.ts"]["root_id"] == "t2" and got["a/p.razor"]["root_id"] == "file:a/p.razor" and got["a/none.md"]["root_id"] == "file:a/none.md" and got["a/t.ts"]["candidates"] == 0
    assert got["a/two.ts"]["multi"] and got["a/two.ts"]["root_id"] == "file:a/two.ts"
    assert {r["id"] for r in roots.root_nodes(roots.resolve_roots(files, nodes), nodes).where("path = 'a/two.ts'").collect()} == {"file:a/two.ts", "t3", "t4"}
    asked = {r["path"]: r for r in roots.resolve_roots(files, nodes, " Y ").collect()}
    assert asked["a/two.ts"]["root_id"] == "t4" and asked["a/t.ts"]["error"] == "RootSymbolNotFound" and asked["a/t.ts"]["root_id"] is None
