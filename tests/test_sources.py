"""Git changes, workspace roots and the document sink."""

import subprocess
from pathlib import Path

import pytest

from sparkloom.sources import discovery, documents, git, readers


@pytest.fixture
def repo(tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.email=a@b.example", "-c", "user.name=n", *args], check=True, capture_output=True)

    (tmp_path / "r" / "src").mkdir(parents=True)
    run("init", "-q", "-b", "main")
    return tmp_path / "r", run


def put(root, **texts):
    for name, text in texts.items():
        (root / name.replace("__", "/").replace("_dot_", ".")).write_text(text)


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["path"], r["line_no"])):
        out.setdefault((r["path"], r["status"], r["untracked"]), []).append(r["line"])
    return out


def body(lines):
    return [x for x in lines if x[:1] in "+-" and x[:3] not in ("+++", "---")]


def test_a_repository_without_a_commit(spark, repo):
    root, run = repo
    put(root, a_dot_py="one\n", b_dot_py="new\n")
    run("add", "a.py")
    put(root, a_dot_py="one\ntwo\n")
    out = got(git.changes(spark, str(root / "src")))
    assert body(out["a.py", "Added", False]) == ["+one", "+two"] and body(out["b.py", "Added", True]) == ["+new"] and len(out) == 2
    with pytest.raises(Exception, match="no git repository"):
        git.changes(spark, "/").collect()


def test_all_scopes(spark, repo):
    root, run = repo
    put(root, a_dot_py="a\nb\n", gone_dot_py="x\n", src__old_dot_py="1\n2\n3\n4\n5\n")
    (root / 'q é "x".py').write_text("q\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    out = got(git.changes(spark, str(root), "last", count=3))  # fewer commits: their log
    assert {k[0] for k in out} == {"a.py", "gone.py", "src/old.py", 'q é "x".py'} and body(out["a.py", "Added", False]) == ["+a", "+b"]
    run("checkout", "-qb", "work")
    put(root, a_dot_py="a\nc\n")
    run("mv", "src/old.py", "src/new.py")
    run("rm", "-q", "gone.py")
    run("add", "-A")
    run("commit", "-qm", "two")
    want = {("a.py", "Modified", False): ["-b", "+c"], ("gone.py", "Deleted", False): ["-x"], ("src/new.py", "Renamed", False): []}
    for scope in ({"scope": "last"}, {"scope": "branch", "target": "main"}, {"scope": "branch"}):
        assert {k: body(v) for k, v in got(git.changes(spark, str(root), **scope)).items()} == want
    put(root, a_dot_py="a\nc\nd\n")
    run("add", "a.py")
    put(root, a_dot_py="a\nc\nd\ne\n", fresh_dot_py="f", note_dot_txt="n\n")
    (root / 'q é "x".py').write_text("q\nr\n")
    (root / ".gitignore").write_text("*.log\n")
    put(root, x_dot_log="")
    text = lambda scope, **kw: {k[0]: body(v) for k, v in got(git.changes(spark, str(root), scope, **kw)).items()}
    assert text("staged") == {"a.py": ["+d"]}
    assert text("unstaged") == {"a.py": ["+e"], 'q é "x".py': ["+r"]}
    assert text("all") == {"a.py": ["+d", "+e"], 'q é "x".py': ["+r"], "fresh.py": ["+f"], "note.txt": ["+n"], ".gitignore": ["+*.log"]}
    assert text("all", supported=True) == {"a.py": ["+d", "+e"], 'q é "x".py': ["+r"], "fresh.py": ["+f"]}
    assert text("single", target=str(root / "a.py")) == {"a.py": ["+d", "+e"]} and text("single", target="fresh.py") == {"fresh.py": ["+f"]}
    heads, lines = readers.git_changes(spark, str(root), "last")
    assert {r[0] for r in heads.collect()} == {"M\ta.py", "D\tgone.py", "R\tsrc/new.py"} and lines.count() > 3
    with pytest.raises(ValueError):
        git.plan(str(root), "nothing")


def test_a_branch_without_a_common_ancestor(spark, repo):
    root, run = repo
    put(root, a_dot_py="a\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("checkout", "-q", "--orphan", "other")
    put(root, a_dot_py="b\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    assert body(got(git.changes(spark, str(root), "branch", target="main"))["a.py", "Modified", False]) == ["-a", "+b"]


def test_one_process_for_each_range(repo, monkeypatch):
    root, run = repo
    for i in range(25):
        put(root, **{f"f{i:02d}_dot_py": "x\n"})
    run("add", "-A")
    reader = git.GitReader({"path": str(root), "range": "10", "scope": "staged"})
    parts = reader.partitions()
    assert [len(p.changed) for p in parts] == [10, 10, 5]
    calls = []
    plain = subprocess.run
    monkeypatch.setattr(git.subprocess, "run", lambda *a, **kw: (calls.append(a), plain(*a, **kw))[1])
    rows = [r for p in parts for r in reader.read(p)]
    assert len(calls) == 3 and [r[0] for r in rows if r[4] == "+x"] == [f"f{i:02d}.py" for i in range(25)]


# Workspace roots


def roots(spark, paths, **kw):
    rows = [(p, None) if isinstance(p, str) else p for p in paths]
    df = spark.createDataFrame(rows, "path string, content string").repartition(3)
    return {r["path"]: tuple(r)[1:] for r in discovery.workspace_roots(df, **kw).collect()}


PATHS = ["w/.git", "w/a/x.py", "w/p/package.json", "w/p/src/y.ts", "w/p/q/package.json", "w/p/q/z.ts", "v/pyproject.toml", "v/s/m.py", "u/n.py", "w/p/q/deep/App.csproj", "w/p/q/deep/k.cs", "top.py"]


def test_workspace_roots(spark):
    got = roots(spark, PATHS)
    assert got["w/a/x.py"] == ("w", None, False, 0) and got["w/p/src/y.ts"] == ("w", "w/p", False, 1) and got["w/p/q/z.ts"] == ("w", "w/p/q", True, 2)
    assert got["w/p/q/deep/k.cs"] == ("w", "w/p/q/deep", True, 2)
    assert got["v/s/m.py"] == ("v", "v", False, 0) and got["u/n.py"] == ("u", None, False, 0) and got["top.py"] == ("", None, False, 0)


def test_boundary_and_marks_of_a_monorepo(spark):
    got = roots(spark, PATHS, boundary="w/p")
    assert got["w/p/src/y.ts"] == ("w/p", "w/p", False, 1) and got["w/p/q/z.ts"] == ("w/p", "w/p/q", True, 2)
    assert "u/n.py" not in got
    more = [("m/package.json", '{"workspaces": ["a"]}'), "m/.git", "m/a/x.ts", "g/go.work", "g/a.go", "p/pnpm-workspace.yaml", "p/package.json", "p/x.ts", ("n/package.json", "{}"), "n/x.ts"]
    got = roots(spark, more)
    assert [got[p][2] for p in ("m/a/x.ts", "g/a.go", "p/x.ts", "n/x.ts")] == [True, True, True, False]
    assert roots(spark, []) == {}


# Documents


def test_documents_in_order_over_many_parts(spark, tmp_path):
    rows = [(f"w{i % 3}/x", i % 2, f"{i:05d}", f"text {i}" if i != 7 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "workspace string, part int, ord string, text string").repartition(5)
    documents.write_documents(df, str(tmp_path / "out"))
    documents.write_documents(df, str(tmp_path / "out"))  # again: all is replaced
    folders = sorted(p for p in (tmp_path / "out").iterdir())
    assert [p.name for p in folders] == ["w0%2Fx", "w1%2Fx", "w2%2Fx"]
    for k, p in enumerate(folders):
        text = "".join(f.read_text() for f in sorted(p.iterdir()))
        want = [t for w, _, _, t in sorted(rows, key=lambda r: r[:3]) if w == f"w{k}/x" and t]
        assert text == "".join(f"{t}\n\n" for t in want)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(100).select(F.lit("w").alias("workspace"), F.lit(0).alias("part"), F.col("id").alias("ord"), F.when(F.col("id") == 99, F.raise_error("no")).otherwise("x").cast("string").alias("text"))
    with pytest.raises(Exception):
        documents.write_documents(df, f"file://{tmp_path}/out")
    assert not [p for p in Path(tmp_path).rglob("*") if p.is_file()]
