"""Factorised references, adapters, closure, C# facts and the kept index."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import adapters as A
from sparkloom.operators import closure as CL
from sparkloom.operators import csharp as CS
from sparkloom.operators import extract as X
from sparkloom.operators import factors as FA
from sparkloom.operators import graph as G
from sparkloom.operators import ranges as R
from sparkloom.operators.kept import KeptIndex
from sparkloom.operators.languages import Rule


def files(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "path string, content string")


def triples(df):
    return {(r["src"], r["dst"], r["rel"]) for r in df.collect()}


def random_files(rng, n, names):
    tree = {}
    for i in range(n):
        used = " ".join(f"Name{rng.randrange(names)}" for _ in range(3))
        tree[f"d{i % 3}/F{i}x.cs"] = f"class Name{rng.randrange(names)} : IName{rng.randrange(names)} {{ }}\n{used}"
    return tree


def test_walks_over_factors_equal_those_over_pairs(spark):
    tree = random_files(random.Random(4), 40, 25) | {"d0/null.cs": None, "d0/empty.cs": ""}
    fs = files(spark, tree)
    f = FA.factors(fs)
    pairs = FA.expand(f).cache()
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in X.references(fs, X.declarations(fs)).distinct().collect()}
    root = spark.createDataFrame([("d0/F0x.cs",)], "id string")
    some = spark.createDataFrame([("d0/F0x.cs",)], "path string")
    assert triples(FA.expand(f, some)) == triples(pairs.where("src = 'd0/F0x.cs'"))
    nodes = fs.select(F.col("path").alias("id"))
    assert {tuple(r) for r in FA.bfs(f, root).collect()} == {tuple(r) for r in G.bfs(pairs, root, nodes).collect()}
    assert {tuple(r) for r in FA.bfs(f, root, max_depth=1).collect()} == {tuple(r) for r in G.bfs(pairs, root, nodes, max_depth=1).collect()}
    assert {r[0] for r in FA.focus(f, root).collect()} == {r[0] for r in G.focus(pairs, root).collect()}
    assert {tuple(r) for r in FA.strong_components(fs, f).collect()} == {tuple(r) for r in G.strong_components(nodes, pairs).collect()}


def test_factors_grow_with_the_files_and_not_with_their_pairs(spark):
    count = {}
    for n in (50, 500):
        f = FA.factors(files(spark, random_files(random.Random(1), n, 10)))
        count[n] = f.uses.count() + f.decl.count()
    assert count[500] <= 12 * count[50]


def test_empty_tables(spark):
    none = files(spark, {"a": "b"}).limit(0)
    f = FA.factors(none)
    ids = none.select(F.col("path").alias("id"))
    assert FA.bfs(f, ids).collect() == [] and FA.focus(f, ids).collect() == [] and FA.strong_components(none, f).collect() == []
    assert CS.edges(none).collect() == [] and A.Adapters().edges(none).collect() == []
    assert CL.closure(none, none.select("path")).collect() == []
    assert G.strong_components(ids, none.select(F.col("path").alias("src"), F.col("path").alias("dst"))).collect() == []


# Adapters and closure


def test_the_adapter_registered_last_is_asked_first(spark):
    tree = {"a.py": "import b", "b.py": "", "c.kt": "link a.py\nimport x.D", "D.kt": "", "e.zzz": "link a.py", "n.kt": None}

    class Words:  # local, so that it travels by value
        def eval(self, path, content):
            for word in (content or "").split()[1:]:
                yield word, "Linked", "path", []

    table = A.adapter_function(Words)
    reg = A.Adapters()
    assert triples(reg.edges(files(spark, tree))) == {("a.py", "b.py", "Import"), ("c.kt", "D.kt", "Import")}
    reg.register(A.Adapter("words", (".kt", ".zzz"), table=table))
    chosen = {r["path"]: r["a"] for r in files(spark, tree).select("path", reg.chosen(F.col("path")).alias("a")).collect()}
    assert chosen == {"a.py": "python", "b.py": "python", "c.kt": "words", "D.kt": "words", "e.zzz": "words", "n.kt": "words"}
    assert triples(reg.edges(files(spark, tree))) == {("a.py", "b.py", "Import"), ("c.kt", "a.py", "Linked"), ("e.zzz", "a.py", "Linked")}
    reg.register(A.Adapter("own", (".kt",), rules=(Rule((".kt",), "Own", r"link (\S+)", how="path"),)))
    assert ("c.kt", "a.py", "Own") in triples(reg.edges(files(spark, tree)))
    assert A.Adapter("by-language", (), ("Kotlin",)) and reg.register(A.Adapter("by-language", (), ("Kotlin",))).items[0].id == "by-language"
    assert {r[0] for r in files(spark, tree).where("path LIKE '%.kt'").select(reg.chosen(F.col("path"))).collect()} == {"by-language"}


def test_closure_reads_each_text_once(spark):
    see = Rule((".py", ".rs", ".ts", ".go"), "Link", r"(?m)^@see (\S+)$", how="path")
    reg = A.with_rules(A.Adapters(), see)
    tree = {
        "a.py": "import b\n@see x.rs", "b.py": "import a", "x.rs": "mod y;\n@see late.py", "y.rs": "@see w.ts", "w.ts": "@see b.py\n@see x.rs",
        "late.py": "import never", "never.py": "", "alone.go": "@see a.py", "z.py": None,
    }
    roots = spark.createDataFrame([("a.py",), ("missing.py",)], "path string")
    shelves = CL.Shelves(files(spark, tree), shelves=4)
    got = {r["path"]: (r["language"], r["parsed"]) for r in CL.closure(shelves, roots, reg).collect()}
    assert got == {"a.py": ("Python", True), "b.py": ("Python", True), "x.rs": ("Rust", True), "y.rs": ("Rust", True), "w.ts": ("TypeScript", True), "late.py": ("Python", False)}
    every = CL.closure(shelves, roots, reg, every=True)
    assert {r["path"] for r in every.where("parsed").collect()} == {*got, "never.py"} and every.count() == 7


def test_closure_reads_no_other_shelf_and_no_text_twice(spark, monkeypatch):
    tree = {f"m{i}.py": f"import m{i + 1}" for i in range(12)} | {f"o{i}.py": "import m0" for i in range(30)}
    shelves = CL.Shelves(files(spark, tree), shelves=8)
    read = []
    texts = CL.Shelves.texts
    monkeypatch.setattr(CL.Shelves, "texts", lambda self, paths: (read.extend(r[0] for r in texts(self, paths).select("path").collect()), texts(self, paths))[1])
    CL.closure(shelves, spark.createDataFrame([("m0.py",)], "path string")).collect()
    assert sorted(read) == sorted(f"m{i}.py" for i in range(12))


# C#


def edges(spark, tree, **switches):
    return triples(CS.edges(files(spark, tree), **switches))


def kinds(spark, tree, src, dst, **switches):
    return {r for s, d, r in edges(spark, tree, **switches) if (s, d) == (src, dst)}


def test_service_with_an_interface_and_a_repository(spark):
    tree = {
        "Svc.cs": "namespace A;\n// handles Ghost\npublic class Svc : ISvc\n{\n  private readonly Repo _r;\n  /* new Ghost() */\n  public Svc(Repo r) { _r = r; }\n  public Task<Model?> Get(int id) { var m = _r.Find(id); return Task.FromResult<Model?>(m); }\n}",
        "ISvc.cs": "public interface ISvc { Task<Model?> Get(int id); }", "Repo.cs": 'public class Repo { public Model Find(int id) => new Model(id, "Ghost"); }',
        "Model.cs": "public record Model(int Id, string Name);", "Ghost.cs": "public class Ghost {}",
    }
    assert kinds(spark, tree, "Svc.cs", "ISvc.cs", safety_net=False) == {"Interface"}
    assert kinds(spark, tree, "Svc.cs", "Repo.cs", safety_net=False) == {"FieldType", "LocalType", "ConstructorDependency"}
    assert kinds(spark, tree, "Svc.cs", "Model.cs", safety_net=False) == {"GenericArgument"}
    assert kinds(spark, tree, "Repo.cs", "Model.cs", safety_net=False) == {"ReturnType", "ObjectCreation"}
    assert not any(d == "Ghost.cs" for _, d, _ in edges(spark, tree))


def test_constants_and_conditional_access(spark):
    tree = {
        "H.cs": "class H { bool Ok(Opt o) { if (o.Name == Common.Fan_Name) { return Other?.X == 1; } return false; } }\nclass Opt { public string Name { get; set; } = string.Empty; }",
        "Common.cs": 'public interface Common { public const string Fan_Name = "Any"; }', "Other.cs": "static class Other { }", "Name.cs": "class Name { }",
    }
    assert kinds(spark, tree, "H.cs", "Common.cs") == {"FieldType"} and kinds(spark, tree, "H.cs", "Other.cs") == {"FieldType"}
    assert kinds(spark, tree, "H.cs", "Name.cs") == set()


def test_extension_methods_attributes_handlers_and_implementations(spark):
    tree = {
        "Report.cs": "public class Report { public string Make(Customer c) { var s = c.ToSummary(); return c?.IsVip() == true ? s : null; } }",
        "Customer.cs": "public class Customer { }",
        "Ext.cs": "public static class Ext { public static string ToSummary(this Customer c) { return null; } public static string Plain(Customer c) => null; }",
        "Page.cs": "[Filter(typeof(Audit))]\npublic class Page { [Route] public void Go() { } private readonly IStore _s; public Page(IStore s) { _s = s; } }",
        "FilterAttribute.cs": "class FilterAttribute : Attribute { }", "Audit.cs": "class Audit { }", "IStore.cs": "public interface IStore { }", "Store.cs": "public class Store : IStore { }",
        "Shop.cs": "public class Shop { public void Buy() { var c = new BuyCommand(1); } }", "BuyCommand.cs": "public record BuyCommand(int Id);",
        "Handler.cs": "public class Handler { public void Handle(BuyCommand c) { } }", "Twin.A.cs": "public partial class Twin { }", "Twin.B.cs": "public partial class Twin { int x; }",
    }
    got = edges(spark, tree)
    assert {("Report.cs", "Ext.cs", "ExtensionMethod"), ("Report.cs", "Customer.cs", "ParameterType")} <= got
    assert {("Page.cs", "FilterAttribute.cs", "Attribute"), ("Page.cs", "Audit.cs", "Attribute"), ("Page.cs", "IStore.cs", "ConstructorDependency"), ("Page.cs", "Store.cs", "Implementation")} <= got
    assert {("Shop.cs", "BuyCommand.cs", "ObjectCreation"), ("Shop.cs", "Handler.cs", "EventType"), ("Twin.A.cs", "Twin.B.cs", "PartialDeclaration"), ("Twin.B.cs", "Twin.A.cs", "PartialDeclaration")} <= got
    less = edges(spark, tree, attributes=False, implementations=False, event_subscribers=False)
    assert not {r for *_, r in less} & {"Attribute", "Implementation", "EventType"} and ("Page.cs", "IStore.cs", "ConstructorDependency") in less


def test_pieces_are_bound_to_the_innermost_type(spark):
    code = "using X;\nclass A { int a; class B<T> where T : class { void M() { if (x) { y(); } } int b; } struct C { } int c; }\nrecord D(int I);\nenum E { One, Two }\nint top;}}}"
    rows = spark.createDataFrame([(code,)], "t string").select(F.explode(CS.pieces(F.col("t"))).alias("p")).select("p.*").collect()
    owner = {r["code"]: (r["owner"], r["place"]) for r in rows}
    assert owner["int a"] == ("A", "member") and owner["int b"] == ("B", "member") and owner["int c"] == ("A", "member")
    assert owner["y()"] == ("B", "code") and owner["One, Two"] == ("E", "member") and owner["int top"] == (None, "code") and owner["record D(int I)"] == ("D", "type")


def test_masked_text_keeps_code_only(spark):
    code = 'a = "x \\" // y"; b = @"c:\\" + $"{Z}" /* q "r" */ + \'\\\'\'; // s "t\n#region U\nv = """w "x" """;'
    got = spark.createDataFrame([(code,), (None,)], "t string").select(CS.mask(F.col("t"))).collect()
    assert "".join(got[0][0].split()) == "a=;b=+$+;v=;" and got[1][0] == ""


# Order, pages, kept index


def test_ranges_are_even_with_a_third_of_all_rows_in_one_source(spark):
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 100)).alias("source"), (F.col("id") * 7919 % n).alias("v"))
    out = R.placed(df, [F.asc("source"), F.asc("v")])
    rows = sorted(out.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(n)) and [(r["source"], r["v"]) for r in rows] == sorted((r["source"], r["v"]) for r in rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = df.repartitionByRange("source", "v").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in dealt)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_pages_of_a_hub(spark):
    pairs = [(1, i) for i in range(2500)] + [(2, 7), (3, 1), (3, 0)]
    got = {(r[0], r[1]): r[2] for r in R.paged(spark.createDataFrame(pairs, "k long, v long").repartition(3), "k", "v").collect()}
    assert got == {(1, 0): list(range(1024)), (1, 1): list(range(1024, 2048)), (1, 2): list(range(2048, 2500)), (2, 0): [7], (3, 0): [0, 1]}


def test_kept_edges_equal_a_fresh_extraction(spark, tmp_path, monkeypatch):
    from sparkloom.operators import kept

    monkeypatch.setattr(kept, "COMPACT", 2)
    rng = random.Random(2)
    spec = lambda: f"import m{rng.randrange(12)}" if rng.random() < 0.6 else f"from .m{rng.randrange(12)} import x"
    tree = {f"{d}/m{i}.py": f"{spec()}\n{spec()}" for d in ("a", "b") for i in range(0, 12, 2)} | {"P.razor": "<Q />", "Q.razor": ""}
    read = []

    class Counting(A.Adapters):
        def matches(self, df):
            read.extend(r[0] for r in df.select("path").collect())
            return super().matches(df)

    few = [a for a in A.DEFAULTS if a.id in ("python", "dotnet")]
    index, plain = KeptIndex(spark, f"file://{tmp_path}/kept", Counting(few)), A.Adapters(few)
    assert index.edges().collect() == []
    for turn in range(4):
        if turn:
            for path in rng.sample(sorted(tree), 2):
                del tree[path]
            for path in rng.sample(sorted(tree), 2):
                tree[path] = f"{spec()}\n{spec()}"
            tree[f"a/m{rng.randrange(12)}.py"] = spec()
            tree["P.razor.cs"] = None
        read.clear()
        changed = {r["path"]: r["change"] for r in index.update(files(spark, tree)).collect()}
        assert sorted(read) == sorted(p for p, c in changed.items() if c != "removed")
        assert triples(index.edges()) == triples(plain.edges(files(spark, tree)))
        assert {r["path"] for r in index.files().collect()} == set(tree)
    assert index.update(files(spark, tree)).collect() == []
