"""Symbols and typed references from source text, as exploded regular expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import tables
from sparkloom.functions.text import WORD, extension, file_name, stem
from sparkloom.sources.shared import materialise

from .languages import COMPANIONS, DECLARED, HELPERS, JS, JS_EXTS, KINDS, RULES, SIBLING_EXTS, Rule
from .pairs import meet

PATHS = ("path", "sibling", "dots", "module", "mod")

#: Declaration and inheritance patterns.  Loops over modifiers are
#: possessive, so a long run of white space stays off the stack.
TYPE_DECL = r"(?m)^(?:\s|public|private|protected|internal|export|default|abstract|sealed|static|partial|open|data)*+(?:class|interface|struct|enum|record|trait|type)\s+([A-Za-z_][A-Za-z0-9_]*)"
FUNC_DECL = (
    r"(?m)(?:^\s*(?:public|private|protected|internal|export|async|static|virtual|override|fn|func|def|function)\s+(?:[A-Za-z0-9_<>,\.\[\]\?\s]+\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*\()"
    r"|(?:^\s*(?:export\s+)?(?:const|let)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_][A-Za-z0-9_]*)\s*=>)"
)
INHERIT = r"(?:class|struct|record|interface)\s+([A-Za-z_][A-Za-z0-9_]*)(?:<[^>]+>)?\s*:\s*([^\r\n\{]+)"


def declared_types(text: Column) -> Column:
    """Names of declared types in order, each once."""
    names = F.regexp_extract_all(text, F.lit(TYPE_DECL), F.lit(1))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(tables.IGNORED_WORDS)))


def declared_functions(text: Column, types: Column) -> Column:
    """Names of declared functions that are not types, in order, each once."""
    a, b = (F.regexp_extract_all(text, F.lit(FUNC_DECL), F.lit(g)) for g in (1, 2))
    names = F.zip_with(a, b, lambda x, y: F.when(F.length(x) > 0, x).otherwise(y))
    return F.array_except(F.filter(names, lambda n: (F.length(n) > 0) & ~n.isin(tables.IGNORED_WORDS)), types)


def symbols(types: Column, functions: Column, most: int = 12) -> Column:
    return F.slice(F.array_distinct(F.concat(types, F.transform(functions, lambda f: F.concat(f, F.lit("()"))))), 1, most)


def pascal_tokens(text: Column) -> Column:
    """Distinct capitalised identifiers of three or more characters: whole runs of word characters."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{WORD}]+"), F.lit(0)))
    return F.filter(runs, lambda t: t.rlike(r"^[A-Z][A-Za-z0-9_]{2,}\z"))


def base_names(text: Column) -> Column:
    """Identifiers of all base lists, in order, each once."""
    lists = F.regexp_extract_all(text, F.lit(INHERIT), F.lit(2))
    runs = F.flatten(F.transform(lists, lambda b: F.regexp_extract_all(b, F.lit(f"[{WORD}]+"), F.lit(0))))
    return F.array_distinct(F.filter(runs, lambda t: t.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z")))


def declarations(files: DataFrame) -> DataFrame:
    """The inverted index (name, path): declared types, and stems that can name a module."""
    types = files.select(F.explode(declared_types(F.col("content"))).alias("name"), "path")
    own = stem(F.col("path"))
    stems = files.select(own.alias("name"), "path").where((F.length("name") > 2) & ~F.lower("name").isin("program", "index"))
    return types.unionByName(stems).distinct()


def is_interface(name: Column) -> Column:
    return name.rlike(r"^I\p{Lu}")


def references(files: DataFrame, decl: DataFrame) -> DataFrame:
    """(src, dst, rel, prio): inheritance before token references.

    The index joins on the name; a popular name is a skewed key that adaptive
    execution splits.  Text never enters the shuffle.
    """
    bases = files.select("path", F.explode(base_names(F.col("content"))).alias("name"), F.lit("BaseType").alias("kind"), F.lit(1).alias("prio"))
    tokens = files.select("path", F.explode(pascal_tokens(F.col("content"))).alias("name"), F.lit("Reference").alias("kind"), F.lit(2).alias("prio"))
    refs = bases.unionByName(tokens)
    found = refs.join(decl.withColumnRenamed("path", "dst"), "name").where(F.upper("path") != F.upper("dst"))
    return found.select(F.col("path").alias("src"), "dst", F.when(is_interface(F.col("name")), "Interface").otherwise(F.col("kind")).alias("rel"), "prio")


def first_wins(edges: DataFrame, *order: str) -> DataFrame:
    """One edge per (src, dst): the first in ``order``, then by kind."""
    return edges.groupBy("src", "dst").agg(F.min_by("rel", F.struct(*order, "rel")).alias("rel"))


# --- language rules -------------------------------------------------------


def join_path(folder: Column, spec: Column) -> Column:
    """A relative specifier from a folder, with ``.`` and ``..`` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", folder, spec), "/"), lambda p: ~p.isin("", "."))
    start = F.array().cast("array<string>")
    up = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, start, up), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def path_candidates(how: Column, own: Column, spec: Column) -> Column:
    """Where a specifier may point, in order, by how it is read.

    ``path``: itself, with extensions, a partial, an index file.  ``sibling``: a component beside the
    file.  ``dots``: a relative Python module, a folder up for each dot after the first.  ``module``: a Python
    module beside the file or from the root.  ``mod``: a Rust module.
    """
    base = join_path(own, spec)
    lead, leaf = F.regexp_extract(base, r"^(.*/)?[^/]*\z", 1), file_name(base)
    exts = [F.concat(base, F.lit(e)) for e in JS_EXTS + [".dart", ".h", ".hpp"]]
    partial = [F.concat(lead, F.lit("_"), leaf, F.lit(e)) for e in (".scss", ".sass", "")]
    index = [F.concat(base, F.lit("/index"), F.lit(e)) for e in JS_EXTS[:4]]
    dotted = lambda s: F.replace(s, F.lit("."), F.lit("/"))
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    above = join_path(own, F.concat(F.repeat(F.lit("../"), dots - 1), dotted(F.regexp_replace(spec, r"^\.+", ""))))
    local = join_path(own, dotted(spec))
    return (
        F.when(how == "path", F.array(base, *exts, *partial, *index))
        .when(how == "sibling", F.array(*[F.concat(base, F.lit(e)) for e in SIBLING_EXTS]))
        .when(how == "dots", F.array(F.concat(above, F.lit(".py")), F.concat(above, F.lit("/__init__.py"))))
        .when(how == "module", F.array(*[F.concat(x, F.lit(e)) for x in (local, dotted(spec)) for e in (".py", "/__init__.py")]))
        .when(how == "mod", F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs"))))
    )


def name_parts(how: Column, spec: Column) -> Column:
    """The segments of a name in the order in which they are looked up: from the right, or (``left``) from the left."""
    parts = F.filter(F.split(spec, r"[.\\:]+"), lambda p: ~p.isin("", "crate", "super", "self"))
    return F.when(how == "left", parts).otherwise(F.reverse(parts))


_MATCHES = "array<struct<spec:string,rel:string,how:string,targets:array<string>>>"


def _hits(rule: Rule, content: Column | str = "content") -> Column:
    hits = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(rule.group))
    if rule.each:
        hits = F.flatten(F.transform(hits, lambda h: F.regexp_extract_all(h, F.lit(rule.each), F.lit(1))))
    targets = F.array(*[F.lit(e) for e in (rule.targets or rule.exts)])

    def match(hit: Column) -> Column:
        rel = F.lit(rule.rel)
        for pattern, other in rule.rel_if:
            rel = F.when(hit.rlike(pattern), F.lit(other)).otherwise(rel)
        return F.struct(hit.alias("spec"), rel.alias("rel"), F.lit(rule.how).alias("how"), targets.alias("targets"))

    return F.transform(F.filter(hits, lambda h: (h != "") & ~h.isin(*rule.skip)) if rule.skip else F.filter(hits, lambda h: h != ""), match)


MATCH = "path string, spec string, rel string, how string, targets array<string>"


def rule_matches(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """What the texts of (path, content) name, by the rules that fit each file's extension: (path, spec, rel, how, targets), in one pass."""
    rules = RULES if rules is None else rules
    found = [F.when(F.col("ext").isin(list(r.exts)), _hits(r)).otherwise(F.array().cast(_MATCHES)) for r in rules]
    text = files.select("path", extension(F.col("path")).alias("ext"), "content")
    return text.select("path", F.explode(F.array_distinct(F.concat(*found))).alias("m")).select("path", "m.*")


def file_index(files: DataFrame) -> DataFrame:
    """(path, ext, stem) of files: what names are looked up in; no text is read."""
    return files.select("path", extension(F.col("path")).alias("ext"), stem(F.col("path")).alias("stem"))


def links(matches: DataFrame, known: DataFrame) -> DataFrame:
    """(path, spec, rel, how, dst): each match's best file among ``known`` (path, ext, stem); matches without one are left out.

    Candidate paths and the segments of names join ``known`` once each.
    """
    by_path = matches.where(F.col("how").isin(*PATHS)).select("path", "rel", "how", "spec", F.posexplode(path_candidates(F.col("how"), folder(F.col("path")), F.col("spec"))).alias("pos", "candidate"))
    exact = known.select(F.upper("path").alias("key"), F.col("path").alias("dst"))
    hit = by_path.join(exact, F.upper("candidate") == F.col("key")).groupBy("path", "spec", "rel", "how").agg(F.min_by("dst", F.struct("pos", "dst")).alias("dst"))
    # A name: its segments in turn until one is a file's stem; same folder first.
    named = matches.where(~F.col("how").isin(*PATHS)).select("path", "rel", "how", "spec", "targets", F.posexplode(name_parts(F.col("how"), F.col("spec"))).alias("pos", "part"))
    stems = known.select(F.upper("stem").alias("key"), F.col("ext").alias("dext"), F.col("path").alias("dst"))
    near = F.when(folder(F.col("path")) == folder(F.col("dst")), 0).otherwise(1)
    by_name = named.join(stems, (F.upper("part") == F.col("key")) & F.array_contains("targets", F.col("dext"))).where("path <> dst")
    by_name = by_name.groupBy("path", "spec", "rel", "how").agg(F.min_by("dst", F.struct("pos", near.alias("near"), "dst")).alias("dst"))
    return hit.unionByName(by_name)


def lookup_keys(matches: DataFrame) -> DataFrame:
    """(path, spec, rel, how, key): what each match is looked up by, in upper case: "/" and a path, or a stem."""
    by_path = F.transform(path_candidates(F.col("how"), folder(F.col("path")), F.col("spec")), lambda c: F.concat(F.lit("/"), F.upper(c)))
    by_name = F.transform(name_parts(F.col("how"), F.col("spec")), lambda n: F.upper(n))
    return matches.select("path", "spec", "rel", "how", F.explode(F.array_distinct(F.when(F.col("how").isin(*PATHS), by_path).otherwise(by_name))).alias("key"))


def resolved(matches: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, rel) of ``links``."""
    return links(matches, known).select(F.col("path").alias("src"), "dst", "rel")


def companions(own: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst, rel): files of ``known`` that belong to one of ``own`` by name; both are (path, ext, stem)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("own"), F.lit(b).alias("more"), F.lit(c).alias("rel")) for a, b, c in COMPANIONS])
    owners = own.select("path", "ext", F.explode(pairs).alias("c")).where("ext = c.own")
    owners = owners.select("path", F.col("c.rel").alias("rel"), F.upper(F.concat(F.regexp_replace("path", r"\.[^./]*\z", ""), F.col("c.more"))).alias("want"))
    exact = known.select(F.upper("path").alias("key"), F.col("path").alias("dst"))
    return owners.join(exact, F.col("want") == F.col("key")).select(F.col("path").alias("src"), "dst", "rel")


def rule_edges(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(src, dst, rel, prio) of all rules and companions over a table of files."""
    known = file_index(files)
    out = resolved(rule_matches(files, rules), known).unionByName(companions(known, known))
    return out.where("src <> dst").distinct().withColumn("prio", F.lit(0))


def _of(files: DataFrame, *exts: str) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*exts)).select("path", folder(F.col("path")).alias("dir"), "content")


def _words(text: Column, pattern: str) -> Column:
    """Distinct whole runs of word characters that match a pattern."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{WORD}]+"), F.lit(0)))
    return F.filter(runs, lambda t: t.rlike(pattern))


def _edge(df: DataFrame, rel: Column) -> DataFrame:
    return df.where("path <> dst").select(F.col("path").alias("src"), "dst", rel.alias("rel")).distinct()


def _named(uses: DataFrame, decl: DataFrame, family: str, rel: Column | str) -> tuple[DataFrame, DataFrame]:
    """The sides of ``pairs.meet`` from (path, name) and (dst, name); names of a family meet their own only."""
    name, rel = F.concat(F.lit(family + ":"), "name").alias("name"), F.lit(rel) if isinstance(rel, str) else rel
    return uses.select("path", name, rel.alias("rel"), F.lit(0).alias("prio")), decl.select(F.col("dst").alias("path"), name)


def _all(*sides: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    uses, decl = sides[0]
    for u, d in sides[1:]:
        uses, decl = uses.unionByName(u), decl.unionByName(d)
    return uses, decl


def _linked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, rel) as sides of ``pairs.meet``: a target's path is a name that it alone declares."""
    return _named(edges.select(F.col("src").alias("path"), F.col("dst").alias("name"), "rel"), edges.select("dst", F.col("dst").alias("name")), "edge", F.col("rel"))


def prototype_names(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods that JS and TS files call, and those that extension and polyfill files define."""
    js = _of(files, *JS)
    named = F.lower(file_name(F.col("path")))
    more = js.where((named.contains("extension") | named.contains("polyfill")) & F.col("path").rlike(r"(?i)\.[tj]s\z"))
    own = F.regexp_extract_all("content", F.lit(r"\.prototype\.([A-Za-z0-9_]+)\s*="), F.lit(1))
    declared = F.when(F.col("content").rlike(r"declare\s+global"), F.regexp_extract_all("content", F.lit(r"([a-zA-Z0-9_]+)\s*\([^)]*\)\s*:"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    defined = more.select(F.col("path").alias("dst"), F.explode(F.array_distinct(F.concat(own, declared))).alias("name"))
    calls = js.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\.([a-zA-Z0-9_]+)\s*\("), F.lit(1)))).alias("name"))
    return _named(calls, defined, "call", "ExtensionMethod")


def prototype_edges(files: DataFrame) -> DataFrame:
    """JS and TS files to the extension or polyfill files that define a method which they call."""
    return meet(*prototype_names(files), each_rel=True)


def helper_names(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of Python files beside helper modules, and the functions and classes of these, by folder."""
    py = _of(files, ".py")
    here = F.concat("dir", F.lit("\n"), "name").alias("name")
    helpers = py.where(F.lower(file_name(F.col("path"))).isin(*HELPERS))
    names = helpers.select("dir", F.col("path").alias("dst"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:def|class)\s+([A-Za-z0-9_]+)"), F.lit(1)))).alias("name"))
    near = py.join(helpers.select("dir").distinct(), "dir", "left_semi")
    uses = near.select("path", "dir", F.explode(_words(F.col("content"), r"^[A-Za-z0-9_]+\z")).alias("name"))
    return _named(uses.select("path", here), names.select("dst", here), "helper", "ExtensionMethod")


def python_helpers(files: DataFrame) -> DataFrame:
    """Python files to the helper modules of their folder whose functions or classes they name."""
    return meet(*helper_names(files), each_rel=True)


def java_names(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of Java files, and the types of their package and the implementations (XImpl) of any type X that these name."""
    java = _of(files, ".java")
    types = java.select("dir", stem(F.col("path")).alias("name"), F.col("path").alias("dst"))
    named = java.select("path", "dir", F.explode(_words(F.col("content"), r"^[A-Za-z_][A-Za-z0-9_]*\z")).alias("name"))
    here = F.concat("dir", F.lit("\n"), "name").alias("name")
    near = _named(named.select("path", here), types.select("dst", here), "package", F.when(F.col("name").rlike("Extensions?$"), "ExtensionMethod").otherwise("Interface"))
    impls = types.where(F.col("name").endswith("Impl")).select("dst", F.expr("upper(substring(name, 1, length(name) - 4))").alias("name"))
    far = named.where(F.col("name").rlike("^[A-Z]..*")).select("path", F.upper("name").alias("name"))
    return _all(near, _named(far, impls, "impl", "Implementation"))


def java_mentions(files: DataFrame) -> DataFrame:
    """Java files to the types of their package that they name, and to the implementations (XImpl) of any type X that they name."""
    return meet(*java_names(files), each_rel=True)


def implementation_names(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names in C# files, and the interfaces that files implement and the events that they handle."""
    cs = _of(files, ".cs", ".razor", ".cshtml")
    bases = cs.select(F.col("path").alias("dst"), F.explode(base_names(F.col("content"))).alias("name")).where(is_interface(F.col("name")))
    handled = F.regexp_extract_all("content", F.lit(r"I?(?:Notification|Request|Event|Command|Query|Message)?(?:Handler|Consumer)\s*<\s*([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    handlers = cs.select(F.col("path").alias("dst"), F.explode(F.array_distinct(handled)).alias("name"))
    named = cs.select("path", F.explode(pascal_tokens(F.col("content"))).alias("name"))
    return _all(_named(named, bases, "base", "Implementation"), _named(named, handlers, "event", "EventType"))


def implementations(files: DataFrame) -> DataFrame:
    """C# files that name an interface to the files that implement it, and those that name an event to its handlers."""
    return meet(*implementation_names(files), each_rel=True)


def _go(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Non-test Go files (path, dir, content), and the last segments of the paths that they import (path, name, rel)."""
    go = _of(files, ".go").where(~F.col("path").endswith("_test.go"))
    blocks = F.regexp_extract_all("content", F.lit(r"import\s*(\([^)]*\)|['\"][^'\"\n]+['\"])"), F.lit(1))
    specs = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"['\"](?:[^'\"\n]*/)?([^/'\"\n]+)['\"]"), F.lit(1))))
    rel = F.when(F.col("name").rlike("ext|helper|util"), "ExtensionMethod").otherwise("Import")
    return go, go.select("path", F.explode(F.array_distinct(F.transform(specs, F.lower))).alias("name")).withColumn("rel", rel)


def go_packages(files: DataFrame) -> DataFrame:
    """Non-test Go files of a folder import each other, and the packages that they name by a path, in linear rows.

    A package stands for its files through its first one: siblings link with it both
    ways and importers link to it, so reachability is that of all pairs, which ``package_names`` gives.
    """
    go, wanted = _go(files)
    lead = go.groupBy("dir").agg(F.min("path").alias("lead"))
    pairs = go.join(lead, "dir").select("path", F.col("lead").alias("dst"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("path"), F.col("path").alias("dst")))
    named = lead.select(F.lower(file_name(F.col("dir"))).alias("name"), F.col("lead").alias("dst"))
    return _edge(both, F.lit("Import")).unionByName(_edge(wanted.join(named, "name"), F.col("rel"))).distinct()


def package_names(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders of non-test Go files and the packages that these import, and the files of either: every file of a folder meets every other, and an importer every file of the package."""
    go, wanted = _go(files)
    siblings = _named(go.select("path", F.col("dir").alias("name")), go.select(F.col("path").alias("dst"), F.col("dir").alias("name")), "siblings", "Import")
    imports = _named(wanted, go.select(F.col("path").alias("dst"), F.lower(file_name(F.col("dir"))).alias("name")), "import", F.col("rel"))
    return _all(siblings, imports)


def declared_nodes(files: DataFrame) -> DataFrame:
    """(path, id, kind, name, ord): types and functions that files declare, by their language, in order; each has an Export edge from its file."""
    ext, empty = extension(F.col("path")), F.array().cast("array<struct<kind:string,name:string,family:string>>")
    found = []
    for d in DECLARED:
        word = F.regexp_extract_all("content", F.lit(d.pattern), F.lit(d.word)) if d.word else F.transform(F.regexp_extract_all("content", F.lit(d.pattern), F.lit(d.name)), lambda _: F.lit("function"))
        names = F.arrays_zip(word.alias("w"), F.regexp_extract_all("content", F.lit(d.pattern), F.lit(d.name)).alias("n"))
        kind = lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in KINDS]), w), F.lit("Class"))
        family = "func" if not d.word else "type"
        found.append(F.when(ext.isin(*d.exts), F.transform(names, lambda z: F.struct(kind(z["w"]).alias("kind"), z["n"].alias("name"), F.lit(family).alias("family")))).otherwise(empty))  # noqa: B023
    rows = files.select("path", F.posexplode(F.array_distinct(F.concat(*found))).alias("ord", "d"))
    return rows.select("path", F.concat(F.col("d.family"), F.lit(":"), "path", F.lit("#"), F.col("d.name")).alias("id"), F.col("d.kind").alias("kind"), F.col("d.name").alias("name"), "ord")


def all_edges(files: DataFrame, *, whole_packages: bool = False) -> DataFrame:
    """Edges of the code graph: rules, packages and indexes first, then inheritance, then tokens; the first kind of a pair wins.

    With ``whole_packages`` Go files link with all files of their packages (``package_names``), else with the first of each (``go_packages``).
    """
    decl = declarations(files)
    text = lambda names, kind, prio: files.select("path", F.explode(names(F.col("content"))).alias("name")).select("path", F.concat(F.lit("type:"), "name").alias("name"), F.when(is_interface(F.col("name")), "Interface").otherwise(kind).alias("rel"), F.lit(prio).alias("prio"))
    refs = text(base_names, "BaseType", 1).unionByName(text(pascal_tokens, "Reference", 2)), decl.select("path", F.concat(F.lit("type:"), "name").alias("name"))
    linear, named = rule_edges(files).select("src", "dst", "rel"), [prototype_names, helper_names, java_names, implementation_names]
    if whole_packages:
        named.append(package_names)
    else:
        linear = linear.unionByName(go_packages(files))
    return meet(*_all(_linked(materialise(linear)), *[part(files) for part in named], refs))


def edges_by_rules(files: DataFrame, *named) -> DataFrame:
    """(src, dst, rel), each once, of ``rule_edges`` and of ``named`` functions, such as ``prototype_names``."""
    linear = materialise(rule_edges(files).select("src", "dst", "rel"))
    return meet(*_all(_linked(linear), *[part(files) for part in named]), each_rel=True)


# --- Python by its own parser ----------------------------------------------

PYTHON_SYMBOLS = "path string, kind string, name string, owner string, line int, error string"


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, owner, line, error) of Python files by the standard parser.

    Kinds: class, method, function, import, dynamic.  A text that does not parse gives one
    row with its error; null texts are empty.
    """
    return files.where(F.col("path").endswith(".py")).select("path", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(_python_rows, PYTHON_SYMBOLS)


def _python_rows(batches):
    import ast

    import pyarrow as pa

    for batch in batches:
        rows: list[tuple] = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                rows.append((path, "error", None, None, getattr(e, "lineno", None), type(e).__name__))
                continue
            for node in ast.walk(tree):
                if isinstance(node, ast.ClassDef):
                    rows.append((path, "class", node.name, None, node.lineno, None))
                    rows += [(path, "method", m.name, node.name, m.lineno, None) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
                elif isinstance(node, ast.Import):
                    rows += [(path, "import", a.name, None, node.lineno, None) for a in node.names]
                elif isinstance(node, ast.ImportFrom):
                    rows.append((path, "import", "." * node.level + (node.module or ""), None, node.lineno, None))
                elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("eval", "exec", "__import__", "getattr"):
                    rows.append((path, "dynamic", node.func.id, None, node.lineno, None))
            rows += [(path, "function", n.name, None, n.lineno, None) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string()] * 4 + [pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["path", "kind", "name", "owner", "line", "error"])
