"""Queries over the extractors of each language.

Their SQL does not parse code: the bound files name each other by arithmetic, and the SQL states
which edges and symbols that makes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import extract as X
from sparkloom.operators import graph as G
from sparkloom.operators import roots as R
from sparkloom.sources import code_bindings as C

from .registry import register


def _edges(lang: int, *parts: tuple[str, str, str]) -> str:
    """(src, dst, rel) of files j and their targets: (target, kind, condition) each."""
    src = C.path_sql(lang, "j")
    rows = [f"SELECT {src} AS src, {C.path_sql(lang, target)} AS dst, '{rel}' AS rel FROM k WHERE lang = {lang} AND {where}" for target, rel, where in parts]
    return "WITH " + C.numbers_sql() + f" SELECT DISTINCT src, dst, rel FROM ({' UNION ALL '.join(rows)}) e WHERE src <> dst"


def _rules(spark, sf_dir, lang, *more):
    files = C.code_files(spark, sf_dir, lang)
    out = X.rule_edges(files).select("src", "dst", "rel")
    for part in more:
        out = out.unionByName(part(files))
    return out.distinct()


_JS = lambda t: f"j % 29 <> 0 AND {t} % 29 <> 0"


_PY = lambda t: f"j >= 5 AND {t} >= 5 AND {t} % 5 = j % 5"
_JA = lambda t: f"{t} % 31 <> 7"
#: What the rules of each language find in file j: target, kind, condition.
RULE_EDGES = [
    [("t1", "Import", _JS("t1")), ("t2", "Import", _JS("t2")), ("t1", "DynamicImport", _JS("t1")), ("t3", "ComponentUsage", _JS("t3") + " AND t3 % 13 = j % 13"), ("t2", "Decorator", _JS("t2")), ("t1", "Interface", _JS("t1")), ("t2", "Interface", _JS("t2"))],
    [("t3", "Import", _PY("t3")), ("t1", "Import", "j >= 5 AND t1 >= 5"), ("t2", "Import", "j >= 5 AND t2 >= 5"), ("t3", "BaseType", _PY("t3")), ("t4", "Decorator", _PY("t4")), ("t3", "EventType", _PY("t3"))],
    [("t1", "Import", _JA("t1")), ("t2", "ExtensionMethod", _JA("t2")), ("t1", "Interface", _JA("t1")), ("t3", "Interface", _JA("t3")), ("t4", "MethodCall", _JA("t4")),
     ("t5", "Annotation", _JA("t5")), ("t1", "Annotation", _JA("t1")), ("t2", "EventType", _JA("t2")), ("t2", "Annotation", _JA("t2"))],
    [("t1", "Import", "true"), ("t2", "Import", "true"), ("t3", "Implementation", "true"), ("t4", "Implementation", "true"), ("t5", "Attribute", "true")],
    [("t1", "Import", "true"), ("t2", "ExtensionMethod", "true"), ("t3", "Implementation", "true"), ("t4", "Implementation", "true")],
    [("t1", "Import", "true"), ("t5", "Attribute", "true"), ("t1", "Attribute", "true"), ("t2", "BaseType", "true"), ("t3", "Implementation", "true"), ("t4", "Implementation", "true")],
    [],
    [("t1 - t1 % 2 + 1", "Import", "t1 - t1 % 2 + 1 < m"), ("j + 1 - 2 * (j % 2)", "CodeBehind", "j + 1 - 2 * (j % 2) < m"),
     ("t2 - t2 % 2 + CASE WHEN t2 - t2 % 2 = j - j % 2 THEN 1 - j % 2 ELSE 0 END", "BaseType", "t2 - t2 % 2 + CASE WHEN t2 - t2 % 2 = j - j % 2 THEN 1 - j % 2 ELSE 0 END < m")],
]


@register("js_edges", "WITH " + C.numbers_sql() + f", plain AS ({_edges(0, *RULE_EDGES[0])[len('WITH ' + C.numbers_sql()):]})"
          + f" SELECT * FROM plain UNION ALL SELECT DISTINCT {C.path_sql(0, 'a.j')}, {C.path_sql(0, 'b.j')}, 'ExtensionMethod' FROM k a JOIN k b ON a.j % 7 = b.j % 7 WHERE a.lang = 0 AND b.lang = 0 AND a.j % 29 <> 0 AND b.j % 29 = 0")
def js_edges(spark, sf_dir):
    return X.edges_by_rules(C.code_files(spark, sf_dir, 0), X.prototype_names)


@register("python_edges", _edges(1, *RULE_EDGES[1], ("j % 5", "ExtensionMethod", "j >= 5")))
def python_edges(spark, sf_dir):
    return X.edges_by_rules(C.code_files(spark, sf_dir, 1), X.helper_names)


_MENTIONS = ["j", "t1", "t2", "t3", "t4", "t5"]


@register("java_edges", _edges(2, *RULE_EDGES[2],
    *[(t, "Interface", _JA(t) + f" AND {t} % 6 = j % 6") for t in _MENTIONS], *[(f"{t} + 1", "Implementation", f"({t} + 1) % 31 = 7 AND {t} + 1 < m") for t in _MENTIONS],
))
def java_edges(spark, sf_dir):
    return X.edges_by_rules(C.code_files(spark, sf_dir, 2), X.java_names)


@register("rust_edges", _edges(3, *RULE_EDGES[3]))
def rust_edges(spark, sf_dir):
    return _rules(spark, sf_dir, 3)


@register("kotlin_edges", _edges(4, *RULE_EDGES[4]))
def kotlin_edges(spark, sf_dir):
    return _rules(spark, sf_dir, 4)


@register("php_edges", _edges(5, *RULE_EDGES[5]))
def php_edges(spark, sf_dir):
    return _rules(spark, sf_dir, 5)


@register("go_edges", "WITH " + C.numbers_sql() + f""", g AS (SELECT j % 9 AS pkg, t1 % 9 AS want, {C.path_sql(6, 'j')} AS path FROM k WHERE lang = 6), lead AS (SELECT pkg, min(path) AS lead FROM g GROUP BY pkg)
 SELECT DISTINCT src, dst, 'Import' AS rel FROM (SELECT path AS src, lead AS dst FROM g JOIN lead USING (pkg) UNION ALL SELECT lead, path FROM g JOIN lead USING (pkg)
 UNION ALL SELECT path, lead FROM g JOIN lead ON lead.pkg = g.want) e WHERE src <> dst""")
def go_edges(spark, sf_dir):
    """Packages linked through their first file, siblings and importers."""
    return _rules(spark, sf_dir, 6, X.go_packages)


@register("cpp_edges", _edges(7, *RULE_EDGES[7]))
def cpp_edges(spark, sf_dir):
    return _rules(spark, sf_dir, 7)


#: What file j of a language declares: condition, name, kind, family.
_DECLARED = [
    (0, "j % 29 <> 0", "'K' || j", "Class", "type"), (0, "j % 29 <> 0", "'make' || j", "Function", "func"),
    (1, "j >= 5", "'C' || j", "Class", "type"), (1, "j >= 5", "'run' || j", "Function", "func"), (1, "j >= 5", "'go' || j", "Function", "func"), (1, "j < 5", "'util' || j", "Function", "func"),
    (2, "true", "'J' || j", "Class", "type"),
    (3, "true", "'S' || j", "Struct", "type"), (3, "true", "'act' || j", "Function", "func"),
    (4, "true", "'Q' || j", "Class", "type"), (4, "true", "'act' || j", "Function", "func"),
    (5, "true", "'P_' || j", "Class", "type"), (5, "true", "'act' || j", "Function", "func"),
    (6, "true", "'T' || j", "Struct", "type"), (6, "true", "'Act' || j", "Function", "func"),
    (7, "true", "'A' || j", "Class", "type"),
]


@register("declared_nodes", "WITH " + C.numbers_sql() + ", d AS (" + " UNION ALL ".join(f"SELECT {C.path_sql(lang, 'j')} AS path, '{family}' AS family, '{kind}' AS kind, {name} AS name FROM k WHERE lang = {lang} AND {where}" for lang, where, name, kind, family in _DECLARED)
          + ") SELECT path, family || ':' || path || '#' || name AS id, kind, name FROM d")
def declared_nodes(spark, sf_dir):
    return X.declared_nodes(C.code_files(spark, sf_dir)).drop("ord")


#: The root of file j of a language: its declarations' number, and the node where there is one.
_ROOTS = [
    (0, "j % 29 <> 0", "2", "NULL"), (0, "j % 29 = 0", "0", "NULL"), (1, "j >= 5", "3", "NULL"), (1, "j < 5", "1", "'func:' || {p} || '#util' || j"), (2, "true", "1", "'type:' || {p} || '#J' || j"),
    (3, "true", "2", "NULL"), (4, "true", "2", "NULL"), (5, "true", "2", "'type:' || {p} || '#P_' || j"), (6, "true", "2", "NULL"), (7, "true", "1", "'type:' || {p} || '#A' || j"),
]
_RESOLVED = "WITH " + C.numbers_sql() + ", r AS (" + " UNION ALL ".join(
    f"SELECT {C.path_sql(lang, 'j')} AS path, ({node.format(p='(' + C.path_sql(lang, 'j') + ')')})::VARCHAR AS node, {n}::BIGINT AS candidates FROM k WHERE lang = {lang} AND {where}" for lang, where, n, node in _ROOTS
) + ")"


@register("root_resolution", _RESOLVED + " SELECT path, coalesce(node, 'file:' || path) AS root_id, split_part(node, '#', 2) AS root_symbol, candidates, candidates > 1 AND node IS NULL AS multi FROM r")
def root_resolution(spark, sf_dir):
    files = C.code_files(spark, sf_dir)
    return R.resolve_roots(files, X.declared_nodes(files)).drop("error")


@register("root_expansion", _RESOLVED + """ SELECT path, count(*) AS roots FROM (SELECT path, unnest(range(CASE WHEN candidates > 1 AND node IS NULL THEN candidates + 1 ELSE 1 END)) FROM r) x GROUP BY path""")
def root_expansion(spark, sf_dir):
    """How many roots a question about each file has."""
    files = C.code_files(spark, sf_dir)
    nodes = G.materialise(X.declared_nodes(files))
    return R.root_nodes(R.resolve_roots(files, nodes), nodes).groupBy("path").agg(F.count("*").alias("roots"))


def _web(*parts: tuple[int, int, str, str, str]) -> str:
    """(src, dst, rel) of files j: (kind, target's kind, target, relationship, condition) each."""
    rows = [f"SELECT {C.web_path(kind, 'j')} AS src, {C.web_path(to, target)} AS dst, '{rel}' AS rel FROM k WHERE lang = {kind} AND {where}" for kind, to, target, rel, where in parts]
    return "WITH " + C.web_sql() + f" SELECT DISTINCT src, dst, rel FROM ({' UNION ALL '.join(rows)}) e WHERE src <> dst"


def _web_edges(spark, sf_dir, *kinds):
    return X.rule_edges(G.materialise(C.web_files(spark, sf_dir, *kinds))).select("src", "dst", "rel")


@register("web_edges", _web((0, 1, "j", "Template", "true"), (0, 2, "t1", "Style", "true"), (0, 2, "t2", "Style", "true"), (1, 0, "t1", "ScriptReference", "true"), (1, 2, "t2", "StyleReference", "true"),
                            (2, 2, "t1", "StyleReference", "true"), (2, 2, "t2", "StyleReference", "true")))
def web_edges(spark, sf_dir):
    """Components with their templates and styles, pages with scripts and styles, styles with partials."""
    return _web_edges(spark, sf_dir, 0, 1, 2)


@register("dart_edges", _web((3, 3, "t1", "Import", "true"), (3, 3, "t2", "CodeBehind", "true"), (3, 3, "t3", "BaseType", "true"), (3, 3, "t4", "EventType", "true")))
def dart_edges(spark, sf_dir):
    return _web_edges(spark, sf_dir, 3)


@register("razor_edges", _web((4, 4, "j + 1", "CodeBehind", "j % 4 = 0 AND j + 1 < m"), (4, 4, "t1 - t1 % 2", "ComponentUsage", "j % 2 = 0"), (4, 4, "t2 - t2 % 4 + 3", "Service", "j % 2 = 0 AND t2 - t2 % 4 + 3 < m")))
def razor_edges(spark, sf_dir):
    return _web_edges(spark, sf_dir, 4)
