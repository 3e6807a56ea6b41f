"""Queries over extracted symbols and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import filters, tables
from sparkloom.functions import text as T
from sparkloom.operators import extract as X
from sparkloom.operators import factors as FA
from sparkloom.operators import pairs as P
from sparkloom.sources import bindings as B

from . import sql as S
from .registry import register

_TYPE = X.TYPE_DECL.replace("*+", "*")
_RUN = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]+"
_IGN = S.listed(tables.IGNORED_WORDS)
TYPES = f"list_distinct_ordered(list_filter(regexp_extract_all(content, {S.text(_TYPE)}, 1), lambda n: n NOT IN {_IGN}))"


def ordered_distinct(expr: str) -> str:
    """DuckDB's list_distinct has no order: keep first places."""
    return f"list_transform(list_filter(list_zip({expr}, range(len({expr}))), lambda z: list_position({expr}, z[1]) = z[2] + 1), lambda z: z[1])"


_types = ordered_distinct("t0")
_SYMBOLS = f""", s0 AS (SELECT doc_id, path, content,
  list_filter(regexp_extract_all(content, {S.text(_TYPE)}, 1), lambda n: n NOT IN {_IGN}) AS t0,
  list_filter(list_transform(list_zip(regexp_extract_all(content, {S.text(X.FUNC_DECL)}, 1), regexp_extract_all(content, {S.text(X.FUNC_DECL)}, 2)),
              lambda z: CASE WHEN length(z[1]) > 0 THEN z[1] ELSE z[2] END), lambda n: length(n) > 0 AND n NOT IN {_IGN}) AS f0 FROM files),
 s1 AS (SELECT doc_id, path, {_types} AS types, list_filter(f0, lambda f: NOT list_contains(t0, f)) AS f1 FROM s0),
 sym AS (SELECT doc_id, path, types, {ordered_distinct('f1')} AS functions FROM s1)"""
FILES = "WITH " + B.files_sql() + _SYMBOLS
DECL = """, decl AS (SELECT DISTINCT unnest(types) AS name, path FROM sym UNION SELECT DISTINCT st, path FROM
 (SELECT regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS st, path FROM files) q WHERE length(st) > 2 AND lower(st) NOT IN ('program', 'index'))"""
REFS = f""", bases AS (SELECT path, unnest(list_filter(flatten(list_transform(regexp_extract_all(content, {S.text(X.INHERIT)}, 2), lambda b: regexp_extract_all(b, {S.text(_RUN)}))), lambda t: regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]*$'))) AS name FROM files),
 toks AS (SELECT path, unnest(list_filter(list_distinct(regexp_extract_all(content, {S.text(_RUN)})), lambda t: regexp_matches(t, '^[A-Z][A-Za-z0-9_]{{2,}}$'))) AS name FROM files),
 refs AS (SELECT DISTINCT r.path AS src, d.path AS dst, CASE WHEN regexp_matches(r.name, '^I\\p{{Lu}}') THEN 'Interface' ELSE kind END AS rel, prio
   FROM (SELECT path, name, 'BaseType' AS kind, 1 AS prio FROM bases UNION ALL SELECT path, name, 'Reference', 2 FROM toks) r JOIN decl d ON r.name = d.name WHERE r.path <> d.path)"""


def _sym(spark, sf_dir):
    types = X.declared_types(F.col("content"))
    f = B.files(spark, sf_dir).select("doc_id", "path", "content", types.alias("types"))
    return f.select("doc_id", "path", "types", X.declared_functions(F.col("content"), F.col("types")).alias("functions"))


@register("declared_symbols", FILES + " SELECT doc_id, array_to_string(types, ',') AS types, array_to_string(functions, ',') AS functions FROM sym")
def declared_symbols(spark, sf_dir):
    return _sym(spark, sf_dir).select("doc_id", F.array_join("types", ",").alias("types"), F.array_join("functions", ",").alias("functions"))


@register("symbols_top12", FILES + " SELECT doc_id, array_to_string(list_concat(types, list_transform(functions, lambda f: f || '()'))[1:12], ',') AS symbols FROM sym")
def symbols_top12(spark, sf_dir):
    return _sym(spark, sf_dir).select("doc_id", F.array_join(X.symbols(F.col("types"), F.col("functions")), ",").alias("symbols"))


@register("decl_index", FILES + DECL + " SELECT name, path FROM decl")
def decl_index(spark, sf_dir):
    return X.declarations(B.files(spark, sf_dir))


@register("type_refs", FILES + DECL + REFS + " SELECT src, dst, rel FROM refs WHERE prio = 2")
def type_refs(spark, sf_dir):
    f = FA.factors(B.files(spark, sf_dir))
    return P.meet(f.uses.where("prio = 2"), f.decl, each_rel=True)


@register("inheritance_refs", FILES + DECL + REFS + " SELECT src, dst, rel FROM refs WHERE prio = 1")
def inheritance_refs(spark, sf_dir):
    f = FA.factors(B.files(spark, sf_dir))
    return P.meet(f.uses.where("prio = 1"), f.decl, each_rel=True)


@register("edge_first_wins", FILES + DECL + REFS + " SELECT src, dst, min_by(rel, prio || rel) AS rel FROM refs GROUP BY src, dst")
def edge_first_wins(spark, sf_dir):
    return P.meet(*FA.factors(B.files(spark, sf_dir)))


@register("code_graph_edges")
def code_graph_edges(spark, sf_dir):
    """All pairs, also those of files of one Go package."""
    return X.all_edges(B.files(spark, sf_dir), whole_packages=True)


@register("python_ast_symbols")
def python_ast_symbols(spark, sf_dir):
    return X.python_symbols(B.files(spark, sf_dir))


@register("import_by_stem", "WITH " + B.files_sql() + """, imp AS (SELECT path, unnest(regexp_extract_all(content, 'import x from "\\./([a-z_0-9]+)"', 1)) AS st FROM files)
 SELECT imp.path AS src, imp.st AS stem, min(f.path) AS dst FROM imp JOIN files f ON upper(imp.st) = upper(regexp_replace(f.name, '\\.[^.]*$', '')) AND f.ext IN ('.ts', '.tsx') GROUP BY ALL""")
def import_by_stem(spark, sf_dir):
    files = B.files(spark, sf_dir)
    imports = files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(r'import x from "\./([a-z_0-9]+)"'), F.lit(1))).alias("stem"))
    index = files.where(F.col("ext").isin(".ts", ".tsx")).select(F.upper(T.stem(F.col("path"))).alias("key"), "path")
    return imports.join(index, F.upper("stem") == F.col("key")).groupBy("src", "stem").agg(F.min("path").alias("dst"))


@register("files_by_name", "WITH " + B.files_sql() + " SELECT f.doc_id, count(*) AS found FROM files f JOIN files g ON upper(f.name) = upper(g.name) GROUP BY f.doc_id")
def files_by_name(spark, sf_dir):
    files = B.files(spark, sf_dir).select("doc_id", F.upper("name").alias("key"))
    counts = files.groupBy("key").agg(F.count("*").alias("found"))
    return files.join(counts, "key").select("doc_id", "found")


@register("html_refs", """SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]+)"', 1)) AS target, 'Link' AS rel FROM pages
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<script[^>]*src="([^"]+)"', 1)), 'ScriptReference' FROM pages
 UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<link[^>]*href="([^"]+)"', 1)), 'StyleReference' FROM pages""")
def html_refs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    kinds = [("Link", '<a[^>]*href="([^"]+)"'), ("ScriptReference", '<script[^>]*src="([^"]+)"'), ("StyleReference", '<link[^>]*href="([^"]+)"')]
    of = lambda rel: lambda t: F.struct(t.alias("target"), F.lit(rel).alias("rel"))
    hits = F.concat(*[F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(1)), of(r)) for r, p in kinds])
    return pages.select("page_id", F.explode(hits).alias("h")).select("page_id", "h.target", "h.rel")


@register("workspace_totals", FILES + f""" SELECT count(*) AS files, sum(len(string_split(content, chr(10))))::BIGINT AS lines, sum({S.token_estimate('content')})::BIGINT AS tokens,
 count(DISTINCT {S.mapped('ext', tables.LANGUAGE_BY_EXT, 'Source')}) AS languages, (SELECT sum(least(12, len(types) + len(functions)))::BIGINT FROM sym s JOIN files f USING (path) WHERE {S.graph_source('path')}) AS symbols
 FROM files WHERE {S.graph_source('path')}""")
def workspace_totals(spark, sf_dir):
    files = B.files(spark, sf_dir).where(filters.graph_source(F.col("path")))
    one = files.select(T.line_count(F.col("content")).alias("l"), T.token_estimate(F.col("content")).alias("t"), T.language(F.col("ext")).alias("lang"), X.declared_types(F.col("content")).alias("types"), "content")
    one = one.select("l", "t", "lang", F.size(X.symbols(F.col("types"), X.declared_functions(F.col("content"), F.col("types")))).alias("s"))
    return one.agg(F.count("*").alias("files"), F.sum("l").alias("lines"), F.sum("t").alias("tokens"), F.countDistinct("lang").alias("languages"), F.sum("s").alias("symbols"))


@register("cluster_rollup", "WITH " + B.files_sql() + f""" SELECT {S.cluster('path')} AS cluster, count(*) AS files, sum(len(string_split(content, chr(10))))::BIGINT AS lines, min(path) AS first_path
 FROM files WHERE {S.graph_source('path')} GROUP BY 1""")
def cluster_rollup(spark, sf_dir):
    files = B.files(spark, sf_dir).where(filters.graph_source(F.col("path")))
    return files.select(T.cluster_name(F.col("path")).alias("cluster"), T.line_count(F.col("content")).alias("l"), "path").groupBy("cluster").agg(F.count("*").alias("files"), F.sum("l").alias("lines"), F.min("path").alias("first_path"))
