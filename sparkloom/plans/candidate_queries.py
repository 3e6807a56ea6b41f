"""Queries over the assembly of candidates, views of the graph and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import filters, tables
from sparkloom.functions import text as T
from sparkloom.operators import candidates as C
from sparkloom.operators import graph as G
from sparkloom.sources import bindings as B

from . import graph_queries as GQ
from . import sql as S
from .registry import register

_BOTH = GQ._IMPORTANCE.replace("WITH RECURSIVE ", "WITH RECURSIVE " + B.files_sql() + ", ", 1)
_REASON = f"""CASE WHEN doc_id = 0 THEN NULL WHEN {S.is_generated("path", "content")} THEN 'GeneratedFileExcluded' WHEN {S.is_test("path")} THEN 'TestFileExcluded'
 WHEN ext IN {S.listed(tables.ASSET_EXTS)} THEN 'AssetExcluded' WHEN {S.is_config("path")} THEN 'ConfigurationFileExcluded' WHEN depth > 12 THEN 'MaxDepth' END"""


def _nodes(spark, sf_dir):
    files = B.files(spark, sf_dir).select(F.col("doc_id").alias("id"), "path")
    return files.join(GQ._importance(spark, sf_dir), "id", "left")


@register("candidate_files", _BOTH + f""", par AS (SELECT dst AS doc_id, count(*) AS n_parents FROM e WHERE src IN (SELECT id FROM nodes) GROUP BY dst),
 c AS (SELECT f.*, coalesce(imp.depth, 99)::INT AS depth, coalesce(imp.importance, 0)::BIGINT AS importance, coalesce(n_parents, 0)::BIGINT AS n_parents FROM files f LEFT JOIN imp ON imp.id = f.doc_id LEFT JOIN par ON par.doc_id = f.doc_id),
 r AS (SELECT *, {_REASON} AS reason FROM c), l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line FROM r WHERE reason IS NULL), sec AS (SELECT doc_id, count(*) AS secrets FROM l WHERE {S.secret_category('line')} IS NOT NULL GROUP BY doc_id)
 SELECT path, r.doc_id = 0 AS is_root, ext IN ('.html', '.scss', '.css') AS is_companion, depth, importance, reason, n_parents, coalesce(secrets, 0)::BIGINT AS secrets FROM r LEFT JOIN sec ON sec.doc_id = r.doc_id""")  # fmt: skip
def candidate_files(spark, sf_dir):
    """What a question that starts from document 0 chooses from."""
    nodes = G.materialise(_nodes(spark, sf_dir))
    return C.assemble(B.files(spark, sf_dir), nodes, B.edges(spark, sf_dir), nodes.where("id = 0"), filters.FilterConfig(max_depth=12))


@register("candidate_parents", GQ.W.replace("WITH RECURSIVE ", "WITH RECURSIVE " + B.files_sql() + ", ", 1) + " SELECT b.path, a.path AS parent FROM e JOIN files a ON a.doc_id = src JOIN files b ON b.doc_id = dst")
def candidate_parents(spark, sf_dir):
    return C.parents(B.files(spark, sf_dir).select(F.col("doc_id").alias("id"), "path"), B.edges(spark, sf_dir))


_ASKED = "CASE doc_id % 7 WHEN 0 THEN '../' || path WHEN 1 THEN 'a/../../' || path WHEN 2 THEN '.GIT/' || name WHEN 3 THEN 'a/./.git/' || name WHEN 4 THEN '/etc/' || name WHEN 5 THEN '.git/../' || path ELSE path END"


@register("path_containment", "WITH " + B.files_sql() + f" SELECT doc_id, {_ASKED} AS asked, CASE WHEN doc_id % 7 IN (0, 1, 4) THEN 'OutsideWorkspace' WHEN doc_id % 7 IN (2, 3) THEN 'GitInternal' END AS error FROM files")
def path_containment(spark, sf_dir):
    asked = B.files(spark, sf_dir).select("doc_id", F.expr(_ASKED).alias("asked"))
    return asked.withColumn("error", filters.containment_error(F.col("asked")))


@register("graph_view", "WITH " + B.files_sql() + """, n AS (SELECT doc_id, path, split_part(path, '/', 2) || '/' || split_part(path, '/', 3) AS cluster FROM files)
 SELECT doc_id, doc_id % 10 = 0 AND (contains(lower(path), 'doc1') OR contains('type' || (doc_id % 211), 'doc1')) AS god, doc_id % 9 = 0 AS modified, contains(lower(path), 'e21') OR contains('type' || (doc_id % 211), 'e21') AS found, cluster = 'src0/en' AS cluster FROM n""")
def graph_view(spark, sf_dir):
    """What four views of the graph show."""
    f = B.files(spark, sf_dir)
    symbols = F.array(F.concat(F.lit("Type"), (F.col("doc_id") % 211).cast("string")))
    see = lambda view, search: filters.is_visible(view, search, F.col("path"), symbols, F.col("doc_id") % 10 == 0, F.col("doc_id") % 9 == 0, F.lit(False), T.cluster_name(F.col("path")))
    return f.select("doc_id", see("god", "DOC1").alias("god"), see("modified", "").alias("modified"), see("all", "E21").alias("found"), see("cluster:src0/en", "").alias("cluster"))
