"""Queries over workspaces: roots of the bound files, and the kept index after edits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.operators import adapters as A
from sparkloom.operators.kept import KeptIndex
from sparkloom.sources import bindings as B
from sparkloom.sources import code_bindings as C
from sparkloom.sources import discovery
from sparkloom.sources.shared import root

from .language_queries import _edges
from .registry import register

#: Marks beside the bound files, by doc_id: a repository, packages of two depths, a project.
_MARKS = """SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'src/' || source || '/.git' WHEN 1 THEN 'src/' || source || '/' || lang || '/package.json'
 WHEN 2 THEN 'src/' || source || '/' || lang || '/models/package.json' ELSE 'src/' || source || '/' || lang || '/workers/App.csproj' END AS path FROM {documents} WHERE doc_id % 23 < 4"""

_ROOTS = "WITH " + B.files_sql() + ", marks AS (" + _MARKS.format(documents="documents") + """), every AS (SELECT path FROM files UNION ALL SELECT path FROM marks),
 en AS (SELECT path, array_to_string(string_split(path, '/')[1:-2], '/') AS folder FROM every), mk AS (SELECT path, array_to_string(string_split(path, '/')[1:-2], '/') AS above, split_part(path, '/', -1) AS name FROM marks),
 fo AS (SELECT DISTINCT folder FROM en), met AS (SELECT folder, max(above) FILTER (name = '.git') AS repository, arg_max(above, length(above)) FILTER (name <> '.git') AS project_root, count(DISTINCT above) FILTER (name = 'package.json') AS packages
   FROM fo JOIN mk ON folder = above OR starts_with(folder, above || '/') GROUP BY folder)
 SELECT path, coalesce(repository, project_root, en.folder) AS workspace_root, project_root, coalesce(packages, 0) > 1 AS monorepo, coalesce(packages, 0) AS packages FROM en LEFT JOIN met USING (folder)"""


@register("workspace_roots", _ROOTS)
def workspace_roots(spark, sf_dir):
    """Which workspace and project does each file belong to?"""
    marks = spark.sql(_MARKS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return discovery.workspace_roots(B.files(spark, sf_dir).select("path").unionByName(marks))


_TARGETS = "j % 5 <> 4 AND {t} % 5 <> 4"


@register("kept_edges", _edges(3, *[(t, rel, _TARGETS.format(t=t)) for t, rel in [("t1", "Import"), ("t2", "Import"), ("t3", "Implementation"), ("t4", "Implementation"), ("t5", "Attribute")]]))
def kept_edges(spark, sf_dir):
    """Edges of the Rust files after three updates of a kept index: with half of the texts empty, whole, and with a fifth of the files gone."""
    files = C.code_files(spark, sf_dir, 3)
    number = F.regexp_extract("path", r"r([0-9]+)\.rs", 1).cast("long")
    index = KeptIndex(spark, f"{root(spark)}/kept-{uuid.uuid4().hex}", A.Adapters([a for a in A.DEFAULTS if a.id == "rust"]))
    index.update(files.withColumn("content", F.when(number % 2 == 0, F.col("content"))))
    index.update(files)
    index.update(files.where(number % 5 != 4))
    return index.edges()
