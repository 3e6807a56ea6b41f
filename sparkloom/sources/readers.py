"""Files and git changes as DataFrames."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import filters, tables
from sparkloom.functions.text import extension, file_name, stem

from . import git

#: Files and folders that mark a repository, and those that mark a project.
REPO_MARKS = {".git", "go.work"}
REPO_SUFFIXES = (".sln", ".slnx")
PROJECT_MARKS = {"package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "composer.json", "pubspec.yaml", "CMakeLists.txt"}


def workspace(spark: SparkSession, root: str, only_sources: bool = False) -> DataFrame:
    """files(path, name, stem, ext, length, content) under ``root``, ignored folders left out.

    The extension test reads no content: the binary reader prunes the column and
    filters on names before bytes are decoded.  The reader lists no empty files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), r"/*\z", "/")
    rel = F.element_at(F.split(F.col("path"), F.concat(F.lit(r"\Q"), F.regexp_replace(base, "^[a-z]+:/*", "/"), F.lit(r"\E")), 2), -1)
    files = raw.select(rel.alias("path"), "length", "content").where(~filters.is_ignored_path(F.col("path")))
    if only_sources:
        files = files.where(extension(F.col("path")).isin(tables.SOURCE_EXTS))
    p = F.col("path")
    return files.select("path", file_name(p).alias("name"), stem(p).alias("stem"), extension(p).alias("ext"), "length", F.col("content").cast("string").alias("content"))


def graph_files(files: DataFrame) -> DataFrame:
    """Eligible sources; a workspace of nothing but tests keeps every supported file."""
    flagged = files.withColumn("_ok", filters.graph_source(F.col("path")))
    some = flagged.agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("_some"))
    kept = flagged.join(F.broadcast(some)).where(F.col("_ok") | (~F.col("_some") & F.col("ext").isin(tables.SOURCE_EXTS)))  # one row
    return kept.drop("_ok", "_some")


def contained(path: str, root: str) -> str:
    """``path`` relative to ``root``; an error outside it or inside ``.git``."""
    p, r = PurePosixPath(path), PurePosixPath(root)
    parts: list[str] = []
    for x in p.parts:
        if x == "..":
            if parts:
                parts.pop()
        elif x != ".":
            parts.append(x)
    clean = PurePosixPath(*parts) if parts else PurePosixPath("/")
    if r not in (clean, *clean.parents):
        raise ValueError(f"{path} is outside {root}")
    rel = clean.relative_to(r)
    if ".git" in (x.lower() for x in rel.parts):
        raise ValueError(f"{path} is inside .git")
    return str(rel)


def discover(paths: DataFrame) -> DataFrame:
    """(path, root, kind): the nearest folder above each file with a repository mark, else a project mark.

    ``paths``: path of every file and mark, a folder mark as ``dir/.git``.
    """
    name, folder = file_name(F.col("path")), F.regexp_replace("path", r"/?[^/]*\z", "")
    repo = name.isin(list(REPO_MARKS)) | name.endswith(REPO_SUFFIXES[0]) | name.endswith(REPO_SUFFIXES[1])
    marks = paths.select(folder.alias("root"), F.when(repo, 0).when(name.isin(list(PROJECT_MARKS)), 1).alias("rank")).where("rank IS NOT NULL").distinct()
    ups = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("root"))
    near = ups.join(marks, "root").groupBy("path").agg(F.min(F.struct("rank", (-F.length("root")).alias("l"), "root")).alias("m"))
    return paths.select("path").join(near, "path", "left").select("path", F.col("m.root").alias("root"), F.when(F.col("m.rank") == 0, "repository").when(F.col("m.rank") == 1, "project").alias("kind"))


def git_changes(spark: SparkSession, folder: str, scope: str = "all", target: str | None = None, count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(changes(line), diff_lines(path, status, line_no, line)) of a repository; see ``git.plan`` for the scopes."""
    rows = git.changes(spark, folder, scope, target=target, count=count)
    letter = F.when(F.col("status") == "Added", "A").when(F.col("status") == "Deleted", "D").when(F.col("status") == "Renamed", "R").otherwise("M")
    heads = rows.where("line_no = 1").select(F.concat_ws("\t", letter, "path").alias("line"))
    return heads, rows.select("path", "status", "line_no", "line")
