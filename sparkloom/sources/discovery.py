"""Workspace and project roots of files, from the names in the folders above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import any_of, file_name

#: Names that mark a repository, a project, and a repository of several packages.
REPOSITORY = [".git", ".sln", ".slnx", "go.work"]
PROJECT = [
    "directory.build.props", "directory.packages.props", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "tsconfig.json",
    "jsconfig.json", "angular.json", "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "pyproject.toml", "setup.py",
    "setup.cfg", "requirements.txt", "pipfile", "poetry.lock", "go.mod",
]
PROJECT_SUFFIXES = [".csproj", ".vbproj", ".fsproj", ".sln", ".slnx"]
MONOREPO = ["pnpm-workspace.yaml", "go.work", "directory.build.props"]


def _folder(path):
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def workspace_roots(entries: DataFrame, boundary: str | None = None) -> DataFrame:
    """(path, workspace_root, project_root, monorepo, packages) of every entry (path, and content where a package file's text is known).

    The project root is the closest folder at or above an entry that holds a project's mark; the
    workspace root is the closest with a repository's mark, else the project root, else the entry's own folder.  With a
    ``boundary`` that folder is the workspace root, folders above it are not looked at, and entries
    outside it are left out.  ``packages`` counts the folders on the way up with a package.json; a monorepo has
    several, or its root says so.  A folder marked by a folder is an entry too, as ``dir/.git``.

    Folders, not files, meet the folders above them: each distinct folder once, by as many rows as it is deep,
    and what a folder's files share is found once.  The many folders below one mark meet it in a join that
    adaptive execution splits, and in partial aggregates.
    """
    inside = entries if boundary is None else entries.where((F.col("path") == boundary) | F.col("path").startswith(boundary + "/"))
    text = F.col("content") if "content" in entries.columns else F.lit(None).cast("string")
    rows = inside.select("path", _folder(F.col("path")).alias("folder"), F.lower(file_name(F.col("path"))).alias("name"), text.alias("content"))
    is_package = F.col("name") == "package.json"
    marks = rows.select(
        F.col("folder").alias("above"),
        F.col("name").isin(REPOSITORY).alias("repo"),
        (F.col("name").isin(PROJECT) | any_of([F.col("name").endswith(s) for s in PROJECT_SUFFIXES])).alias("project"),
        is_package.alias("package"),
        (F.col("name").isin(MONOREPO) | (is_package & F.coalesce(F.col("content").contains('"workspaces"'), F.lit(False)))).alias("many"),
    ).where("repo OR project OR package OR many")
    marks = marks.groupBy("above").agg(*(F.bool_or(c).alias(c) for c in ("repo", "project", "package", "many")))
    folders = rows.select("folder").distinct()
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    least = len(boundary) if boundary else 0
    climbed = folders.select("folder", F.explode(F.array_distinct(ups)).alias("above")).where(F.length("above") >= least)
    depth = F.length("above")
    met = climbed.join(marks, "above").groupBy("folder").agg(
        F.max_by("above", F.when(F.col("repo"), depth)).alias("repository"), F.max_by("above", F.when(F.col("project"), depth)).alias("project_root"), F.count_if("package").alias("packages")
    )
    home = F.lit(boundary) if boundary is not None else F.coalesce("repository", "project_root", "folder")
    found = folders.join(met, "folder", "left").select("folder", home.alias("workspace_root"), "project_root", F.coalesce("packages", F.lit(0)).alias("packages"))
    said = marks.select(F.col("above").alias("workspace_root"), "many")
    found = found.join(said, "workspace_root", "left").select("folder", "workspace_root", "project_root", ((F.col("packages") > 1) | F.coalesce("many", F.lit(False))).alias("monorepo"), "packages")
    return rows.select("path", "folder").join(found, "folder").select("path", "workspace_root", "project_root", "monorepo", "packages")
