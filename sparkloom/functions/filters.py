"""File filters: generated, test, asset and configuration files, globs and their precedence."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables
from .text import any_of, extension, file_name


@dataclass(frozen=True)
class FilterConfig:
    """What a selection leaves out; the defaults are the tool's."""

    excluded_dirs: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = ()
    include_globs: tuple[str, ...] = ()
    include_generated: bool = False
    include_tests: bool = False
    include_assets: bool = False
    include_config: bool = False
    max_depth: int | None = None


def _dirs(lower: Column, dirs: list[str]) -> Column:
    return any_of([lower.contains(d) | lower.startswith(d.lstrip("/")) for d in dirs])


def is_generated(path: Column, content: Column) -> Column:
    """Lock files, build folders, generated suffixes, or a mark in the first 500 characters."""
    lower, head = F.lower(path), F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 500))
    return (
        F.lower(file_name(path)).isin(tables.LOCK_FILES)
        | _dirs(lower, tables.GENERATED_DIRS)
        | any_of([lower.endswith(s) for s in tables.GENERATED_SUFFIXES])
        | any_of([head.contains(m) for m in tables.GENERATED_MARKS])
    )


def is_test(path: Column) -> Column:
    lower = F.lower(path)
    name = file_name(lower)
    return _dirs(lower, tables.TEST_DIRS) | any_of([lower.endswith(s) for s in tables.TEST_SUFFIXES]) | (name.startswith("test_") & name.endswith(".py")) | name.endswith("_test.py")


def is_asset(path: Column) -> Column:
    return extension(path).isin(tables.ASSET_EXTS)


def is_config(path: Column) -> Column:
    name = F.lower(file_name(path))
    return extension(path).isin(tables.CONFIG_EXTS) | any_of([name.startswith(p) for p in tables.CONFIG_PREFIXES])


def glob_regex(pattern: str) -> str:
    """``**`` crosses folders, ``*`` does not, all else is literal."""
    parts = re.split(r"(\*\*|\*)", pattern.replace("\\", "/"))
    return "^(?i)" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + r"\z"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def exclusion_reason(path: Column, content: Column, is_root: Column, depth: Column, config: FilterConfig) -> Column:
    """The first rule that leaves a file out, or null where it is allowed."""
    none = F.lit(None).cast("string")
    dirs = [d.replace("\\", "/").strip("/") for d in config.excluded_dirs]
    out = F.when(is_root, none)
    out = out.when(any_of([path.contains(f"/{d}/") | path.startswith(f"{d}/") for d in dirs]), "ExcludedNamespace")
    out = out.when(any_of([matches_glob(path, g) for g in config.exclude_globs]), "ExcludeGlob")
    if config.include_globs:
        out = out.when(~any_of([matches_glob(path, g) for g in config.include_globs]), "ExcludeGlob")
    if not config.include_generated:
        out = out.when(is_generated(path, content), "GeneratedFileExcluded")
    if not config.include_tests:
        out = out.when(is_test(path), "TestFileExcluded")
    if not config.include_assets:
        out = out.when(is_asset(path), "AssetExcluded")
    if not config.include_config:
        out = out.when(is_config(path), "ConfigurationFileExcluded")
    if config.max_depth is not None:
        out = out.when(depth > config.max_depth, "MaxDepth")
    return out.otherwise(none)


def is_test_path(path: Column) -> Column:
    """Graph scans skip test and fixture segments, test names and generated maps."""
    upper = F.upper(path)
    segment = F.exists(F.split(upper, "/"), lambda p: p.isin([s.upper() for s in tables.TEST_SEGMENTS]))
    return segment | upper.contains(".TEST.") | upper.contains(".SPEC.") | upper.endswith("-CONTEXT.MD") | upper.endswith("-KNOWLEDGE-GRAPH.MD")


def is_ignored_path(path: Column) -> Column:
    return F.exists(F.slice(F.split(F.upper(path), "/"), 1, F.size(F.split(path, "/")) - 1), lambda p: p.isin([d.upper() for d in tables.IGNORED_DIRS]))


def is_noise(path: Column) -> Column:
    """Changes that a commit message leaves out."""
    upper = F.upper(path)
    return upper.endswith("-CONTEXT.MD") | upper.endswith(".VSIX") | F.exists(F.split(upper, "/"), lambda p: p.isin([d.upper() for d in tables.NOISE_SEGMENTS]))


def is_git_source(path: Column) -> Column:
    return extension(path).isin(tables.SOURCE_EXTS) & ~is_ignored_path(path) & ~F.upper(path).endswith("-CONTEXT.MD")


def graph_source(path: Column, include_tests: bool = False) -> Column:
    upper = F.upper(path)
    ok = extension(path).isin(tables.SOURCE_EXTS) & ~any_of([upper.endswith(s.upper()) for s in tables.GRAPH_SKIPPED_SUFFIXES])
    return ok if include_tests else ok & ~is_test_path(path)


def containment_error(path: Column) -> Column:
    """Why a path relative to a workspace must not be read: OutsideWorkspace, GitInternal, or null.

    ``.`` and ``..`` are resolved first; a null path has no error.
    """
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    # A path is outside as soon as a step up finds no folder above it but the workspace itself.
    step = lambda kept, p: F.when(p != "..", F.concat(kept, F.array(p))).when((F.size(kept) > 0) & (F.element_at(kept, -1) != ".."), F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(p)))
    clean = F.aggregate(parts, F.array().cast("array<string>"), step)
    outside = path.rlike(r"^([/\\]|[A-Za-z]:)") | F.coalesce(F.get(clean, F.lit(0)) == "..", F.lit(False))
    return F.when(outside, "OutsideWorkspace").when(F.exists(clean, lambda p: F.lower(p) == ".git"), "GitInternal")


def is_visible(view: str, search: str, path: Column, symbols: Column, god: Column, modified: Column, in_cycle: Column, cluster: Column) -> Column:
    """Whether a view of the graph shows a node: ``all``, ``god``, ``modified``, ``cycle`` or ``cluster:name``, and a search in its path and symbols."""
    shown = {"god": god, "modified": modified, "cycle": in_cycle}.get(view, F.lit(True))
    if view.startswith("cluster:"):
        shown = cluster == view.removeprefix("cluster:")
    q = search.lower()
    return shown if not q else shown & (F.lower(path).contains(q) | F.coalesce(F.exists(symbols, lambda s: F.lower(s).contains(q)), F.lit(False)))
