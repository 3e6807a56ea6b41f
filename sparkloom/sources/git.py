"""Changes of a git repository as a Spark data source.

The driver lists what changed with one git process; each partition is a range of
changed paths, and its task reads their lines with one process of its own.  The repository lies in a
folder that driver and executors share, as a workspace on a cluster does.
"""

from __future__ import annotations

import subprocess
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STATUS = {"A": "Added", "D": "Deleted", "R": "Renamed"}
SCHEMA = "path string, status string, untracked boolean, line_no int, line string"
#: Paths of one range.
RANGE = 200


def git_root(path: str) -> str | None:
    """The closest folder at or above ``path`` that holds ``.git`` (a folder, or a file in a linked tree)."""
    start = Path(path).resolve()
    for p in (start, *start.parents):
        if (p / ".git").exists():
            return str(p)
    return None


def run(root: str, *args: str, seconds: int = 15) -> bytes | None:
    """Output of a git command, or None where it fails or takes too long."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


@dataclass(frozen=True)
class Plan:
    """Arguments of the git commands whose output is the scope's diff, in turn, and whether they read a log."""

    commands: tuple[tuple[str, ...], ...]
    log: bool = False
    only: str | None = None


def plan(root: str, scope: str, target: str | None = None, count: int = 1) -> Plan:
    """How a scope is read.

    all: against HEAD, or staged then unstaged where there is no commit yet, with untracked files.
    staged, unstaged.  branch: since the common ancestor with ``target`` (main), or against it where there
    is none.  last: the last ``count`` commits, by their log where there are no more.  single: the file ``target``.
    """
    both = (("diff", "--cached"), ("diff",))
    if scope in ("all", "single"):
        only = None
        if scope == "single":
            if not target:
                raise ValueError("scope single needs a file as target")
            only = str(Path(target).resolve().relative_to(root)) if Path(target).is_absolute() else target
        return Plan((("diff", "HEAD"),) if run(root, "rev-parse", "--verify", "HEAD") else both, only=only)
    if scope in ("staged", "unstaged"):
        return Plan((both[0 if scope == "staged" else 1],))
    if scope == "branch":
        base = (target or "main").strip()
        near = run(root, "merge-base", base, "HEAD") is not None
        return Plan((("diff", f"{base}...HEAD" if near else f"{base}..HEAD"),))
    if scope == "last":
        n = max(1, count)
        if run(root, "rev-parse", "--verify", f"HEAD~{n}") is not None:
            return Plan((("diff", f"HEAD~{n}..HEAD"),))
        return Plan((("log", "-n", str(n), "--root"),), log=True)
    raise ValueError(f"unknown scope {scope}")


def _entries(raw: bytes) -> list[tuple[str, str, str]]:
    """(status, old path, path) of a raw listing with NULs."""
    out, parts = [], iter(raw.split(b"\0"))
    for head in parts:
        if head[:1] != b":":
            continue
        letter = head.split(b" ")[-1][:1].decode()
        old = next(parts).decode("utf-8", "replace")
        new = next(parts).decode("utf-8", "replace") if letter in "RC" else old
        out.append((letter, old, new))
    return out


def _listing(root: str, p: Plan) -> list[tuple[str, str, str]]:
    found: dict[str, tuple[str, str, str]] = {}
    for command in p.commands:
        shape = ["--format=", "--raw", "-z", "-M"] if p.log else ["--raw", "-z", "-M"]
        raw = run(root, *command, *shape, *(["--", p.only] if p.only else []))
        for e in _entries(raw or b""):
            if p.log or e[2] not in found:  # a log starts with the newest commit, and the oldest tells how a file came
                found[e[2]] = e
    return [found[k] for k in sorted(found, key=lambda x: (x.upper(), x))]


def _untracked(root: str, only: str | None) -> list[str]:
    raw = run(root, "ls-files", "--others", "--exclude-standard", "-z", *(["--", only] if only else []))
    return sorted((x.decode("utf-8", "replace") for x in (raw or b"").split(b"\0") if x), key=lambda x: (x.upper(), x))


def _blocks(data: bytes) -> list[tuple[str, list[str]]]:
    """(path, lines) of a raw listing followed by its patches, which come in the same order."""
    if b"\0\0" not in data:
        return []
    raw, patches = data[data.find(b":") :].split(b"\0\0", 1)
    text = "\n" + patches.decode("utf-8", "replace").rstrip("\0")
    found = [("diff --git " + b).rstrip("\n").split("\n") for b in text.split("\ndiff --git ")[1:]]
    return [(e[2], lines) for e, lines in zip(_entries(raw + b"\0"), found)]


@dataclass
class Range(InputPartition):
    """Changed paths of one task: (path, old path, status), and untracked paths."""

    changed: list[tuple[str, str, str]] = field(default_factory=list)
    fresh: list[str] = field(default_factory=list)


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        start = options.get("path", ".")
        self.scope = options.get("scope", "all")
        target = options.get("target")
        self.root = git_root(target if self.scope == "single" and target and Path(target).is_absolute() else start)
        if self.root is None:
            raise ValueError(f"no git repository at or above {start}")
        self.plan = plan(self.root, self.scope, target, int(options.get("count", 1)))
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        changed = [(new, old, STATUS.get(letter, "Modified")) for letter, old, new in _listing(self.root, self.plan)]
        known = {c[0] for c in changed}
        fresh = [p for p in _untracked(self.root, self.plan.only) if p not in known] if self.scope in ("all", "single") else []
        out = [Range(changed=changed[i : i + self.range]) for i in range(0, len(changed), self.range)]
        out += [Range(fresh=fresh[i : i + self.range]) for i in range(0, len(fresh), self.range)]
        return out or [Range()]

    def read(self, partition: Range):
        if partition.changed:
            status = {path: s for path, _, s in partition.changed}
            names = sorted({n for path, old, _ in partition.changed for n in (path, old)})
            lines: dict[str, list[str]] = {}
            for command in self.plan.commands:
                mark = uuid.uuid4().hex
                shape = [f"--format=format:{mark}"] if self.plan.log else []
                out = run(self.root, *command, *shape, "--patch-with-raw", "-z", "-M", "--", *names, seconds=600) or b""
                for part in out.split(mark.encode()) if self.plan.log else [out]:
                    for path, block in _blocks(part):
                        lines.setdefault(path, []).extend(block)
            for path, s in status.items():
                for n, line in enumerate(lines.get(path, [])):
                    yield path, s, False, n + 1, line
        for path in partition.fresh:
            for n, line in enumerate(_as_added(self.root, path)):
                yield path, "Added", True, n + 1, line


def _as_added(root: str, path: str):
    """The lines of a diff that would add an untracked file."""
    yield f"diff --git a/{path} b/{path}"
    yield "new file mode 100644"
    yield "--- /dev/null"
    yield f"+++ b/{path}"
    try:
        text = (Path(root) / path).read_bytes().decode("utf-8", "replace")
    except OSError:
        yield "@@ -0,0 +1,1 @@"
        yield "+[New untracked file]"
        return
    rows = text.splitlines()
    yield f"@@ -0,0 +1,{len(rows)} @@"
    for row in rows:
        yield f"+{row}"


class GitSource(DataSource):
    """``spark.read.format("gitdiff")``: lines of the diff of each changed file.

    Options: path (in or below the repository), scope (``plan``), target, count, range (paths of a task).
    """

    @classmethod
    def name(cls) -> str:
        return "gitdiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))


def changes(spark: SparkSession, path: str, scope: str = "all", *, target: str | None = None, count: int = 1, supported: bool = False) -> DataFrame:
    """(path, status, untracked, line_no, line) of a scope's changes.

    ``supported`` keeps source files outside generated and dependency folders only.  A repository
    without changes gives no rows; a path outside any repository is an error.
    """
    from sparkloom.functions import filters, tables
    from sparkloom.functions.text import extension

    spark.dataSource.register(GitSource)
    options = {"path": path, "scope": scope, "count": str(count)} | ({"target": target} if target else {})
    out = spark.read.format("gitdiff").options(**options).load()
    if supported:
        p = F.col("path")
        out = out.where(extension(p).isin(tables.SOURCE_EXTS) & ~filters.is_ignored_path(p) & ~F.lower(p).endswith("-context.md"))
    return out
