"""Diff statistics, symbol sets and commit messages from lines of diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import tables
from sparkloom.functions import text as T
from sparkloom.sources.shared import materialise

#: Symbol, hunk and fix patterns.
SYMBOL = (
    r"(?:^(?:\s|public|private|protected|internal|export|async|static|virtual|override|abstract|sealed|partial|default)*+(?:class|interface|struct|enum|record|function|def|fn|func|trait|impl|type)\s+([A-Za-z_][A-Za-z0-9_]*))"
    r"|(?:^\s*(?:public|private|protected|internal|static|async|virtual|override)\s+[A-Za-z0-9_<>,\.\[\]\?\s]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\()"
    r"|(?:^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_][A-Za-z0-9_]*)\s*=>)"
)
HUNK = r"^@@\s+-[0-9]+(?:,[0-9]+)?\s+\+[0-9]+(?:,[0-9]+)?\s+@@\s*(.*)\z"
#: How each line begins that ``SYMBOL`` matches: it is tried on such lines only, which are few.
STARTS = r"^\s*+(?:public|private|protected|internal|export|async|static|virtual|override|abstract|sealed|partial|default|class|interface|struct|enum|record|function|def|fn|func|trait|impl|type|const|let|var)"
FIX = r"(?i)(?:^|[^\p{L}\p{Mn}\p{Nd}\p{Pc}])(?:try|catch|NullReference|ArgumentNullException|fallback|fix|bug)(?:[^\p{L}\p{Mn}\p{Nd}\p{Pc}]|\z)|(?:!==?\s*null|===?\s*null|\?\.)"


def symbol(line: Column) -> Column:
    """The declared name on a line that is no keyword, or null."""
    names = [F.regexp_extract(line, SYMBOL, g) for g in (1, 2, 3)]
    good = [F.when((n != "") & ~n.isin(tables.DIFF_KEYWORDS), n) for n in names]
    return F.when(line.rlike(STARTS), F.coalesce(*good))


def parsed(lines: DataFrame) -> DataFrame:
    """(path, status, kind, symbol, fix): kind is add, del, hunk or null; headers are dropped."""
    line = F.col("line")
    body = lines.where(~(line.startswith("+++") | line.startswith("---") | line.startswith("diff --git") | line.startswith("index ")) & (line != ""))
    hunk = F.regexp_extract(line, HUNK, 1)
    kind = F.when(line.rlike(HUNK), "hunk").when(line.startswith("+"), "add").when(line.startswith("-"), "del")
    text = F.when(F.col("kind") == "hunk", F.trim(hunk)).otherwise(F.substring(line, 2, 1_000_000_000))
    return body.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "status", "kind", symbol(text).alias("symbol"), ((F.col("kind") == "add") & text.rlike(FIX)).alias("fix"))


def stats(lines: DataFrame) -> DataFrame:
    """(path, status, insertions, deletions, fixes)."""
    p = parsed(lines)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    return p.groupBy("path", "status").agg(n(F.col("kind") == "add").alias("insertions"), n(F.col("kind") == "del").alias("deletions"), n(F.col("fix")).alias("fixes"))


def symbol_sets(lines: DataFrame) -> DataFrame:
    """(path, added, modified, removed): a symbol added and removed is modified; one added is not modified."""
    s = parsed(lines).where("symbol IS NOT NULL")
    flags = s.groupBy("path", "symbol").agg(*[F.max(F.col("kind") == k).alias(k) for k in ("add", "del", "hunk")])
    kind = F.when(F.col("add") & ~F.col("del"), "added").when(F.col("del") & ~F.col("add") & ~F.col("hunk"), "removed").when(F.col("add") & F.col("del"), "modified").when(F.col("del"), "both").otherwise("modified")
    kinds = flags.withColumn("kind", kind)
    pick = lambda *ks: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*ks), F.col("symbol"))))
    return kinds.groupBy("path").agg(pick("added").alias("added"), pick("modified", "both").alias("modified"), pick("removed", "both").alias("removed"))


def _ends(path: Column, *suffixes: str) -> Column:
    return T.any_of([F.upper(path).endswith(s.upper()) for s in suffixes])


def commit_type(changes: DataFrame, *keys: str) -> DataFrame:
    """The type of each group of (path, status, n_added, fixes): docs, test, style, chore, feat, fix or refactor."""
    p = F.col("path")
    up = F.upper(p)
    docs = _ends(p, ".md", ".txt") | up.startswith("DOCS/")
    tests = up.startswith("TESTS/") | up.startswith("TEST/") | up.contains(".TEST.") | up.contains(".SPEC.") | _ends(p, "Tests.cs")
    style, chore = _ends(p, ".css", ".scss", ".sass", ".svg"), _ends(p, ".json", ".csproj", ".sln", ".yml", ".yaml", ".toml")
    g = changes.groupBy(*keys).agg(*[F.bool_and(c).alias(n) for n, c in (("d", docs), ("t", tests), ("s", style), ("c", chore))], F.bool_or(F.col("status") == "Added").alias("a"), F.sum("n_added").alias("n"), F.sum("fixes").alias("f"))
    kind = F.when(F.col("d"), "docs").when(F.col("t"), "test").when(F.col("s"), "style").when(F.col("c"), "chore").when(F.col("a") | (F.col("n") > 0), "feat").when(F.col("f") >= 2, "fix").otherwise("refactor")
    return g.select(*keys, kind.alias("type"))


def scope_votes(changes: DataFrame, *keys: str) -> DataFrame:
    """(keys, scope): a single file's short stem, else the most voted folder with half the files' votes.

    Ties keep the folder met first by path and place.
    """
    files = changes.groupBy(*keys).agg(F.count("*").alias("files"), F.min("path").alias("only"))
    segs = changes.select(*keys, "path", F.posexplode(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)).alias("pos", "seg")).where((F.col("seg") != "") & ~F.lower("seg").isin(tables.GENERIC_DIRS))
    votes = segs.groupBy(*keys, F.lower("seg").alias("seg")).agg(F.count("*").alias("votes"), F.min(F.struct("path", "pos")).alias("first"))
    top = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), "first", "seg")).alias("m")).select(*keys, F.col("m.seg").alias("seg"), (-F.col("m.v")).alias("votes"))
    own = T.stem(F.col("only"))
    single = (F.col("files") == 1) & (F.length(own) > 0) & (F.length(own) <= 20) & ~F.lower(own).isin("program", "index")
    voted = F.when(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("files") / 2)), F.col("seg"))
    return files.join(top, list(keys), "left").select(*keys, F.when(single, F.lower(own)).otherwise(voted).alias("scope"))


def name_status(lines: DataFrame) -> DataFrame:
    """(path, status) of ``git diff --name-status`` lines: the last column is the path."""
    parts = F.split("line", "\t")
    first = F.substring(F.element_at(parts, 1), 1, 1)
    status = F.when(first == "A", "Added").when(first == "D", "Deleted").when(first == "R", "Renamed").otherwise("Modified")
    return lines.where(F.size(parts) >= 2).select(T.normalise_path(F.trim(F.element_at(parts, -1))).alias("path"), status.alias("status"))


def name_list(lines: DataFrame) -> DataFrame:
    """Distinct paths of a list: trimmed, unquoted, with forward slashes."""
    p = T.normalise_path(F.trim(F.regexp_replace(F.trim("line"), '^"|"$', "")))
    return lines.select(p.alias("path")).where("path <> ''").distinct()


def untracked(found: DataFrame, tracked: DataFrame) -> DataFrame:
    """Paths of ``found`` that no row of ``tracked`` has, case aside."""
    known = tracked.select(F.upper(T.normalise_path(F.col("path"))).alias("_key")).distinct()
    own = found.select(T.normalise_path(F.col("path")).alias("path")).distinct()
    return own.join(known, F.upper("path") == F.col("_key"), "left_anti")


def untracked_diff(files: DataFrame) -> DataFrame:
    """(path, line_no, line): every line of an untracked file as added."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), F.concat(F.lit("+"), "text").alias("line"))


def snippets(diffs: DataFrame, each: int = 2000, total: int = 12000) -> DataFrame:
    """(path, snippet) for a model: at most ``each`` characters a file while fewer than ``total`` are used.

    A file takes a character at least, so only the first ``total`` files of a set are ordered.
    """
    w = Window.partitionBy("workspace").orderBy("path")
    cut = diffs.where(F.length("diff") > 0).withColumn("snippet", F.substring("diff", 1, each)).withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= total)
    before = F.coalesce(F.sum(F.length("snippet")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_before", before).where(F.col("_before") < total).select("workspace", "path", "snippet")


def summaries(lines: DataFrame) -> DataFrame:
    """(path, status, insertions, deletions, fixes, added, modified, removed, n_added): ``stats`` and ``symbol_sets`` of each file in one pass over the lines.

    Written at once: what is made of it reads it several times, and each would parse all lines again.
    """
    p = parsed(lines)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kinds = [F.max(F.col("kind") == k).alias(k) for k in ("add", "del", "hunk")]
    by_symbol = p.groupBy("path", "status", "symbol").agg(n(F.col("kind") == "add").alias("i"), n(F.col("kind") == "del").alias("d"), n(F.col("fix")).alias("f"), *kinds)
    known = F.col("symbol").isNotNull()
    pick = lambda c: F.array_sort(F.collect_list(F.when(known & c, F.col("symbol"))))
    add, gone, hunk = F.col("add"), F.col("del"), F.col("hunk")
    out = by_symbol.groupBy("path", "status").agg(
        F.sum("i").alias("insertions"), F.sum("d").alias("deletions"), F.sum("f").alias("fixes"), pick(add & ~gone).alias("added"), pick((add & gone) | (hunk & ~add)).alias("modified"), pick(gone & ~add).alias("removed")
    )
    return materialise(out.withColumn("n_added", F.size("added")))


def _listed(symbols: Column, most: int) -> Column:
    return F.array_join(F.slice(symbols, 1, most), ", ")


def draft(changes: DataFrame, lang: str = "en", *keys: str) -> DataFrame:
    """(keys, path, bullet): a line of a commit message's body for each changed file; a body is its group's lines by path.

    ``changes``: as ``summaries`` gives, with the keys of a group.  A line tells what happened to the file, up to
    four added, four modified and three removed symbols, and the lines that came and went.
    """
    verbs = tables.VERBS.get(lang, tables.VERBS["en"])
    first_up = lambda v: v[:1].upper() + v[1:]
    status = F.col("status")
    verb = F.when(status == "Added", first_up(verbs[0])).when(status == "Deleted", first_up(verbs[2])).when(status == "Renamed", first_up(verbs[3])).otherwise(first_up(verbs[1]))
    told = lambda c, v, most: F.when(F.size(c) > 0, F.concat(F.lit(f"{verbs[v]} "), _listed(F.col(c), most)))
    details = F.concat_ws("; ", told("added", 0, 4), told("modified", 1, 4), told("removed", 2, 3))
    count = F.when((F.col("insertions") > 0) | (F.col("deletions") > 0), F.format_string(" (+%d/-%d)", "insertions", "deletions")).otherwise("")
    named = F.when(details != "", F.concat(T.file_name(F.col("path")), F.lit(": "), details)).otherwise(F.col("path"))
    return changes.select(*keys, "path", F.concat(F.lit("- "), verb, F.lit(" "), named, count).alias("bullet"))


def _first_two(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, name): the first two distinct values of each group of (keys, value, at), by ``at``.

    A rank of at most two is kept in each task before groups meet.
    """
    met = rows.groupBy(*keys, "value").agg(F.min("at").alias("at"))
    few = met.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "value"))).where("_n <= 2")
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("_f")).select(*keys, F.transform("_f", lambda x: x["value"]).alias(name))


def subjects(changes: DataFrame, lang: str = "en", *keys: str) -> DataFrame:
    """(keys, subject, files, insertions, deletions): the first line of each group's commit message, 76 characters at most.

    A single file is told by its first two added or modified symbols.  Of several, the first two added files (or
    symbols, where none was added), the first two modified files and the first two deleted ones make up to two parts.
    """
    add, update, remove, _, within, conj = tables.VERBS.get(lang, tables.VERBS["en"])
    one = lambda status: changes.where(F.col("status") == status).select(*keys, T.stem(F.col("path")).alias("value"), F.struct("path", F.lit(0).alias("pos")).alias("at"))
    symbols = lambda c: changes.select(*keys, "path", F.posexplode(c).alias("pos", "value")).select(*keys, "value", F.struct("path", "pos").alias("at"))
    g = changes.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.min_by(F.struct("path", "status", "added", "modified"), "path").alias("head"))
    for name, rows in (("new", one("Added")), ("old", one("Modified")), ("gone", one("Deleted")), ("sym", symbols("added")), ("mod", symbols("modified"))):
        g = g.join(_first_two(rows, name, *keys), list(keys), "left")
    g = g.join(commit_type(changes, *keys), list(keys)).join(scope_votes(changes, *keys), list(keys))
    head, file = F.col("head"), T.file_name(F.col("head.path"))
    with_symbols = lambda v, c: F.concat(F.lit(f"{v} "), _listed(head[c], 2), F.lit(f" {within} "), file)
    has = lambda c: F.size(head[c]) > 0
    single = (
        F.when((head["status"] == "Added") & has("added"), F.concat(F.lit(f"{add} "), file, F.lit(" ("), _listed(head["added"], 2), F.lit(")")))
        .when(head["status"] == "Added", F.concat(F.lit(f"{add} "), file))
        .when(head["status"] == "Deleted", F.concat(F.lit(f"{remove} "), file))
        .when(has("added"), with_symbols(add, "added"))
        .when(has("modified"), with_symbols(update, "modified"))
        .otherwise(F.concat(F.lit(f"{update} "), file))
    )
    part = lambda v, c: F.concat(F.lit(f"{v} "), F.array_join(F.col(c), ", "))
    first = F.coalesce(part(add, "new"), part(add, "sym"))
    second = F.coalesce(part(update, "old"), F.when(first.isNull(), part(update, "mod")))
    third = F.when(first.isNull() | second.isNull(), part(remove, "gone"))
    several = F.concat_ws(f" {conj} ", first, second, third)
    action = F.when(F.col("files") == 1, single).when(several != "", several).otherwise(F.format_string(f"{update} %d files", "files"))
    title = F.concat("type", F.when(F.col("scope").isNotNull(), F.concat(F.lit("("), "scope", F.lit(")"))).otherwise(""), F.lit(": "), action)
    return g.select(*keys, T.subject(title).alias("subject"), "files", "insertions", "deletions")
