"""Column functions over source text and paths; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

#: What .NET calls a word character; \w and \b differ between engines and are not used.
WORD = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
#: The tokens of a text: runs of small letters, runs of digits, single signs, and runs of capitals that end before a small letter (two or more)
#: or before no word character.  A run is tried at its start only, so a text of nothing but capitals takes one pass.
TOKEN = rf"[a-z]+|[0-9]+|[^\s{WORD}]|(?<![A-Z])[A-Z]++(?:(?<=[A-Z]{{2}})(?=[a-z])|(?![{WORD}]))"


def lookup(key: Column, mapping: dict[str, str], default: str | None) -> Column:
    """The value of ``key`` in a small fixed mapping."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default)) if default is not None else F.element_at(F.create_map(*pairs), key)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def token_matches(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def token_estimate(text: Column) -> Column:
    """Approximate tokens: ceil(1.05 * matches), or by length where nothing matches; 0 for null or empty."""
    by_length = F.ceil(F.length(text) / F.lit(3.7))
    # A lambda over the count, which is used twice and taken once.
    count = F.element_at(F.transform(F.array(token_matches(text)), lambda n: F.when(n > 0, F.ceil(n * F.lit(1.05))).otherwise(by_length)), 1)
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), count)).otherwise(F.lit(0)).cast("long")


def line_count(text: Column) -> Column:
    """Pieces between newlines: a trailing newline adds one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)\z", 1), r"(\.[^.]*)\z", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*\z", "")


def normalise_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def language(ext: Column) -> Column:
    return lookup(ext, tables.LANGUAGE_BY_EXT, "Source")


def fence_language(ext: Column) -> Column:
    return lookup(ext, tables.FENCE_BY_EXT, "text")


def graph_fence_language(ext: Column) -> Column:
    return lookup(ext, tables.GRAPH_FENCE_BY_EXT, "")


def cluster_name(path: Column) -> Column:
    """Up to two directory parts other than ``src``; ``root`` for a bare file."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    dirs = F.slice(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.upper(p) != "SRC"), 1, 2)
    return F.when(F.size(parts) <= 1, "root").when(F.size(dirs) > 0, F.array_join(dirs, "/")).otherwise(F.element_at(parts, 1))


def node_role(name: Column, path: Column, lang: Column, is_god: Column, in_degree: Column, out_degree: Column) -> Column:
    """The first rule that holds names the role."""
    n, p = F.lower(name), F.lower(path)
    starts = lambda *xs: any_of([n.startswith(x) for x in xs])
    has = lambda c, *xs: any_of([c.contains(x) for x in xs])
    return (
        F.when(is_god, "God Node / Core Hub")
        .when(starts("program.", "main.", "index.", "extension."), "Entrypoint")
        .when(n.startswith("i") & (F.length(name) > 2) & F.substring(name, 2, 1).rlike(r"^\p{Lu}") & (lang == "CSharp"), "Interface / Contract")
        .when(has(p, "protocol", "model") | has(n, "types", "dto"), "Model / Protocol")
        .when(has(p, "service", "orchestrator", "manager"), "Service / Orchestrator")
        .when(has(p, "worker", "analyzer", "adapter"), "Analyzer / Worker")
        .when(has(p, "view", "component", "page") | any_of([n.endswith(x) for x in (".tsx", ".jsx", ".vue", ".razor")]), "UI / Component")
        .when((in_degree == 0) & (out_degree == 0), "Standalone / Leaf")
        .when((in_degree > 0) & (out_degree == 0), "Shared Foundation")
        .otherwise("Module")
    )


def fence_length(text: Column) -> Column:
    """Back-ticks of a fence that no run in the text reaches, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r)))
    return F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1)


def safe_fence(text: Column, lang: Column) -> Column:
    fence = F.repeat(F.lit("`"), fence_length(text))
    return F.struct(F.concat(fence, lang).alias("open"), fence.alias("close"))


def output_name(path: Column) -> Column:
    """Kebab-case stem with ``-context.md``."""
    kebab = F.regexp_replace(stem(path), "([a-z0-9])([A-Z])", "$1-$2")
    return F.concat(F.lower(F.translate(kebab, "_.", "--")), F.lit("-context.md"))


def redact(text: Column) -> Column:
    """Replace every secret, category by category in order."""
    for _, pattern in tables.SECRETS:
        text = F.regexp_replace(text, pattern, tables.REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return text


def secret_category(line: Column) -> Column:
    """The first category that the line matches, or null.

    A pattern is tried only on lines with a sign that all its matches hold, which most lines lack.
    """
    hit = lambda name, pattern: any_of([line.contains(s) for s in tables.SECRET_SIGNS[name]]) & line.rlike(pattern)
    out = F.when(hit(*tables.SECRETS[0]), tables.SECRETS[0][0])
    for name, pattern in tables.SECRETS[1:]:
        out = out.when(hit(name, pattern), name)
    return out


def strip_file_prefix(node_id: Column) -> Column:
    return F.regexp_replace(node_id, "^(?i)file:", "")


def mermaid_label(text: Column) -> Column:
    return F.translate(text, '"[]', "'()")


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def subject(text: Column) -> Column:
    """At most 76 characters: longer ones end in three dots after 73."""
    cut = F.regexp_replace(F.substring(text, 1, 73), r"[, ;]+\z", "")
    return F.when(F.length(text) > 76, F.concat(cut, F.lit("..."))).otherwise(text)


def map_tokens(files: Column) -> Column:
    return F.greatest(F.lit(100), files * 35)


def token_savings(generated: Column, raw: Column) -> Column:
    """Percent of tokens saved, one decimal, half to even."""
    share = F.greatest(F.lit(0.0), (F.lit(1.0) - generated / raw) * 100)
    return F.when(raw > 0, F.bround(share, 1)).otherwise(F.lit(0.0))


def language_code(text: Column) -> Column:
    names = {n: code for code, all_names in tables.LANGUAGE_CODES.items() for n in all_names}
    return lookup(F.lower(F.trim(F.coalesce(text, F.lit("en")))), names, "en")


def language_display(text: Column) -> Column:
    return lookup(language_code(text), tables.LANGUAGE_NAMES, tables.LANGUAGE_NAMES["en"])


def language_task(text: Column) -> Column:
    """What a model is told about the language of its answer."""
    return lookup(language_code(text), tables.LANGUAGE_TASKS, tables.LANGUAGE_TASKS["en"])


def is_system_type(name: Column) -> Column:
    """Whether a type's bare name is one of the platform's own."""
    return simple_type_name(name).isin(tables.SYSTEM_TYPES)


def is_local_import(spec: Column) -> Column:
    """Whether an import's specifier is a path from the file itself."""
    return spec.rlike(r"^\.\.?[/\\]")


def commit_verb(lang: Column, which: int) -> Column:
    return lookup(lang, {k: v[which] for k, v in tables.VERBS.items()}, tables.VERBS["en"][which])


def scope_description(mode: Column, target: Column) -> Column:
    return (
        F.when(mode == "Staged", "Staged Changes (--git-staged)")
        .when(mode == "Unstaged", "Unstaged Working Tree Changes (--git-unstaged)")
        .when(mode == "Branch", F.format_string("Branch Compare against '%s'", target))
        .when(mode == "LastN", F.format_string("Last %s Commits", target))
        .when(mode == "SingleFile", "Single File Diff")
        .otherwise("All Uncommitted Changes")
    )


def simple_type_name(name: Column) -> Column:
    """The bare name of a generic, nullable, array or qualified type."""
    bare = F.regexp_replace(name, r"<.*>|\[[^\]]*\]|\?", "")
    return F.regexp_extract(F.trim(bare), r"([^.]*)\z", 1)
