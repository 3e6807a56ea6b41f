"""Small helpers that write oracle SQL for DuckDB."""

from __future__ import annotations

from sparkloom.functions import tables


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "(" + ", ".join(text(i) for i in items) + ")"


def mapped(expr: str, mapping: dict[str, str], default: str | None) -> str:
    out = f"CASE {expr} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items())
    return out + (f" ELSE {text(default)} END" if default is not None else " END")


def any_of(conditions) -> str:
    return "(" + " OR ".join(conditions) + ")"


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {text(pattern)}))"


def token_matches(expr: str) -> str:
    word = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
    return "(" + " + ".join(count(expr, p) for p in ("[a-z]+", "[0-9]+", rf"[^\s{word}]", "[A-Z]{2,}[a-z]", rf"[A-Z]+(?:[^{word}]|\z)")) + ")"


def token_estimate(expr: str) -> str:
    n = token_matches(expr)
    return f"CASE WHEN length({expr}) > 0 THEN greatest(1, CASE WHEN {n} > 0 THEN ceil({n} * 1.05::DOUBLE) ELSE ceil(length({expr}) / 3.7::DOUBLE) END) ELSE 0 END::BIGINT"


def dirs(lower: str, names) -> str:
    return any_of([f"contains({lower}, {text(d)}) OR starts_with({lower}, {text(d.lstrip('/'))})" for d in names])


def name(path: str) -> str:
    return f"split_part({path}, '/', -1)"


def is_generated(path: str, content: str) -> str:
    head = f"lower(substr({content}, 1, 500))"
    return any_of([
        f"lower({name(path)}) IN {listed(tables.LOCK_FILES)}",
        dirs(f"lower({path})", tables.GENERATED_DIRS),
        any_of([f"ends_with(lower({path}), {text(s)})" for s in tables.GENERATED_SUFFIXES]),
        any_of([f"contains({head}, {text(m)})" for m in tables.GENERATED_MARKS]),
    ])


def is_test(path: str) -> str:
    n = name(f"lower({path})")
    return any_of([
        dirs(f"lower({path})", tables.TEST_DIRS),
        any_of([f"ends_with(lower({path}), {text(s)})" for s in tables.TEST_SUFFIXES]),
        f"starts_with({n}, 'test_') AND ends_with({n}, '.py')",
        f"ends_with({n}, '_test.py')",
    ])


def is_config(path: str) -> str:
    n = f"lower({name(path)})"
    return any_of([f"ext IN {listed(tables.CONFIG_EXTS)}", *[f"starts_with({n}, {text(p)})" for p in tables.CONFIG_PREFIXES]])


def graph_source(path: str) -> str:
    skipped = any_of([f"ends_with(upper({path}), {text(s.upper())})" for s in tables.GRAPH_SKIPPED_SUFFIXES])
    segments = any_of([f"list_contains(string_split(upper({path}), '/'), {text(s.upper())})" for s in tables.TEST_SEGMENTS])
    return f"(ext IN {listed(tables.SOURCE_EXTS)} AND NOT {skipped} AND NOT ({segments} OR contains(upper({path}), '.TEST.') OR contains(upper({path}), '.SPEC.') OR ends_with(upper({path}), '-CONTEXT.MD')))"


def cluster(path: str) -> str:
    return f"CASE WHEN len(string_split({path}, '/')) <= 1 THEN 'root' ELSE array_to_string(list_filter(string_split({path}, '/')[1:-2], lambda p: upper(p) <> 'SRC')[1:2], '/') END"


_EDGE = r"[^\p{L}\p{Nd}_]"


def _re2(pattern: str) -> str:
    """A fixed pattern as RE2 reads it: a word's edge becomes the start, the end or a sign, and what is looked ahead for is matched."""
    if pattern.startswith(r"\b"):
        pattern = rf"(?:^|{_EDGE})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + rf"(?:{_EDGE}|$)"
    return pattern.replace("(?=.*(?:server", ".*(?:(?:server")


#: The fixed patterns of ``tables.SECRETS``; these equal the engine's on a line.
SECRETS = [(name, _re2(pattern)) for name, pattern in tables.SECRETS]


def secret_category(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {text(p)}) THEN {text(n)}" for n, p in SECRETS) + " END"


def redacted(expr: str) -> str:
    """Every secret of a text as the mark, category by category; signs beside a word stay as they are."""
    mark = tables.REDACTED
    for _, pattern in tables.SECRETS:
        flag, pattern = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        if "(?=.*(?:server" in pattern:
            # RE2 cannot look ahead: each match is read with the rest of its line, which is put back.
            head, tail = pattern.split("(?=", 1)
            lines = f"string_split({expr}, chr(10))"
            once = lambda x: f"regexp_replace({x}, {text(flag + '(' + head + ')(' + tail[:-1] + ')')}, {text(mark + chr(92) + '2')})"  # noqa: E731, B023
            expr = f"array_to_string(list_transform({lines}, lambda x: {once(once('x'))}), chr(10))"
            continue
        left, right = pattern.startswith(r"\b"), pattern.endswith(r"\b")
        core = pattern[2 if left else 0 : len(pattern) - (2 if right else 0)].replace("(AKIA[0-9A-Z]{16})", "AKIA[0-9A-Z]{16}")
        full = flag + (f"(^|{_EDGE})" if left else "()") + f"(?:{core})" + (f"({_EDGE}|$)" if right else "()")
        expr = f"regexp_replace({expr}, {text(full)}, {text(chr(92) + '1' + mark + chr(92) + '2')}, 'g')"
    return expr
