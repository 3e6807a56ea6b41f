"""Comment stripping by dialect, one regular expression each.

Strings come first in the alternation and are kept; possessive loops keep long
strings off the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r"\"(?:\\[\s\S]|[^\"\\])*+(?:\"|\\?\z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\\?\z)"
_TICKED = r"`(?:\\[\s\S]|[^`\\])*+(?:`|\\?\z)"
_RAW = r"`[^`]*+(?:`|\z)"
_BLOCK = r"/\*(?:[\s\S]*?\*/|[\s\S]*(?=[\s\S]\z)|\z)"
C_STYLE = rf"({_QUOTED}|{_TICKED})|//[^\n]*|{_BLOCK}"
GO = rf"({_QUOTED}|{_RAW})|//[^\n]*|{_BLOCK}"
CSS = rf"({_QUOTED}|{_TICKED})|{_BLOCK}"
#: Preprocessor lines, raw, verbatim and normal strings are kept.
CSHARP = r"((?m:^[ \t]*#[^\n]*)|\"\"\"[\s\S]*?(?:\"\"\"|\z)|@\"(?:[^\"]|\"\")*+(?:\"|\z)|" + _QUOTED + r")|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
PYTHON = r"(\A#![^\n]*|\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z)|\"(?:\\[\s\S]|[^\"\\\n])*+(?:\"|\\?\z|(?=\n))|'(?:\\[\s\S]|[^'\\\n])*+(?:'|\\?\z|(?=\n)))|#[^\n]*"
VB = r"(\"[^\"\n]*+(?:\"|\z|(?=\n)))|'[^\n]*|(?i:(?m:^|(?<=[ \t:]))REM [^\n]*)"
HTML = r"<!--[\s\S]*?-->"
RAZOR = r"@\*[\s\S]*?\*@"

#: Extension to dialect; other extensions pass unchanged and count as unsupported.
DIALECT = {
    ".cs": "csharp", ".vb": "vb", ".py": "python", ".yaml": "python", ".yml": "python", ".js": "c", ".jsx": "c", ".ts": "c", ".tsx": "c",
    ".mjs": "c", ".cjs": "c", ".java": "c", ".scss": "c", ".sass": "c", ".go": "go", ".css": "css", ".html": "html", ".htm": "html",
    ".razor": "razor", ".cshtml": "razor", ".vue": "vue", ".json": "none",
}


def strip_c(text: Column) -> Column:
    return F.regexp_replace(text, C_STYLE, "$1")


def strip_go(text: Column) -> Column:
    return F.regexp_replace(text, GO, "$1")


def strip_css(text: Column) -> Column:
    return F.regexp_replace(text, CSS, "$1")


def strip_csharp(text: Column) -> Column:
    return F.regexp_replace(text, CSHARP, "$1")


def strip_python(text: Column) -> Column:
    return F.regexp_replace(text, PYTHON, "$1")


def strip_vb(text: Column) -> Column:
    return F.regexp_replace(text, VB, "$1")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML, "")


def strip_razor(text: Column) -> Column:
    return strip_html(F.regexp_replace(text, RAZOR, ""))


def strip_vue(text: Column) -> Column:
    """Strip each template, script and style block in its own dialect."""
    pattern = r"(?s)<template[^>]*>.*?</template>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
    gaps, blocks = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def clean(b: Column) -> Column:
        return F.when(b.startswith("<template"), strip_html(b)).when(b.startswith("<script"), strip_c(b)).otherwise(strip_css(b))

    joined = F.zip_with(gaps, F.transform(blocks, clean), lambda g, b: F.concat(g, F.coalesce(b, F.lit(""))))
    return F.array_join(joined, "")


def strip_comments(text: Column, ext: Column) -> Column:
    """Strip by extension; an unsupported extension leaves the text as it is."""
    by = {"csharp": strip_csharp, "vb": strip_vb, "python": strip_python, "c": strip_c, "go": strip_go, "css": strip_css, "html": strip_html, "razor": strip_razor, "vue": strip_vue}
    out = None
    for name, fn in by.items():
        exts = [e for e, d in DIALECT.items() if d == name]
        out = F.when(ext.isin(exts), fn(text)) if out is None else out.when(ext.isin(exts), fn(text))
    return out.otherwise(text)


def supported(ext: Column) -> Column:
    return ext.isin(list(DIALECT))
