"""Queries over text, path and filter functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from sparkloom.functions import comments, filters, tables
from sparkloom.functions import text as T
from sparkloom.sources import bindings as B
from sparkloom.sources import code_bindings as C

from . import sql as S
from .registry import register


def scalar(name: str, columns: Callable[..., dict], oracle: dict[str, str] | None, where: str | None = None):
    """A query of doc_id and columns over ``files``, with SQL for each column."""
    sql = None
    if oracle is not None:
        sql = f"WITH {B.files_sql()} SELECT doc_id, " + ", ".join(f"{e} AS {c}" for c, e in oracle.items()) + " FROM files" + (f" WHERE {where}" if where else "")

    @register(name, sql)
    def run(spark, sf_dir):
        files = B.files(spark, sf_dir)
        return (files.where(where) if where else files).select("doc_id", *[e.alias(c) for c, e in columns(F.col("path"), F.col("content"), F.col("ext")).items()])

    return run


scalar("token_estimate", lambda path, content, ext: {"tokens": T.token_estimate(content)}, {"tokens": S.token_estimate("content")})
scalar("line_count", lambda path, content, ext: {"lines": T.line_count(content)}, {"lines": "len(string_split(content, chr(10)))"})
scalar("lang_by_ext", lambda path, content, ext: {"language": T.language(ext)}, {"language": S.mapped("ext", tables.LANGUAGE_BY_EXT, "Source")})
scalar("lang_override", lambda path, content, ext: {"language": F.coalesce(F.when(F.col("doc_id") % 13 == 0, F.lit("Python")), T.language(ext))}, {"language": "coalesce(CASE WHEN doc_id % 13 = 0 THEN 'Python' END, " + S.mapped("ext", tables.LANGUAGE_BY_EXT, "Source") + ")"})
scalar("path_parts", lambda path, content, ext: {"ext2": T.extension(path), "name2": T.file_name(path), "stem": T.stem(path)}, {"ext2": "ext", "name2": S.name("path"), "stem": r"regexp_replace(" + S.name("path") + r", '\.[^.]*$', '')"})
scalar("fence_lang", lambda path, content, ext: {"fence": T.fence_language(ext), "graph_fence": T.graph_fence_language(ext)}, {"fence": S.mapped("ext", tables.FENCE_BY_EXT, "text"), "graph_fence": S.mapped("ext", tables.GRAPH_FENCE_BY_EXT, "")})
scalar("safe_fence_len", lambda path, content, ext: {"fence_length": T.fence_length(content).cast("long")}, {"fence_length": "greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda r: length(r))), 0))::BIGINT"})
scalar("cluster_name", lambda path, content, ext: {"cluster": T.cluster_name(path)}, {"cluster": S.cluster("path")})
scalar("kebab_output_name", lambda path, content, ext: {"output": T.output_name(path)}, {"output": r"lower(translate(regexp_replace(regexp_replace(" + S.name("path") + r", '\.[^.]*$', ''), '([a-z0-9])([A-Z])', '\1-\2', 'g'), '_.', '--')) || '-context.md'"})
for _name in ("mermaid_label", "mermaid_label_text"):
    scalar(_name, lambda path, content, ext: {"label": T.mermaid_label(content)}, {"label": "translate(content, '\"[]', '''()')"})
scalar("normalise_path", lambda path, content, ext: {"norm": T.normalise_path(F.replace(path, F.lit("/"), F.lit("\\")))}, {"norm": "path"})
scalar("strip_file_prefix", lambda path, content, ext: {"bare": T.strip_file_prefix(F.concat(F.lit("file:"), path))}, {"bare": "path"})
scalar("capitalise_first", lambda path, content, ext: {"capital": T.capitalise(F.col("name"))}, {"capital": "upper(substr(name, 1, 1)) || substr(name, 2)"})
scalar("subject_truncate", lambda path, content, ext: {"subject": T.subject(F.regexp_replace(F.substring(content, 1, 90), "\n", " "))}, {"subject": r"CASE WHEN length(replace(substr(content, 1, 90), chr(10), ' ')) > 76 THEN regexp_replace(substr(replace(substr(content, 1, 90), chr(10), ' '), 1, 73), '[, ;]+$', '') || '...' ELSE replace(substr(content, 1, 90), chr(10), ' ') END"})
scalar("token_savings", lambda path, content, ext: {"savings": T.token_savings(T.map_tokens(F.lit(1)), T.token_estimate(content))}, {"savings": f"CASE WHEN {S.token_estimate('content')} > 0 THEN round_even(greatest(0.0::DOUBLE, (1.0::DOUBLE - 100 / ({S.token_estimate('content')})) * 100), 1) ELSE 0.0::DOUBLE END"})
_LANG = {n: code for code, names in tables.LANGUAGE_CODES.items() for n in names}
_lang = lambda: F.element_at(F.array(*[F.lit(x) for x in ("Spanish", "fr", " DE ", "isizulu", "klingon")]), (F.col("doc_id") % 5 + 1).cast("int"))
_lang_sql = S.mapped("lower(trim(list_value('Spanish', 'fr', ' DE ', 'isizulu', 'klingon')[(doc_id % 5 + 1)::INT]))", _LANG, "en")
scalar("output_language", lambda path, content, ext: {"code": T.language_code(_lang()), "display": T.language_display(_lang()), "verb": T.commit_verb(T.language_code(_lang()), 0)}, {"code": _lang_sql, "display": S.mapped(_lang_sql, tables.LANGUAGE_NAMES, None), "verb": S.mapped(_lang_sql, {k: v[0] for k, v in tables.VERBS.items()}, None)})
_mode = lambda: F.element_at(F.array(*[F.lit(x) for x in ("Staged", "Unstaged", "Branch", "LastN", "SingleFile", "All")]), (F.col("doc_id") % 6 + 1).cast("int"))
scalar("scope_description", lambda path, content, ext: {"scope": T.scope_description(_mode(), F.lit("main"))}, {"scope": "list_value('Staged Changes (--git-staged)', 'Unstaged Working Tree Changes (--git-unstaged)', 'Branch Compare against ''main''', 'Last main Commits', 'Single File Diff', 'All Uncommitted Changes')[(doc_id % 6 + 1)::INT]"})
for _name in ("redact_secrets", "redact_secrets_text"):
    scalar(_name, lambda path, content, ext: {"redacted": T.redact(content)}, {"redacted": S.redacted("content")})
scalar("strip_comments_html", lambda path, content, ext: {"html_free": T.token_estimate(comments.strip_html(content)), "left": comments.strip_html(content)}, {"html_free": S.token_estimate("regexp_replace(content, '<!--[\\s\\S]*?-->', '', 'g')"), "left": "regexp_replace(content, '<!--[\\s\\S]*?-->', '', 'g')"})
_c_sql = r"""regexp_replace(content, '("(?:\\[\s\S]|[^"\\])*(?:"|\\?\z)|''(?:\\[\s\S]|[^''\\])*(?:''|\\?\z)|`(?:\\[\s\S]|[^`\\])*(?:`|\\?\z))|//[^\n]*|/\*(?:[\s\S]*?\*/)', '\1', 'g')"""
scalar("strip_comments_cstyle", lambda path, content, ext: {"left": comments.strip_c(content)}, {"left": _c_sql})
scalar("strip_comments_css", lambda path, content, ext: {"left": comments.strip_css(content)}, {"left": _c_sql.replace("|//[^\\n]*", "")})
scalar("strip_comments_python", lambda path, content, ext: {"left": comments.strip_python(content)}, None)
scalar("strip_comments_csharp", lambda path, content, ext: {"left": comments.strip_csharp(content)}, None)
scalar("strip_comments_by_ext", lambda path, content, ext: {"tokens": T.token_estimate(comments.strip_comments(content, ext)), "supported": comments.supported(ext)}, None)

scalar("is_generated", lambda path, content, ext: {"generated": filters.is_generated(path, content)}, {"generated": S.is_generated("path", "content")})
scalar("is_test", lambda path, content, ext: {"test": filters.is_test(path)}, {"test": S.is_test("path")})
scalar("is_asset", lambda path, content, ext: {"asset": filters.is_asset(path)}, {"asset": f"ext IN {S.listed(tables.ASSET_EXTS)}"})
scalar("is_config", lambda path, content, ext: {"config": filters.is_config(path)}, {"config": S.is_config("path")})
scalar("graph_source_filter", lambda path, content, ext: {"source_file": filters.graph_source(path)}, {"source_file": S.graph_source("path")})
scalar("ignored_path", lambda path, content, ext: {"ignored": filters.is_ignored_path(path), "noise": filters.is_noise(path), "git_source": filters.is_git_source(path)}, {
    "ignored": S.any_of([f"list_contains(string_split(upper(path), '/')[1:-2], {S.text(d.upper())})" for d in tables.IGNORED_DIRS]),
    "noise": S.any_of([f"list_contains(string_split(upper(path), '/'), {S.text(d.upper())})" for d in tables.NOISE_SEGMENTS]),
    "git_source": f"ext IN {S.listed(tables.SOURCE_EXTS)} AND NOT " + S.any_of([f"list_contains(string_split(upper(path), '/')[1:-2], {S.text(d.upper())})" for d in tables.IGNORED_DIRS]),
})
scalar("glob_match", lambda path, content, ext: {"deep": filters.matches_glob(path, "src/**/*.ts"), "shallow": filters.matches_glob(path, "src/*/en/*.cs"), "literal": filters.matches_glob(path, "src/?/x")}, {"deep": r"regexp_matches(path, '^(?i)src/.*/[^/]*\.ts$')", "shallow": r"regexp_matches(path, '^(?i)src/[^/]*/en/[^/]*\.cs$')", "literal": "path = 'src/?/x'"})

_config = filters.FilterConfig(excluded_dirs=("workers",), exclude_globs=("**/*.php",), include_globs=("src/**",), max_depth=3)
_reason = lambda path, content: filters.exclusion_reason(path, content, F.col("doc_id") == 0, (F.col("doc_id") % 6).cast("int"), _config)
_reason_sql = f"""CASE WHEN doc_id = 0 THEN NULL WHEN contains(path, '/workers/') OR starts_with(path, 'workers/') THEN 'ExcludedNamespace'
 WHEN regexp_matches(path, '^(?i).*/[^/]*\\.php$') THEN 'ExcludeGlob' WHEN NOT regexp_matches(path, '^(?i)src/.*$') THEN 'ExcludeGlob'
 WHEN {S.is_generated("path", "content")} THEN 'GeneratedFileExcluded' WHEN {S.is_test("path")} THEN 'TestFileExcluded'
 WHEN ext IN {S.listed(tables.ASSET_EXTS)} THEN 'AssetExcluded' WHEN {S.is_config("path")} THEN 'ConfigurationFileExcluded'
 WHEN doc_id % 6 > 3 THEN 'MaxDepth' END"""
scalar("filter_precedence", lambda path, content, ext: {"reason": _reason(path, content), "allowed": _reason(path, content).isNull()}, {"reason": _reason_sql, "allowed": f"({_reason_sql}) IS NULL"})

_LINES_SQL = f"WITH {B.files_sql()}, l AS (SELECT doc_id, path, string_split(content, chr(10)) AS lines FROM files), x AS (SELECT doc_id, path, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM l), found AS (SELECT doc_id, path, line_no::INT AS line_no, {S.secret_category('line')} AS category FROM x) "


def findings(files):
    """(doc_id, path, line_no, category, recommendation): the first category of each line that has one."""
    lines = files.select("doc_id", "path", F.posexplode(F.split("content", "\r\n|\r|\n", -1)).alias("pos", "line"))
    found = lines.select("doc_id", "path", (F.col("pos") + 1).alias("line_no"), T.secret_category(F.col("line")).alias("category")).where("category IS NOT NULL")
    return found.withColumn("recommendation", T.lookup(F.col("category"), tables.RECOMMENDATIONS, None))


@register("secret_findings", _LINES_SQL + "SELECT doc_id, path, line_no, category, " + S.mapped("category", tables.RECOMMENDATIONS, None) + " AS recommendation FROM found WHERE category IS NOT NULL")
def secret_findings(spark, sf_dir):
    return findings(B.files(spark, sf_dir))


@register("secret_counts_by_category", _LINES_SQL + "SELECT category, count(*) AS findings, count(DISTINCT doc_id) AS files FROM found WHERE category IS NOT NULL GROUP BY category")
def secret_counts(spark, sf_dir):
    return findings(B.files(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("files"))


_TASKS = {"es": "Español", "fr": "Français", "de": "Deutsch", "zh": "简体中文", "ja": "日本語", "pt": "Português", "ru": "Русском", "zu": "isiZulu", "af": "Afrikaans", "en": "English"}


@register("language_task", "SELECT doc_id, " + S.mapped("lang", {k: _TASKS[k] for k in ("es", "fr", "de", "en")}, "English") + " AS named FROM documents")
def language_task(spark, sf_dir):
    """The language that the instruction for each document's own language names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.language_task(F.col("lang")).alias("t"))
    return docs.select("doc_id", F.regexp_extract("t", "(" + "|".join(_TASKS.values()) + ")", 1).alias("named"))


_TYPED = r"[A-Za-z_][A-Za-z0-9_.]*<[^<>\n]*>(?:\[\])?\??"
_CS = "k AS (" + C.CSHARP_NUMBERS.format(documents="documents") + f"), cs AS (SELECT doc_id, {C.CSHARP_CODE} AS content FROM k)"


@register("simple_type_name", "WITH " + _CS + f", t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(content, {S.text(_TYPED)})) AS written FROM cs) SELECT doc_id, written, regexp_extract(trim(regexp_replace(written, '<.*>|\\[[^\\]]*\\]|\\?', '', 'g')), '([^.]*)$', 1) AS simple FROM t")
def simple_type_name(spark, sf_dir):
    """The bare names of all generic types that the code of the bound C# files writes out."""
    types = _csharp_code(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(_TYPED), F.lit(0))).alias("written")).distinct()
    return types.select("doc_id", "written", T.simple_type_name(F.col("written")).alias("simple"))


def _csharp_code(spark, sf_dir):
    return spark.sql(f"SELECT doc_id, {C.CSHARP_CODE} AS content FROM ({C.CSHARP_NUMBERS}) k", documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


@register("system_types", "WITH " + _CS + f", t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM cs) SELECT name, name IN {S.listed(tables.SYSTEM_TYPES)} AS system, count(*) AS files FROM t GROUP BY ALL")
def system_types(spark, sf_dir):
    """Every identifier of the bound C# files, told apart from the platform's types, with the files that hold it."""
    names = _csharp_code(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name"))
    return names.groupBy("name", T.is_system_type(F.col("name")).alias("system")).agg(F.count("*").alias("files"))


_QUOTED = r"""['"]([^'"\n]+)['"]"""
_CODE = "k AS (" + C.NUMBERS.format(documents="documents") + "), code AS (SELECT doc_id, CASE lang " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(C.CODE)) + " END AS content FROM k)"


@register("local_imports", "WITH " + _CODE + f", t AS (SELECT doc_id, unnest(regexp_extract_all(content, {S.text(_QUOTED)}, 1)) AS spec FROM code) SELECT doc_id, count(*) AS specs, count(*) FILTER (regexp_matches(spec, '^\\.\\.?[/\\\\]')) AS local FROM t GROUP BY doc_id")
def local_imports(spark, sf_dir):
    """How many of the quoted specifiers of each bound file are paths from the file itself."""
    case = "CASE lang " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(C.CODE)) + " END"
    code = spark.sql(f"SELECT doc_id, {case} AS content FROM ({C.NUMBERS}) k", documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    specs = code.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(_QUOTED), F.lit(1))).alias("spec"))
    return specs.groupBy("doc_id").agg(F.count("*").alias("specs"), F.count_if(T.is_local_import(F.col("spec"))).alias("local"))
