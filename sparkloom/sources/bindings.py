"""Relations that the test tables stand for, as SQL that Spark and DuckDB both read.

``files`` turns each document into a source file: a path with an extension by
doc_id, and its text with a few lines of code added.  ``edges`` links documents by
arithmetic on doc_id, and ``diff_lines`` marks the lines of ``files`` as a diff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = [
    "'Doc' || i || '.cs'", "'IDoc' || i || '.cs'", "'widget_' || i || '.ts'", "'View' || i || '.tsx'", "'mod_' || i || '.py'",
    "'test_mod_' || i || '.py'", "'Svc' || i || 'Service.java'", "'pkg_' || i || '.go'", "'lib_' || i || '.rs'", "'Main' || i || '.kt'",
    "'page_' || i || '.php'", "'app_' || i || '.dart'", "'core_' || i || '.cpp'", "'core_' || i || '.h'", "'logo_' || i || '.png'",
    "'settings_' || i || '.json'", "'bundle_' || i || '.min.js'", "'Form' || i || '.designer.cs'", "'spec_' || i || '.spec.ts'", "'style_' || i || '.scss'",
]
DIRS = ["models/", "services/", "tests/", "components/", "workers/", "build/", ""]
QUOTE = "chr(34)"

_CASE = lambda expr, values: f"CASE {expr} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"
#: Lines with made-up credentials, put together from parts.
_SECRETS = [
    f"'api' || '_key = ' || {QUOTE} || 'abcd1234' || 'efgh5678' || {QUOTE}",
    "'id AK' || 'IA' || 'ABCDEFGH' || 'IJKLMNOP'",
    "'url post' || 'gres://user:' || 'hunter2@db.example:5432/x'",
    "'-----BEGIN RSA' || ' PRIVATE KEY-----'",
    f"'pass' || 'word=letmein9;server=db' || {QUOTE}",
    "'let x = 1'",
    "'let y = 2'",
    f"'aws_secret' || '_access_key = ' || {QUOTE} || repeat('Ab1/', 10) || {QUOTE}",
    "'key gh' || 'p_' || repeat('a1B2', 9)",
    "'bot xo' || 'xb-' || '1234567890' || '-' || '1234567890' || '-abc end'",
]

FILES = f"""
SELECT doc_id, path, name, CASE WHEN position('.' IN name) > 0 THEN '.' || lower(split_part(name, '.', -1)) ELSE '' END AS ext, content
FROM (SELECT doc_id, 'src/' || source || '/' || lang || '/' || dir || name AS path, name,
  CASE WHEN doc_id % 31 = 5 THEN '// Code generated by tool' || chr(10) ELSE '' END || coalesce(text, '') || chr(10)
  || 'export class Type' || (doc_id % 211) || ' : IBase' || (doc_id % 17) || ', Type' || ((doc_id * 7 + 3) % 211) || ' ' || chr(123) || chr(10)
  || 'interface IBase' || (doc_id % 17) || ' ' || chr(123) || ' ' || chr(125) || chr(10)
  || 'function run' || (doc_id % 101) || '(a) ' || chr(123) || chr(10)
  || '  return new Type' || ((doc_id * 13 + 5) % 211) || '() // trailing note' || chr(10)
  || '/* block ' || doc_id || ' */ const s = ' || {QUOTE} || 'a // b' || {QUOTE} || chr(10)
  || '<!-- html note --> <b>' || repeat(chr(96), CAST(doc_id % 5 AS INT)) || '</b>' || chr(10)
  || 'import x from ' || {QUOTE} || './widget_' || ((doc_id * 3 + 2) % 997) || {QUOTE} || chr(10)
  || 'export const make' || (doc_id % 89) || ' = (x) => x' || chr(10)
  || ({_CASE('doc_id % 10', _SECRETS)}) || chr(10) || chr(125) AS content
  FROM (SELECT doc_id, text, source, lang, {_CASE('doc_id % 20', [n.replace('|| i ||', '|| doc_id ||') for n in NAMES])} AS name,
        {_CASE('doc_id % 7', [f"'{d}'" for d in DIRS])} AS dir FROM {{documents}}) n) f
"""

RELATIONS = ["Interface", "BaseType", "Import", "MethodCall", "Template", "Style", "Decorator", "EventType", "Unknown"]
CONFIDENCES = ["Verified", "High", "Medium", "Low", "Unresolved"]

#: Typed edges between documents; ``ord`` is the order in which they were found.
EDGES = f"""
SELECT src, dst, rel, confidence, ord FROM (
  SELECT e.src, e.dst, {_CASE('(e.src * 5 + e.dst + e.ord) % 9', [f"'{r}'" for r in RELATIONS])} AS rel,
         {_CASE('(e.src + e.dst) % 5', [f"'{c}'" for c in CONFIDENCES])} AS confidence, e.ord
  FROM (
    SELECT doc_id AS src, (doc_id * 7 + 3) % n AS dst, 1 AS ord FROM {{documents}}, (SELECT count(*) AS n FROM {{documents}}) c WHERE doc_id % 4 <> 1
    UNION ALL SELECT doc_id, (doc_id * 13 + 5) % n, 2 FROM {{documents}}, (SELECT count(*) AS n FROM {{documents}}) c WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, (doc_id - doc_id % 10) % n, 3 FROM {{documents}}, (SELECT count(*) AS n FROM {{documents}}) c WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, (doc_id * 7 + 3) % n, 4 FROM {{documents}}, (SELECT count(*) AS n FROM {{documents}}) c WHERE doc_id % 6 = 0
  ) e) t WHERE src <> dst
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(doc_id, path, name, ext, content) over ``documents``."""
    return spark.sql(FILES, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def files_sql() -> str:
    """The same for DuckDB, as a common table expression."""
    return "files AS (" + FILES.format(documents="documents") + ")"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, rel, confidence, ord) over ``documents``."""
    return spark.sql(EDGES, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def edges_sql() -> str:
    return "edges AS (" + EDGES.format(documents="documents") + ")"


#: One line of a diff for each line of a file: added, removed, kept or a hunk header.
DIFF_CASE = "CASE WHEN (doc_id + line_no) % 11 = 0 THEN '@@ -1,2 +1,3 @@ ' || line WHEN (doc_id + line_no) % 3 = 0 THEN '+' || line WHEN (doc_id + line_no) % 3 = 1 THEN '-' || line ELSE ' ' || line END"
STATUS_CASE = "CASE doc_id % 5 WHEN 0 THEN 'Added' WHEN 1 THEN 'Deleted' WHEN 2 THEN 'Renamed' ELSE 'Modified' END"


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diff_lines(doc_id, path, status, line_no, line)."""
    return spark.sql(
        "SELECT doc_id, path, " + STATUS_CASE + " AS status, line_no, " + DIFF_CASE + " AS line FROM (SELECT doc_id, path, pos + 1 AS line_no, line FROM {files} LATERAL VIEW posexplode(split(content, '\\n', -1)) AS pos, line)",
        files=files(spark, sf_dir),
    )


def diff_sql() -> str:
    return (
        files_sql()
        + ", _split AS (SELECT doc_id, path, string_split(content, chr(10)) AS l FROM files), _flat AS (SELECT doc_id, path, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM _split), diff_lines AS (SELECT doc_id, path, "
        + STATUS_CASE + " AS status, line_no, " + DIFF_CASE + " AS line FROM _flat)"
    )
