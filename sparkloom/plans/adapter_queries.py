"""Queries over adapters and the closure across languages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkloom.operators import adapters as A
from sparkloom.operators import closure as CL
from sparkloom.operators.languages import Rule
from sparkloom.sources import code_bindings as C
from sparkloom.sources.shared import materialise

from .language_queries import RULE_EDGES
from .registry import register

#: A rule of the user's own: a line that names another file, whatever its language.
SEE = Rule((".ts", ".tsx", ".py", ".java", ".rs", ".kt", ".php", ".go", ".cpp", ".h"), "Link", r"(?m)^@see (\S+)$", how="path")


def _rows(lang: int, parts) -> list[str]:
    src = C.path_sql(lang, "j")
    return [f"SELECT {src} AS src, {C.path_sql(lang, target)} AS dst, '{rel}' AS rel FROM k WHERE lang = {lang} AND {where}" for target, rel, where in parts]


def _links(lang: int) -> str:
    # A line is read whole, so a link to a header that is the file of an odd number keeps its own extension.
    return f"SELECT {C.path_sql(lang, 'j')}, {C.path_sql((lang + 1) % 8, C.LINK)}, 'Link' FROM k WHERE lang = {lang} AND {C.LINKED}"


_ALL = " UNION ALL ".join(row for lang, parts in enumerate(RULE_EDGES) for row in _rows(lang, parts))
_LINKS = " UNION ALL ".join(map(_links, range(8)))


class ImportsOnly:
    """A user's adapter: of a Kotlin file, its imports and nothing else."""

    def eval(self, path: str, content: str):
        for m in re.finditer(r"(?m)^import ([A-Za-z0-9_.]+)", content or ""):
            yield m.group(1), "UserImport", "stem", [".kt"]


def _registry() -> A.Adapters:
    return A.Adapters().register(A.Adapter("imports-only", (".kt",), table=A.adapter_function(ImportsOnly)))


_OVERRIDDEN = " UNION ALL ".join(row for lang, parts in enumerate(RULE_EDGES) for row in _rows(lang, [("t1", "UserImport", "true")] if lang == 4 else parts))


@register("adapter_edges", "WITH " + C.numbers_sql() + f" SELECT DISTINCT src, dst, rel FROM ({_OVERRIDDEN}) e WHERE src <> dst")
def adapter_edges(spark, sf_dir):
    """Files of all languages by the built-in adapters, Kotlin ones by a user's table function."""
    return _registry().edges(materialise(C.code_files(spark, sf_dir)))


@register("adapter_routes", "WITH " + C.numbers_sql() + " SELECT " + "CASE lang " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(["node", "python", "java", "rust", "imports-only", "php", "go", "cpp"])) + " END AS adapter, count(*) AS files FROM k GROUP BY 1")
def adapter_routes(spark, sf_dir):
    files = C.code_files(spark, sf_dir)
    return files.groupBy(_registry().chosen(F.col("path")).alias("adapter")).agg(F.count("*").alias("files"))


_LANG = "CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'ts' THEN 'TypeScript' WHEN 'tsx' THEN 'TSX' WHEN 'py' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'rs' THEN 'Rust' WHEN 'kt' THEN 'Kotlin' WHEN 'php' THEN 'Php' WHEN 'go' THEN 'Go' WHEN 'cpp' THEN 'Cpp' WHEN 'h' THEN 'C' END"


@register("cross_language_closure", "WITH RECURSIVE " + C.numbers_sql() + f""", e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({_ALL} UNION ALL {_LINKS}) x WHERE src <> dst),
 root AS (SELECT {C.path_sql(0, 'j')} AS path FROM k WHERE lang = 0 AND j = 2),
 a(path) AS (SELECT path FROM root UNION SELECT e.dst FROM a JOIN e ON e.src = a.path WHERE ends_with(e.src, '.tsx')),
 b(path) AS (SELECT path FROM a UNION SELECT e.dst FROM b JOIN e ON e.src = b.path WHERE NOT ends_with(e.src, '.tsx'))
 SELECT path, {_LANG} AS language, path IN (SELECT path FROM a) OR NOT ends_with(path, '.tsx') AS parsed FROM b""")
def cross_language_closure(spark, sf_dir):
    """All that one TSX file reaches, over the files of eight languages that link each other."""
    root = C.code_files(spark, sf_dir).where("doc_id = 16").select("path")
    out = CL.closure(C.linked_files(spark, sf_dir), root, A.with_rules(A.Adapters(), SEE))
    return out.select("path", "language", "parsed")
