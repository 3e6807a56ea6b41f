"""A workspace of source files in eight languages that the test tables stand for, as SQL that Spark and DuckDB both read.

Document i is file j = i div 8 of language i % 8; its content is lines of code that name other
files of the language by arithmetic on j, and the document's own text as a comment.  With m
files of a language, file j names t1 .. t5, each other files' numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Q, NL = "chr(34)", "chr(10)"


def _lines(*lines: str) -> str:
    """Lines of code; {x} stands for a column, and a double quotation mark for itself."""
    out = []
    for line in lines:
        parts, rest = [], line
        while rest:
            i = rest.find("{{")
            text, rest = (rest, "") if i < 0 else (rest[:i], rest[i + 2 :])
            for k, piece in enumerate(text.split('"')):
                if k:
                    parts.append(Q)
                if piece:
                    text_ = "'" + piece.replace("'", "''") + "'"
                    # Braces stand for tables in Spark's SQL text, and a backslash escapes.
                    for sign, code in (("{", 123), ("}", 125), ("\\", 92)):
                        text_ = text_.replace(sign, f"' || chr({code}) || '")
                    parts.append(text_)
            if i >= 0:
                name, rest = rest.split("}}", 1)
                parts.append(f"({name})")
        out.append(" || ".join(parts))
    return f" || {NL} || ".join(out)


PATHS = [
    "'web/c' || (j % 13) || '/W' || j || CASE WHEN j % 29 = 0 THEN '.extensions.ts' ELSE '.tsx' END",
    "'pk/d' || (j % 5) || '/' || CASE WHEN j < 5 THEN 'helpers' ELSE 'm' || j END || '.py'",
    "'ja/p' || (j % 6) || '/' || CASE WHEN j % 31 = 7 THEN 'J' || (j - 1) || 'Impl' ELSE 'J' || j END || '.java'",
    "'rs/r' || j || '.rs'",
    "'kt/K' || j || '.kt'",
    "'ph/P' || j || '.php'",
    "'go/g' || (j % 9) || '/f' || j || '.go'",
    "'cc/x' || (j - j % 2) || CASE WHEN j % 2 = 0 THEN '.cpp' ELSE '.h' END",
]
CODE = [
    f"CASE WHEN j % 29 = 0 THEN {_lines('String.prototype.extra{{j % 7}} = function () {}')} ELSE " + _lines(
        'import { a } from "../c{{t1 % 13}}/W{{t1}}"', "const z = require('../c{{t2 % 13}}/W{{t2}}');", 'const lazy = import("../c{{t1 % 13}}/W{{t1}}");',
        "@Deco({ use: [W{{t2}}, Nothing] })", "export class K{{j}} implements W{{t1}}, W{{t2}} {", "  x() { return s.extra{{j % 7}}() }", "const v = <W{{t3}} />", "export const make{{j}} = (x) => x", "}",
    ) + " END",
    f"CASE WHEN j < 5 THEN {_lines('def util{{j}}():', '    pass')} ELSE " + _lines(
        "from .m{{t3}} import x", "from ..d{{t1 % 5}}.m{{t1}} import y", "import pk.d{{t2 % 5}}.m{{t2}}", "class C{{j}}(Nothing, m{{t3}}):", "    def run{{j}}(self):", "        return util{{j % 5}}()",
        "@app.m{{t4}}(sender=m{{t3}})", "@property", "async def go{{j}}(a):", "    pass",
    ) + " END",
    _lines(
        "import ja.p{{t1 % 6}}.J{{t1}};", "import static ja.p{{t2 % 6}}.J{{t2}}.go;", "@J{{t5}}(J{{t1}}.class)", "@Override", "public class J{{j}} implements Nothing, J{{t1}}, J{{t3}} {",
        "  @EventListener(J{{t2}}.class)", "  void go() { J{{t4}}.build(1); }", "}",
    ),
    _lines("mod r{{t1}};", "use crate::nothing::r{{t2}}::Thing;", "#[derive(Debug, r{{t5}})]", "pub struct S{{j}} {}", "impl<T> r{{t3}} for r{{t4}} {", "pub fn act{{j}}(x: u8) {}", "}"),
    _lines("import a.b.K{{t1}}", "fun K{{t2}}.more() = 1", "data class Q{{j}} : K{{t3}}(), K{{t4}} {", "fun act{{j}}(x: Int) = x", "}"),
    _lines("use App\\P{{t1}} as Other;", "#[P{{t5}}(P{{t1}}::class)]", "final class P_{{j}} extends P{{t2}} implements P{{t3}}, P{{t4}}", "{", "function act{{j}}($x) {}", "}"),
    _lines("package g{{j % 9}}", "import (", '  "fmt"', '  "mod/g{{t1 % 9}}"', ")", "type T{{j}} struct {}", "func (s T{{j}}) Act{{j}}(x int) {}"),
    _lines('#include "x{{t1 - t1 % 2}}.h"', "#include <vector>", "class A{{j}} : public x{{t2 - t2 % 2}} {", "};"),
]

NUMBERS = """
SELECT doc_id, doc_id % 8 AS lang, j, m, (j * 7 + 3) % m AS t1, (j * 5 + 1) % m AS t2, (j + 13) % m AS t3, (j + 10) % m AS t4, (j * 3 + 2) % m AS t5, text
FROM (SELECT doc_id, text, CAST((doc_id - doc_id % 8) / 8 AS BIGINT) AS j, CAST((n - n % 8) / 8 AS BIGINT) AS m
      FROM {documents}, (SELECT count(*) AS n FROM {documents}) c) d
WHERE j < m AND doc_id >= 0
"""
_CASE = lambda values: "CASE lang " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
FILES = f"SELECT doc_id, path, code || {NL} || coalesce(text, '') AS content FROM (SELECT doc_id, text, {_CASE(PATHS)} AS path, {_CASE(CODE)} AS code FROM ({NUMBERS}) k) f"


def code_files(spark: SparkSession, sf_dir: str, lang: int | None = None) -> DataFrame:
    """code_files(doc_id, path, content), of one language or all, over ``documents``."""
    out = spark.sql(FILES, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out if lang is None else out.where(f"doc_id % 8 = {lang}")


#: The number of the file of the next language that file j links, and the way up from a language's folders.
LINK, LINKED = "(j * 3 + 1) % m", "j % 2 = 0"
UP = ["../../", "../../", "../../", "../", "../", "../", "../../", "../"]


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_files with a line ``@see path`` in every other file, which names a file of the next language."""
    see = _CASE([f"'{UP[k]}' || {path_sql((k + 1) % len(PATHS), LINK)}" for k in range(len(PATHS))])
    line = f"CASE WHEN {LINKED} THEN '@see ' || {see} || {NL} ELSE '' END"
    sql = f"SELECT doc_id, path, code || {NL} || line || coalesce(text, '') AS content FROM (SELECT doc_id, text, {_CASE(PATHS)} AS path, {_CASE(CODE)} AS code, {line} AS line FROM ({NUMBERS}) k) f"
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def numbers_sql() -> str:
    """The numbers of files, for oracle SQL."""
    return "k AS (" + NUMBERS.format(documents="documents") + ")"


def path_sql(lang: int, number: str) -> str:
    """The path of file ``number`` of a language."""
    import re

    return re.sub(r"\bj\b(?!')", f"({number})", PATHS[lang])


#: One C# file for each document; file j names t1 .. t5 and t9 in strings and comments only.  With n files.
CSHARP_NUMBERS = """
SELECT doc_id, j, m, (j * 7 + 3) % m AS t1, (j * 5 + 1) % m AS t2, (j + 13) % m AS t3, (j + 10) % m AS t4, (j * 3 + 2) % m AS t5, (j * 11 + 6) % m AS t9, text
FROM (SELECT doc_id, text, doc_id AS j, n AS m FROM {documents}, (SELECT count(*) AS n FROM {documents}) c) d
WHERE j < m AND doc_id >= 0
"""
CSHARP_CODE = _lines(
    "#region T{{t9}}", "using System;", "using Short = App.N{{t1 % 7}}.T{{t1}};", "namespace App.N{{j % 7}};", "// class T{{t9}} is here", "[A{{t2}}(typeof(T{{t5}}))]",
    "public partial class T{{j}}<K> : B{{t3}}, IF{{t4}} where K : T{{t4}}", "{", "    private readonly T{{t4}} _held = null; // new T{{t9}}()", '    private string _text = "new T{{t9}}() \\" T{{t9}}.Run()";',
    "    public T{{t3}}? Next { get; set; } = null;", "    public T{{j}}(IF{{t1}} first, G{{t2}}<int, string> second = null) { _held = (T{{t4}})first; }",
    "    public async Task<T{{t5}}[]> Find(ref T{{t1}} key, string name)", "    {", "        T{{t2}} local = null; if (key is T{{t3}} other) { other.Go{{t2}}(typeof(T{{t4}})); }",
    "        try { var made = new T{{t5}}(name) { Id = 1 }; S{{t1}}.Run(made); Console.Write(S{{t3}}.Name); }", "        catch (E{{t3}} e) when (e.Inner != null) { throw; }",
    "        foreach (G{{t1}}<T{{t2}}> x in made) { yield return (x as T{{t5}})?.Id; }", "    }", "    public string Show(int id) => S{{t5}}.Show(id);", "}",
    "public interface IF{{j}} { T{{t2}} One(); }", "public struct G{{j}}<V> { } public class B{{j}} { } public class E{{j}} { }", "public sealed class A{{j}}Attribute { }",
    "public static class S{{j}} { public static int Go{{j}}(this object self, Type t) => 0; }", "public record M{{j}}Event(int Id);", "public class H{{j}} { public void Handle(M{{t1}}Event e) { Send(new M{{t2}}Event(1)); } }", "/*",
)


def csharp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """csharp_files(doc_id, path, content): a C# file for each document, its own text in a comment at the end."""
    sql = f"SELECT doc_id, 'cs/n' || (j % 7) || '/T' || j || '.cs' AS path, {CSHARP_CODE} || {NL} || replace(coalesce(text, ''), '*/', '') || '*/' AS content FROM ({CSHARP_NUMBERS}) k"
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Component sources, pages, styles, Dart and Razor files: document i is file j = i div 5 of kind i % 5.
WEB_NUMBERS = NUMBERS.replace("% 8", "% 5").replace("/ 8", "/ 5")
_RAZOR_NAME = "CASE WHEN j % 4 = 1 THEN 'R' || (j - 1) || '.razor.cs' WHEN j % 4 = 3 THEN 'S' || j || '.cs' ELSE 'R' || j || '.razor' END"
WEB_PATHS = ["'ng/c' || j || '.component.ts'", "'ng/c' || j || '.component.html'", "'ng/_q' || j || '.scss'", "'da/d' || j || '.dart'", f"'rz/' || {_RAZOR_NAME}"]
WEB_CODE = [
    _lines("@Component({", '  templateUrl: "./c{{j}}.component.html",', "  styleUrls: ['./_q{{t1}}.scss', \"./nothing.css\"],", "})", "const other = { styleUrl: './_q{{t2}}.scss' }"),
    _lines('<script async src="./c{{t1}}.component.ts"></script>', "<link rel='stylesheet' href='./_q{{t2}}.scss'>"),
    _lines('@use "./_q{{t1}}.scss";', "@import 'q{{t2}}';"),
    _lines("import 'd{{t1}}.dart';", "part 'd{{t2}}.dart';", "class D{{j}} extends d{{t3}} {", "  void go() { on<d{{t4}}>(); }", "}"),
    f"CASE WHEN j % 2 = 1 THEN 'public class Code' ELSE {_lines('@inject S{{t2 - t2 % 4 + 3}} own', '<R{{t1 - t1 % 2}} />')} END",
]


def web_files(spark: SparkSession, sf_dir: str, *kinds: int) -> DataFrame:
    """web_files(doc_id, path, content) of some kinds."""
    case = lambda values: "CASE lang " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
    sql = f"SELECT doc_id, path, code || {NL} || coalesce(text, '') AS content FROM (SELECT doc_id, text, {case(WEB_PATHS)} AS path, {case(WEB_CODE)} AS code FROM ({WEB_NUMBERS}) k) f"
    out = spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.where((out.doc_id % 5).isin(*kinds)) if kinds else out


def web_sql() -> str:
    return "k AS (" + WEB_NUMBERS.format(documents="documents") + ")"


def web_path(kind: int, number: str) -> str:
    """The path of file ``number`` of a kind."""
    import re

    return re.sub(r"\bj\b(?!')", f"({number})", WEB_PATHS[kind])
