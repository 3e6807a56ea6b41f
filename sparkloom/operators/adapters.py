"""Adapters: which extractor reads which file, in an order that a user can go before.

An adapter says what files it can handle and what their texts name.  The registry sends each file
to the first adapter that can handle it; the one registered last is asked first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from sparkloom.functions import tables
from sparkloom.functions.text import extension
from sparkloom.sources.shared import materialise

from . import extract as X
from .languages import CPP, CSHARP, DART, JAVA, JS, KOTLIN, PAGES, PHP, PY, RAZOR, RULES, RUST, STYLES, Rule

#: What a table function yields for (path, content): as ``extract.MATCH``, without the path.
FOUND = "spec string, rel string, how string, targets array<string>"


@dataclass(frozen=True)
class Adapter:
    """An extractor of some extensions or languages.

    ``rules`` run in the JVM; ``table`` is a Python table function (``adapter_function``) for what
    patterns cannot express.  ``capability`` tells a reader how deep it looks.
    """

    id: str
    extensions: tuple[str, ...]
    languages: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    table: UserDefinedTableFunction | None = field(default=None, compare=False)
    capability: str = "SyntaxAware"

    def can_handle(self, ext: Column) -> Column:
        """Whether the extension is among its own or stands for one of its languages."""
        return ext.isin(*self.extensions, *(e for e, name in tables.LANGUAGE_BY_EXT.items() if name in self.languages))


def adapter_function(cls: type) -> UserDefinedTableFunction:
    """A class whose ``eval(path, content)`` yields (spec, rel, how, targets), as an Arrow-batched table function."""
    return F.udtf(cls, returnType=FOUND, useArrow=True)


def _built_in(name: str, exts: tuple[str, ...], *languages: str) -> Adapter:
    return Adapter(name, exts, languages, tuple(r for r in RULES if set(r.exts) <= set(exts)))


DEFAULTS = (
    _built_in("dotnet", CSHARP + RAZOR, "CSharp", "Razor"),
    _built_in("node", JS + STYLES + PAGES, "TypeScript", "TSX", "JavaScript", "JSX", "HTML", "CSS", "SCSS", "Vue"),
    _built_in("python", PY, "Python"),
    _built_in("java", JAVA, "Java"),
    _built_in("go", (".go",), "Go"),
    _built_in("rust", RUST, "Rust"),
    _built_in("kotlin", KOTLIN, "Kotlin"),
    _built_in("php", PHP, "Php"),
    _built_in("dart", DART, "Dart"),
    _built_in("cpp", CPP, "C", "Cpp"),
)


class Adapters:
    """An ordered registry of adapters."""

    def __init__(self, adapters=DEFAULTS):
        self.items: list[Adapter] = list(adapters)
        self._built: Column | None = None

    def register(self, adapter: Adapter) -> Adapters:
        """Ask ``adapter`` before all others; one with the same id is replaced."""
        self.items, self._built = [adapter, *(a for a in self.items if a.id != adapter.id)], None
        return self

    def chosen(self, path: Column) -> Column:
        """The id of the adapter of a file, null where none can handle it."""
        ext = extension(path)
        return F.coalesce(*[F.when(a.can_handle(ext), a.id) for a in self.items], F.lit(None).cast("string"))

    def _hits(self) -> Column:
        """The matches of all rule adapters in a row of (adapter, ext, content); built once, since a closure asks every round."""
        if self._built is None:
            empty = F.array().cast(X._MATCHES)

            def hits(row: Column) -> Column:
                out = F.when(F.lit(False), empty)
                for a in self.items:
                    own = F.concat(empty, *[F.when(row["ext"].isin(*r.exts), X._hits(r, row["content"])).otherwise(empty) for r in a.rules])
                    out = out.when(row["adapter"] == a.id, F.array_distinct(own)) if a.rules else out
                return out

            # As a lambda over one row's fields: generated code for all rules at once would be over the JVM's limit of a method.
            self._built = F.flatten(F.transform(F.array(F.struct("adapter", "ext", "content")), hits))
        return self._built

    def matches(self, files: DataFrame) -> DataFrame:
        """What the texts of (path, content) name: (path, spec, rel, how, targets, adapter).

        All rule adapters share one scan.  A table function reads the rows that are its own, and no other.
        """
        ext = extension(F.col("path"))
        routed = files.select("path", "content", ext.alias("ext"), self.chosen(F.col("path")).alias("adapter"))
        ruled = [a for a in self.items if a.rules]
        found = self._hits()
        own = routed.where(F.col("adapter").isin(*[a.id for a in ruled])) if ruled else routed.where("false")
        out = own.select("path", "adapter", F.explode(found).alias("m")).select("path", "m.*", "adapter")
        for a in self.items:
            if a.table is not None:
                rows = routed.where(F.col("adapter") == a.id).select("path", "content", "adapter")
                yielded = rows.lateralJoin(a.table(F.col("path").outer(), F.col("content").outer()))
                out = out.unionByName(yielded.select("path", "spec", "rel", "how", "targets", "adapter").where("spec IS NOT NULL AND spec <> ''"))
        return out

    def edges(self, files: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """(src, dst, rel) of ``files``, with targets looked up among ``known`` (``extract.file_index``; by default the files themselves)."""
        own = X.file_index(files)
        known = own if known is None else known
        named = materialise(self.matches(files).drop("adapter"))  # looked up by path and by name; texts are read once
        found = X.resolved(named, known).unionByName(X.companions(own, known))
        return found.where("src <> dst").distinct()


def with_rules(adapters: Adapters, *rules: Rule) -> Adapters:
    """A registry whose rule adapters also run ``rules`` on the extensions that both name."""
    def more(a: Adapter) -> Adapter:
        if a.table is not None:
            return a
        mine = tuple(Rule(**{**r.__dict__, "exts": tuple(e for e in r.exts if e in a.extensions)}) for r in rules if set(r.exts) & set(a.extensions))
        return Adapter(a.id, a.extensions, a.languages, a.rules + mine, a.table, a.capability)

    return Adapters([more(a) for a in adapters.items])


def extensions(adapters: Adapters) -> tuple[str, ...]:
    return tuple(sorted(reduce(lambda s, a: s | set(a.extensions), adapters.items, set())))
