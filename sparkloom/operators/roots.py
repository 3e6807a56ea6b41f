"""Which node of a file a question starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import extension, stem

#: Files that are their own root, and the kinds that can be one.
DIRECT = [".html", ".htm", ".css", ".scss", ".sass", ".vue", ".razor", ".cshtml"]
KINDS = ["Class", "Interface", "Record", "Struct", "Enum", "Function", "Component", "Service"]


def resolve_roots(files: DataFrame, nodes: DataFrame, symbol: str | None = None) -> DataFrame:
    """(path, root_id, root_symbol, candidates, multi, error) of every file of ``files`` (path).

    ``nodes`` (path, id, kind, name, ord) are what files declare.  Pages, styles and components are their own root, and so is a file without
    declarations; one declaration is the root; of several, the first that is named like the file, ignoring case, ``_``
    and ``-``.  Else the file is, and ``multi`` says that its declarations are roots with it (see
    ``root_nodes``).  A ``symbol`` asks for the first declaration of that name; where there is none,
    ``error`` is RootSymbolNotFound and the root is null.
    """
    plain = lambda c: F.lower(F.translate(c, "_-", ""))
    own = nodes.where(F.col("kind").isin(KINDS)).withColumn("like", plain(F.col("name")) == plain(stem(F.col("path"))))
    node = F.struct("id", "name")
    asked = F.lit(None).cast("struct<id:string,name:string>") if symbol is None else F.min_by(F.when(F.col("name") == symbol.strip(), node), F.when(F.col("name") == symbol.strip(), F.col("ord")))
    found = own.groupBy("path").agg(F.count("*").alias("n"), F.min_by(node, "ord").alias("first"), F.min_by(F.when(F.col("like"), node), F.when(F.col("like"), F.col("ord"))).alias("named"), asked.alias("asked"))
    j = files.select("path").distinct().join(found, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    direct = extension(F.col("path")).isin(DIRECT)
    none = F.lit(None).cast("struct<id:string,name:string>")
    want = F.when(direct, none).otherwise(F.col("asked") if symbol is not None else F.when(F.col("n") == 1, F.col("first")).otherwise(F.col("named")))
    j = j.withColumn("root", want)
    lost = ~direct & F.lit(symbol is not None) & F.col("root").isNull()
    return j.select(
        "path",
        F.when(~lost, F.coalesce(F.col("root.id"), F.concat(F.lit("file:"), "path"))).alias("root_id"),
        F.col("root.name").alias("root_symbol"),
        F.col("n").alias("candidates"),
        (~direct & F.lit(symbol is None) & (F.col("n") > 1) & F.col("root").isNull()).alias("multi"),
        F.when(lost, "RootSymbolNotFound").alias("error"),
    )


def root_nodes(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, id) of all roots: the resolved one, and every declaration of a file that is ambiguous."""
    more = nodes.where(F.col("kind").isin(KINDS)).join(resolved.where("multi").select("path"), "path", "left_semi").select("path", "id")
    return resolved.where("root_id IS NOT NULL").select("path", F.col("root_id").alias("id")).unionByName(more).distinct()
