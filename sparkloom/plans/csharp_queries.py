"""Queries over C# facts and their resolution.

The bound files name each other by arithmetic, and the SQL states which facts that makes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import csharp as CS
from sparkloom.sources import code_bindings as C
from sparkloom.sources.shared import materialise

from .registry import register

#: What file j says: fact, kind, first letters of the name, number, declaring type (T, I and so on: of file j).
_REFS = [
    ("import", "Import", "T", "t1", ""),
    ("attribute", "Attribute", "A", "t2", "T"), ("attribute", "Attribute", "T", "t5", "T"),
    ("ref", "BaseType", "B", "t3", "T"), ("ref", "Interface", "IF", "t4", "T"), ("ref", "GenericConstraint", "T", "t4", "T"),
    ("ref", "FieldType", "T", "t4", "T"), ("ref", "LocalType", "T", "t4", "T"), ("ref", "PropertyType", "T", "t3", "T"),
    ("ref", "ConstructorDependency", "IF", "t1", "T"), ("ref", "ConstructorDependency", "G", "t2", "T"), ("ref", "ConversionType", "T", "t4", "T"),
    ("ref", "GenericArgument", "T", "t5", "T"), ("ref", "ParameterType", "T", "t1", "T"),
    ("ref", "LocalType", "T", "t2", "T"), ("ref", "LocalType", "T", "t3", "T"), ("ref", "LocalType", "T", "t5", "T"), ("ref", "LocalType", "G", "t1", "T"),
    ("ref", "GenericArgument", "T", "t2", "T"), ("ref", "ObjectCreation", "T", "t5", "T"), ("ref", "MethodCall", "S", "t1", "T"), ("ref", "MethodCall", "S", "t5", "T"),
    ("ref", "FieldType", "S", "t3", "T"), ("ref", "ExceptionType", "E", "t3", "T"),
    ("ref", "ReturnType", "T", "t2", "I"), ("ref", "ParameterType", "M", "t1", "H"), ("ref", "ObjectCreation", "M", "t2", "H"),
    *[("net", "FieldType", p, t, "T") for p, t in [("B", "t3"), ("IF", "t4"), ("T", "t4"), ("T", "t3"), ("IF", "t1"), ("T", "t5"), ("T", "t1"), ("T", "t2"), ("S", "t1"), ("S", "t3"), ("S", "t5"), ("E", "t3")]],
    ("net", "FieldType", "T", "t2", "I"), ("net", "FieldType", "M", "t1", "H"), ("net", "FieldType", "M", "t2", "H"),
]
_PATH = lambda x: f"'cs/n' || ({x} % 7) || '/T' || ({x}) || '.cs'"
_K = "k AS MATERIALIZED (" + C.CSHARP_NUMBERS.format(documents="documents") + ")"
_R = "r AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT j, '{fact}' AS fact, '{rel}' AS rel, '{p}' AS p, {t} AS x, '{own}' AS own FROM k" for fact, rel, p, t, own in _REFS) + ")"
#: Names of any file that implement a base or handle an event: base B and I, event T.
_TABLES = "WITH " + _K + ", " + _R + ", impl AS (SELECT j AS i, 'B' AS p, t3 AS x FROM k UNION ALL SELECT j, 'IF', t4 FROM k), hand AS (SELECT j AS i, 'M' AS p, t1 AS x FROM k)"


def _edges(where: str = "true", stages: bool = True) -> str:
    parts = [f"SELECT j, x AS i, rel, own FROM r WHERE {where}"]
    if stages:
        parts += [f"SELECT r.j, i, 'Implementation', own FROM r JOIN impl USING (p, x) WHERE fact IN ('ref', 'attribute') AND {where}", f"SELECT r.j, i, 'EventType', own FROM r JOIN hand USING (p, x) WHERE fact IN ('ref', 'attribute') AND {where}"]
    parts.append("SELECT j, t2, 'ExtensionMethod', 'T' FROM k")
    return " UNION ALL ".join(parts)


@register("csharp_facts", _TABLES + """ SELECT DISTINCT 'cs/n' || (j % 7) || '/T' || j || '.cs' AS path, CASE own WHEN '' THEN NULL WHEN 'I' THEN 'IF' || j ELSE own || j END AS owner, fact, rel, CASE WHEN fact = 'attribute' AND p = 'A' THEN 'A' || x || 'Attribute' WHEN p = 'M' THEN 'M' || x || 'Event' ELSE p || x END AS name FROM r WHERE NOT (fact = 'net' AND p = own AND x = j)""")
def csharp_facts(spark, sf_dir):
    """References to the types of the bound files, with the type that makes each."""
    found = CS.facts(C.csharp_files(spark, sf_dir)).where(F.col("fact").isin("ref", "import", "attribute", "net"))
    return found.where(F.col("name").rlike(r"^(?:[TBGSEH][0-9]+|IF[0-9]+|A[0-9]+Attribute|M[0-9]+Event)\z"))


@register("csharp_edges", _TABLES + f" SELECT DISTINCT {_PATH('j')} AS src, {_PATH('i')} AS dst, rel FROM ({_edges()}) e WHERE j <> i")
def csharp_edges(spark, sf_dir):
    """All edges between the bound C# files, every stage on."""
    return CS.edges(C.csharp_files(spark, sf_dir))


_PLAIN = "fact <> 'net' AND fact <> 'attribute'"


@register("csharp_resolution", _TABLES + f""", e AS (SELECT 'all' AS mode, * FROM ({_edges()}) a UNION ALL SELECT 'types', * FROM ({_edges(_PLAIN, stages=False)}) b)
 SELECT mode, CASE WHEN own <> '' THEN own END AS owner, rel, count(DISTINCT (j, i)) AS edges FROM e WHERE j <> i GROUP BY ALL""")
def csharp_resolution(spark, sf_dir):
    """Edges by kind and declaring type, with every stage of the resolution and with none but the types'."""
    found = materialise(CS.facts(C.csharp_files(spark, sf_dir)))
    bare = CS.resolve(found, attributes=False, implementations=False, event_subscribers=False, safety_net=False)
    both = CS.resolve(found).withColumn("mode", F.lit("all")).unionByName(bare.withColumn("mode", F.lit("types")))
    return both.groupBy("mode", F.substring("owner", 1, 1).alias("owner"), "rel").agg(F.count_distinct("src", "dst").alias("edges"))
