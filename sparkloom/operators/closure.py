"""Cross-language closure: which files a root reaches, when only files that it reaches are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import extension, language
from sparkloom.sources.shared import Levels, materialise, root as shared_root

from . import extract as X
from .adapters import Adapters


class Shelves:
    """A written copy of (path, content), in folders by a hash of the path, so that a round reads the folders of its own paths only.

    Texts are dealt over ``spread`` files of a shelf.  It can be kept and asked again.
    """

    def __init__(self, files: DataFrame, shelves: int = 64):
        spark = files.sparkSession
        self.shelves = shelves
        self.path = f"{shared_root(spark)}/shelves-{uuid.uuid4().hex}"
        spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shelves)
        dealt = files.select("path", "content").withColumn("shelf", self.of("path")).repartition("shelf", F.pmod(F.xxhash64(F.lit(1), "path"), F.lit(spread)))
        dealt.write.partitionBy("shelf").parquet(self.path)
        self.table = spark.read.schema("path string, content string, shelf int").parquet(self.path)

    def of(self, path: str):
        return F.pmod(F.xxhash64(path), F.lit(self.shelves)).cast("int")

    def texts(self, paths: DataFrame) -> DataFrame:
        """(path, content) of ``paths`` (path): shelves without any are not opened."""
        wanted = paths.select("path", self.of("path").alias("shelf")).distinct()
        numbers = [r[0] for r in wanted.select("shelf").distinct().collect()]  # at most one number for each shelf
        return self.table.where(F.col("shelf").isin(*numbers)).join(wanted, ["shelf", "path"], "left_semi").select("path", "content")


def closure(files: DataFrame | Shelves, roots: DataFrame, adapters: Adapters | None = None, *, every: bool = False) -> DataFrame:
    """(path, language, round, parsed): files that ``roots`` (path) reach, and whether their text was read.

    First the files of the roots' own languages are followed as far as they go; then those of other
    languages, whose further files of the roots' languages are reached and not read.  ``every``
    follows all languages alike, as for a set of changed files.  A round reads the texts that the
    last one newly reached, and no text is read twice; what they name is looked up in
    an index of paths, which no round broadcasts.  Roots that are no files are left out; null texts name nothing.
    """
    adapters = adapters or Adapters()
    shelves = files if isinstance(files, Shelves) else Shelves(files)
    known = materialise(X.file_index(shelves.table.select("path")))
    looked = known.hint("merge")
    lang = language(extension(F.col("path")))
    reached, parsed = Levels(known.sparkSession), Levels(known.sparkSession)
    delta = reached.add(known.join(roots.select("path").distinct(), "path", "left_semi").select("path", lang.alias("language"), F.lit(0).alias("round")))
    own = [r[0] for r in delta.select("language").distinct().collect()]  # a name for each language
    mine = F.col("language").isin(*own) if own else F.lit(False)
    turn = 0
    for phase in [F.lit(True)] if every else [mine, ~mine]:
        delta = (reached.all() if turn else delta).where(phase)
        while not delta.isEmpty():
            turn += 1
            todo = parsed.add(delta.select("path"))
            named = materialise(adapters.matches(shelves.texts(todo)).drop("adapter"))
            found = X.resolved(named, looked).unionByName(X.companions(X.file_index(todo), looked)).select(F.col("dst").alias("path")).distinct()
            fresh = found.join(reached.all().select("path").hint("merge"), "path", "left_anti")
            delta = reached.add(fresh.select("path", lang.alias("language"), F.lit(turn).alias("round"))).where(phase)
    done = parsed.all().withColumn("parsed", F.lit(True)) if turn else known.select("path").where("false").withColumn("parsed", F.lit(True))
    return reached.all().join(done.hint("merge"), "path", "left").withColumn("parsed", F.coalesce("parsed", F.lit(False)))
