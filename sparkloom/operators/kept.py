"""A kept index: what files name and where it leads, brought up to date by what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract as X
from .adapters import Adapters

FILES = "path string, hash string, seen long, alive boolean"
MATCHES = "path string, spec string, rel string, how string, targets array<string>, seen long"
LINKS = "path string, spec string, rel string, how string, dst string, seen long, at long"
#: Versions after which the tables are written anew as one.
COMPACT = 8


class KeptIndex:
    """Tables of files, matches and links in ``folder`` (shared by driver and executors), one version for each update.

    A file's rows are those of the version that last saw its text change; a link's row is the latest for its match.  A version is
    complete when its files are written, which comes last: an update that failed before is written again.
    """

    def __init__(self, spark: SparkSession, folder: str, adapters: Adapters | None = None):
        self.spark, self.folder, self.adapters = spark, folder.rstrip("/"), adapters or Adapters()

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions."""
        path, fs = self._path("files")
        if not fs.exists(path):
            return []
        found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
        return sorted(v for v in found if fs.exists(self._path(f"files/v={v}/_SUCCESS")[0]))

    def _read(self, name: str, schema: str) -> DataFrame:
        live = self.versions()
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/v={v}" for v in live])

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.folder}/{name}/v={version}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def files(self) -> DataFrame:
        """(path, hash, seen): files as of the last update, with the version that last read their text."""
        latest = self._read("files", FILES).groupBy("path").agg(F.max_by(F.struct("hash", "seen", "alive"), "seen").alias("f"))
        return latest.where("f.alive").select("path", "f.hash", "f.seen")

    def matches(self) -> DataFrame:
        """What the texts of the current files name."""
        return self._read("matches", MATCHES).join(self.files().select("path", "seen"), ["path", "seen"], "left_semi")

    def _links(self) -> DataFrame:
        now = self._read("links", LINKS).join(self.files().select("path", "seen"), ["path", "seen"], "left_semi")
        return now.groupBy("path", "spec", "rel", "how", "seen").agg(F.max_by(F.struct("dst", "at"), "at").alias("l")).select("path", "spec", "rel", "how", "l.dst", "seen", "l.at").where("dst IS NOT NULL")

    def edges(self) -> DataFrame:
        """(src, dst, rel) of the current files."""
        known = X.file_index(self.files())
        found = self._links().select(F.col("path").alias("src"), "dst", "rel").unionByName(X.companions(known, known))
        return found.where("src <> dst").distinct()

    def update(self, files: DataFrame) -> DataFrame:
        """Take in ``files`` (path, content, and hash where the reader knows one): (path, change) of what differs, added, changed or removed.

        Only texts of added and changed files are read by an extractor.  A link is looked up again where its file changed, or where a
        path that came or went is among what it is looked up by; all other links stay.  A null text names nothing;
        one row of a repeated path counts.
        """
        content = F.coalesce("content", F.lit(""))
        rows = (files if "hash" in files.columns else files.withColumn("hash", F.sha2(content, 256))).dropDuplicates(["path"])
        version = max(self.versions(), default=0) + 1
        before, now = self.files(), rows.select("path", "hash")
        both = before.select("path", F.col("hash").alias("old")).join(now, "path", "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("old") != F.col("hash"), "changed")
        delta = self._write(both.select("path", "hash", change.alias("change")).where("change IS NOT NULL"), "changes", version)
        texts = rows.join(delta.where("change <> 'removed'").select("path"), "path", "left_semi")
        fresh = self.adapters.matches(texts.select("path", "content")).drop("adapter").withColumn("seen", F.lit(version).cast("long"))
        fresh = self._write(fresh.select("path", "spec", "rel", "how", "targets", "seen"), "matches", version)
        moved = delta.where("change <> 'changed'").select("path")
        keys = moved.select(F.concat(F.lit("/"), F.upper("path")).alias("key")).unionByName(X.file_index(moved).select(F.upper("stem").alias("key"))).distinct()
        # Matches of files whose text stayed, looked up by something that came or went.
        stayed = self.matches().join(delta.select("path"), "path", "left_anti")
        touched = X.lookup_keys(stayed).join(keys, "key", "left_semi").select("path", "spec", "rel", "how").distinct()
        again = stayed.join(touched, ["path", "spec", "rel", "how"], "left_semi").unionByName(fresh)
        known = X.file_index(before.select("path").join(delta.where("change = 'removed'").select("path"), "path", "left_anti").unionByName(delta.where("change = 'added'").select("path")))
        found = X.links(again, known)
        asked = again.select("path", "spec", "rel", "how", "seen").distinct().join(found, ["path", "spec", "rel", "how"], "left")
        self._write(asked.select("path", "spec", "rel", "how", "dst", "seen", F.lit(version).cast("long").alias("at")), "links", version)
        self._write(delta.select("path", "hash", F.lit(version).cast("long").alias("seen"), (F.col("change") != "removed").alias("alive")), "files", version)
        if len(self.versions()) > COMPACT:
            self._compact(version)
        return delta.select("path", "change")

    def _compact(self, version: int) -> None:
        """Write the current state as one version after ``version``, then forget the earlier ones."""
        old, new = self.versions(), version + 1
        self._write(self.matches(), "matches", new)
        self._write(self._links(), "links", new)
        state = self.files().withColumn("alive", F.lit(True))
        self._write(state.select("path", "hash", "seen", "alive"), "files", new)
        for v in old:
            for name in ("files", "matches", "links"):  # what changed is kept as a log
                path, fs = self._path(f"{name}/v={v}")
                fs.delete(path, True)
