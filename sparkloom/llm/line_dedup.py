"""Line dedup over levelled sorted runs of line hashes.

One pass over the texts writes a row per document: its lines' number, its digest and the
hashes of its long lines.  A run is a table of (k1, k2, n_docs, top_doc), one row per key,
bucketed and sorted by key.  Batches come newest (largest documents) first.  A batch's keys
merge-anti-join the runs, bucket by bucket: what is left is new, and its last document is in
this batch; of known keys only the count is added.  Both go into a run of level 0; a level of
``fanout`` runs is merged into one run of the next.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace

SPACE = b" \t\n\v\f\r"
KEYS = ["k1", "k2"]


def line_key(line: bytes, least: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None where the key is under ``least`` code points."""
    import xxhash

    key = line.strip(SPACE)
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(key.lower())


READ = "doc_id long, n_lines long, sha string, keys binary"


def _reader(least: int):
    """Per document: the number of its lines, its digest, and the hashes of its distinct long lines, 16 bytes each."""

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).cast(pa.large_binary()):
                text = t.as_py() or b""
                lines = text.split(b"\n")
                keys = {k for line in lines if (k := line_key(line, least)) is not None}
                out.append((len(lines), hashlib.sha256(text).hexdigest(), b"".join(keys)))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.binary()))] if out else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_lines", "sha", "keys"])

    return run


def _unpacked(batches):
    for batch in batches:
        data = batch.column("keys").to_pylist()
        k = np.frombuffer(b"".join(data), "<i8").reshape(-1, 2)
        rows = np.repeat(np.arange(len(data)), [len(d) // 16 for d in data])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(k[:, 0]), pa.array(k[:, 1])], ["doc_id", *KEYS])


def line_keys(read: DataFrame) -> DataFrame:
    """(doc_id, k1, k2) of each document's distinct long lines."""
    return read.where(F.length("keys") > 0).select("doc_id", "keys").mapInArrow(_unpacked, "doc_id long, k1 long, k2 long")


def _rebuilder(least: int, with_text: bool):
    def run(batches):
        for batch in batches:
            out = {"n_lines": [], "n_dropped": [], "kept_sha256": [], "kept_text": []}
            for t, gone in zip(batch.column("text").cast(pa.large_binary()), batch.column("gone")):
                text = t.as_py() or b""
                lines = text.split(b"\n")
                kept = lines
                if gone.is_valid and len(gone):
                    drop = {np.array([g["k1"], g["k2"]], np.int64).tobytes() for g in gone.as_py()}
                    kept = [x for x in lines if line_key(x, least) not in drop]
                    text = b"\n".join(kept)
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if with_text:
                    out["kept_text"].append(text.decode())
            cols = [batch.column("doc_id"), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                cols.append(pa.array(out["kept_text"], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


class LineRuns:
    """The levels of runs; ``add`` takes a batch of (doc_id, k1, k2), newest batch first."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex[:16]}"
        df.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch; a document counts once for a key, however many rows repeat it, and a null doc_id never."""
        batch = lines.groupBy(*KEYS).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("top_doc"))
        fresh = batch
        for name in self.names():
            fresh = fresh.join(self.spark.table(name).select(*KEYS), KEYS, "left_anti")
        if self.names():
            known = batch.join(fresh.select(*KEYS), KEYS, "left_anti").withColumn("top_doc", F.lit(None).cast("long"))
            fresh = fresh.unionByName(known)
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            self._drop(full)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """Merge runs pairwise; they share buckets and order, so nothing is shuffled."""
        out = self.spark.table(names[0]).select(*KEYS, "n_docs", "top_doc")
        for n in names[1:]:
            other = self.spark.table(n).select(*KEYS, F.col("n_docs").alias("_n"), F.col("top_doc").alias("_top"))
            out = out.join(other, KEYS, "full").select(
                *KEYS, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("top_doc", "_top").alias("top_doc")
            )
        return out

    def merged(self) -> DataFrame:
        """(k1, k2, n_docs, top_doc) over all runs."""
        return self._merged(self.names())

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def clear(self) -> None:
        self._drop(self.names())
        self.levels = []


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 2,
    with_text: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256[, kept_text].

    Texts are split at \\n; a line's key is the line without ASCII white space at
    its ends and with A-Z lower-cased.  A key of at least ``min_chars`` code
    points that at least ``min_docs`` documents hold loses all its lines except
    those of the largest doc_id that holds it.  A null or empty text is one empty
    line.  Rows that repeat a doc_id are one document in the count
    and are cleaned alike.  A row with a null doc_id counts for no key and keeps its lines.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lines")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = ws.save(source.mapInArrow(_reader(min_chars), READ), "read")
    low, high = read.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        cuts = [0, 0]
    else:
        cuts = [low + (high - low + 1) * i // batches for i in range(batches)] + [high + 1]
    runs = LineRuns(spark, fanout)
    try:
        for a, b in list(zip(cuts[:-1], cuts[1:]))[::-1]:
            runs.add(line_keys(read.where((F.col("doc_id") >= a) & (F.col("doc_id") < b))))
        common = ws.save(runs.merged().where(F.col("n_docs") >= min_docs).select(*KEYS, "top_doc"), "common")
    finally:
        runs.clear()
    # A document's own lines bound the set.
    gone = line_keys(read).join(common, KEYS).where("doc_id < top_doc").groupBy("doc_id").agg(F.collect_set(F.struct(*KEYS)).alias("gone"))
    gone = ws.save(gone, "gone")
    out = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    # The texts meet what they lose by sorting at every size: what is lost grows with the corpus and is no side to broadcast.
    gone = gone.hint("merge")
    if with_text:
        return source.join(gone, "doc_id", "left").mapInArrow(_rebuilder(min_chars, True), out)
    # Only texts that lose lines are built anew; of all others the first pass knows the digest.
    whole = read.join(gone.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("sha").alias("kept_sha256"))
    return source.join(gone, "doc_id").mapInArrow(_rebuilder(min_chars, False), out).unionByName(whole)
