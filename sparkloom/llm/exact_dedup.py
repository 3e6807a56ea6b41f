"""Exact duplicates through an extendible-hash index on shared files.

A directory maps the leading bits of a text's 64-bit key to a bucket.  It starts with one bucket
and doubles where needed: a bucket with more rows than fit is split by one more bit until each
fits.  A bucket is a range of keys.  Its owner task gets the rows of that range in key order, chains
texts whose keys collide, compares bytes within each chain and writes the bucket's entries.  A
bucket that no further bit can split (many copies of one text) is dealt to several owners;
their chain heads, one per text and owner, then meet and are compared byte for byte in turn.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import bounds, sorted_groups
from .store import Workspace

#: Leading bits that are counted for the directory at first, and those by which overfull slots are counted anew.
FIRST_BITS, MORE_BITS = 16, 8
#: A bucket holds so many rows, or the 32,768th part of the table where that is more, which is twice the mean of a slot of
#: 16 bits: at any size of the table only slots with a hot key are overfull, and the directory has 65,536 buckets and some more for those.
LEAST_CAPACITY = 1_000


@dataclass(frozen=True)
class Bucket:
    """Keys whose leading ``depth`` bits equal ``prefix``; ``parts`` owners share its rows."""

    prefix: int
    depth: int
    rows: int
    parts: int = 1


def directory(counts: dict[int, int], capacity: int, bits: int, prefix: int = 0, depth: int = 0) -> list[Bucket]:
    """Buckets in key order below (``prefix``, ``depth``), from row counts by ``bits`` further bits.

    The directory doubles one bit at a time: an overfull bucket becomes two of one more bit.
    One that is still overfull at the last counted bit stays so.
    """
    level = dict(counts)
    tree = [level]
    for _ in range(bits):
        up: dict[int, int] = {}
        for k, n in level.items():
            up[k >> 1] = up.get(k >> 1, 0) + n
        level = up
        tree.append(level)
    tree.reverse()  # tree[d]: rows by d leading bits
    done, todo = [], [(0, 0)]
    while todo:
        p, d = todo.pop()
        n = tree[d].get(p, 0)
        if n <= capacity or d == bits:
            done.append(Bucket((prefix << d) | p, depth + d, n))
        else:
            todo += [(2 * p, d + 1), (2 * p + 1, d + 1)]
    return sorted(done, key=lambda b: b.prefix << (64 - b.depth))


def capacity_for(rows: int) -> int:
    """Rows of a bucket in a table of ``rows``."""
    return max(LEAST_CAPACITY, rows >> (FIRST_BITS - 1))


def slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int")


def build_directory(keys: DataFrame, capacity: int) -> list[Bucket]:
    """The directory of a table's ``key``: counts by 16 bits, then by 8 more where a slot is overfull.

    The driver holds counts of slots, not of rows: 65,536 and 256 for each overfull slot.  With
    ``capacity_for`` a slot is overfull only where a key is hot, so there are at most 32,768 of
    them, and as many as there are hot keys in a table of the usual kind.
    """
    counts = {r[0]: r[1] for r in keys.groupBy(slot(F.col("key"), FIRST_BITS).alias("s")).count().collect()}
    buckets = directory(counts, capacity, FIRST_BITS)
    over = [b.prefix for b in buckets if b.rows > capacity]
    if over:
        deep = FIRST_BITS + MORE_BITS
        chosen = keys.where(slot(F.col("key"), FIRST_BITS).isin(over))
        fine: dict[int, dict[int, int]] = {}
        for s, n in chosen.groupBy(slot(F.col("key"), deep).alias("s")).count().collect():
            fine.setdefault(s >> MORE_BITS, {})[s & ((1 << MORE_BITS) - 1)] = n
        split = []
        for b in buckets:
            split += directory(fine.get(b.prefix, {}), capacity, MORE_BITS, b.prefix, b.depth) if b.rows > capacity else [b]
        buckets = split
    return [Bucket(b.prefix, b.depth, b.rows, max(1, -(-b.rows // capacity))) for b in buckets]


def _finder(buckets: list[Bucket]):
    """The bucket and part of each row: a search in the directory's first keys, and a hash of the row's place."""
    low = np.array([b.prefix << (64 - b.depth) for b in buckets], np.uint64)
    parts = np.array([b.parts for b in buckets], np.int64)

    def run(batches):
        for b in batches:
            at = np.searchsorted(low, b.column("key").to_numpy().view(np.uint64), "right") - 1
            part = b.column("spread").to_numpy() % parts[at]
            cols = [b.column(c) for c in ("doc_id", "key", "text")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32))], ["doc_id", "key", "text", "bucket", "part"])

    return run


OWNED = "doc_id long, bucket int, part int, key long, chain int, first boolean, keep_id long, group_size long, text_sha256 string, head string"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]


class _Chains:
    """The chain of texts of one key: rows join the first text that equals theirs byte for byte."""

    def __init__(self):
        self.heads: list[bytes] = []
        self.members: list[list] = []

    def add(self, text: bytes, doc) -> None:
        for i, head in enumerate(self.heads):
            if head == text:
                self.members[i].append(doc)
                return
        self.heads.append(text)
        self.members.append([doc])


def _largest(ids):
    return max((i for i in ids if i is not None), default=None)


def _owner(shared: np.ndarray):
    """Entries and rows of each key that this task owns; heads are kept where other owners have the bucket too."""

    def rows_of(place, chains):
        bucket, part, key = place
        for c, (head, ids) in enumerate(zip(chains.heads, chains.members)):
            keep, digest = _largest(ids), hashlib.sha256(head).hexdigest()
            for i, doc in enumerate(ids):
                yield doc, bucket, part, key, c, i == 0, keep, len(ids), digest, head.decode() if i == 0 and shared[bucket] else None

    def run(batches):
        place, chains, out, size = None, None, [], 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("bucket", "part", "key", "doc_id")]
            for *at, doc, text in zip(*columns, b.column("text").cast(pa.large_binary())):
                if at != place:
                    if chains is not None:
                        out += rows_of(place, chains)
                    place, chains = at, _Chains()
                    if len(out) >= 4096:
                        yield batch(out)
                        out = []
                chains.add(text.as_py(), doc)
        if chains is not None:
            out += rows_of(place, chains)
        if out:
            yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], [x.split()[0] for x in OWNED.split(", ")])

    return run


MERGED = "bucket int, part int, key long, chain int, m_keep long, m_size long"


def _merger(batches):
    """Chains of one key over all owners of its bucket: heads are compared byte for byte.

    Only heads that share a digest with other bytes come here.
    """
    for t in sorted_groups(batches, ["bucket", "key"]):
        cut = bounds(t.column("_g").to_numpy())
        col = {c: t.column(c).to_pylist() for c in ("bucket", "part", "key", "chain", "keep_id", "group_size", "head")}
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            groups: dict[str, list[int]] = {}
            for i in range(a, b):
                groups.setdefault(col["head"][i], []).append(i)
            for rows in groups.values():
                keep, n = _largest(col["keep_id"][i] for i in rows), sum(col["group_size"][i] for i in rows)
                out += [(col["bucket"][i], col["part"][i], col["key"][i], col["chain"][i], keep, n) for i in rows]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in MERGED.split(", ")])


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=None,
    capacity: int | None = None,
    key_bits: int = 64,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after ``normalise`` (a function of a
    Column) where given; a null text is empty.  Of equal texts the largest
    doc_id stays.  Rows that repeat a doc_id and its text count in group_size and all
    stay; those that repeat a doc_id with other texts are judged apart.  A null doc_id is smaller than any.  Other columns
    are not read; an empty table gives no rows.  ``capacity`` is the rows of a bucket (see ``LEAST_CAPACITY``);
    ``key_bits`` shortens the hash key, for tests of chains.
    """
    ws = Workspace(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    key = F.xxhash64("text") if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 64 - key_bits), 64 - key_bits)
    keyed = source.withColumn("key", key)

    keys = ws.save(keyed.select("key"), "keys")
    capacity = capacity or capacity_for(keys.count())
    buckets = build_directory(keys, capacity)
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 1)
    found = keyed.withColumn("spread", spread).mapInArrow(_finder(buckets), "doc_id long, key long, text string, bucket int, part int")
    shared = np.array([b.parts > 1 for b in buckets])
    owned = ws.save(found.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key").mapInArrow(_owner(shared), OWNED), "index")
    if not shared.any():
        return _told(owned)

    split = F.col("bucket").isin([i for i, s in enumerate(shared) if s]) if shared.sum() < 500 else F.lit(True)
    # Owners of a hot text hold the same head each: they meet by digest, in partial aggregates that tell by the least and
    # greatest bytes whether all are one text, so one head of each digest moves from a task.
    heads = owned.where(F.col("first") & F.col("head").isNotNull())
    same = ["bucket", "key", "text_sha256"]
    met = ws.save(heads.groupBy(*same).agg(F.max("keep_id").alias("m_keep"), F.sum("group_size").alias("m_size"), F.min("head").alias("low"), F.max("head").alias("high")), "met")
    chains = heads.select("bucket", "part", "key", "chain", "text_sha256").join(met.where("low = high").select(*same, "m_keep", "m_size"), same)
    merged = chains.select("bucket", "part", "key", "chain", "m_keep", "m_size")
    unlike = met.where("low <> high").select(*same)
    if not unlike.isEmpty():
        apart = heads.join(unlike, same, "left_semi").select("bucket", "part", "key", "chain", "keep_id", "group_size", "head")
        merged = merged.unionByName(apart.repartition("bucket", "key").sortWithinPartitions("bucket", "key").mapInArrow(_merger, MERGED))
    merged = ws.save(merged, "merged")
    rest = owned.where(split).drop("head").join(merged, ["bucket", "part", "key", "chain"], "left")
    rest = rest.withColumn("keep_id", F.when(F.col("m_size").isNull(), F.col("keep_id")).otherwise(F.col("m_keep"))).withColumn("group_size", F.coalesce("m_size", "group_size"))
    told = _told(rest)
    return told if shared.sum() >= 500 else _told(owned.where(~split)).unionByName(told)


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
