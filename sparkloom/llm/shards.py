"""Training-order shards: a keyed permutation of sequences, written at a fixed stride.

Documents follow each other in sequences of exactly ``stride`` ids, each ended by its id 0,
so only the last sequence of an input split is padded.  Every sequence has a number.  A
Feistel network over the smallest even number of bits that holds the count, walked until it
falls inside, is a permutation of those numbers, computed row by row without any shared state.
Slot s is row ``s % per_shard`` of shard ``s // per_shard``, so a reader seeks to any slot.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import U, mix, stream
from .store import Workspace
from .tokens import encoder, tokenizer_path

ROUNDS = 6
#: Ids repeat over long distances, so pages of several MB compress better.
PAGES = {"parquet.page.size": str(4 << 20)}
#: Tasks that write shards, at most; each takes a range of them.
MAX_TASKS = 10_000
#: Bytes of one shard file unless the caller says otherwise.
SHARD_BYTES = 8 << 20
#: Sequences that a task sorts by shard and compresses together before they move.
BLOCK_ROWS = 16_384
PARTS = "array<struct<doc_id:bigint,start:bigint,offset:int,length:int,ids_crc32:bigint>>"


def feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The permutation of range(n) named by ``key``, or its inverse, for the numbers in ``x``."""
    half = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    mask = U((1 << half) - 1)
    keys = stream(key, ROUNDS)
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> U(half), v & mask
        with np.errstate(over="ignore"):
            for r in order:
                if inverse:
                    left, right = right ^ (mix(left + keys[r]) & mask), left
                else:
                    left, right = right, left ^ (mix(right + keys[r]) & mask)
        out[todo] = (left << U(half)) | right
        todo = todo[out[todo] >= U(n)]  # cycle-walking: step on until inside
    return out.astype(np.int64)


def _sequencer(path: str, stride: int):
    """Sequences of ``stride`` uint16 ids and the parts of documents in each; one stream per task."""
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("offset", pa.int32()), ("length", pa.int32()), ("ids_crc32", pa.int64())]))

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], kind)], ["ids", "parts"])

    def run(batches):
        enc = encoder(path)
        rows, ids, parts, used = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                data = enc.encode(text.as_py() or b"") + b"\0\0\0\0"
                start, total = 0, len(data) // 4
                if np.frombuffer(data, "<u4").max() > 65_535:
                    raise ValueError("shards hold uint16 ids: the vocabulary is too large")
                while start < total:
                    n = min(stride - used, total - start)
                    piece = data[4 * start : 4 * (start + n)]
                    ids.append(piece)
                    parts.append({"doc_id": doc, "start": start, "offset": used, "length": n, "ids_crc32": zlib.crc32(piece)})
                    start, used = start + n, used + n
                    if used == stride:
                        rows.append((np.frombuffer(b"".join(ids), "<u4").astype("<u2").tobytes(), parts))
                        ids, parts, used = [], [], 0
                        if len(rows) >= 512:
                            yield out(rows)
                            rows = []
        if used:
            rows.append((np.frombuffer(b"".join(ids), "<u4").astype("<u2").tobytes() + bytes(2 * (stride - used)), parts))
        if rows:
            yield out(rows)

    return run


def _slotter(n: int, key: int, per_shard: int):
    """Blocks of one shard's sequences, compressed for the one time that they move."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield blocks(held, pack)
                held, size = [], 0
        if size:
            yield blocks(held, pack)

    def blocks(held, pack):
        t = pa.Table.from_batches(held)
        slot = feistel(t.column("number").to_numpy(), n, key)
        order = np.argsort(slot)
        slot = slot[order]
        ids = t.column("ids").take(pa.array(order)).to_pylist()
        shard = slot // per_shard
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(slot)]])
        pairs = list(zip(cut[:-1], cut[1:]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(shard[a]) for a, _ in pairs], pa.int64()),
                pa.array([(slot[a:b] % per_shard).astype("<i4").tobytes() for a, b in pairs], pa.binary()),
                pa.array([pack(b"".join(ids[a:b])) for a, b in pairs], pa.binary()),
            ],
            ["shard", "rows", "block"],
        )

    return run


def _writer(folder: str, stride: int, n: int, per_shard: int):
    """Write each shard whole under its name; a task that runs again writes the same bytes."""

    def run(batches):
        from pyarrow import fs

        unpack = zstandard.ZstdDecompressor().decompress
        # Spark's name of the same store.
        store, base = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        store.create_dir(base, recursive=True)

        def close(shard, data):
            body = data.tobytes()
            name, mark = f"{base}/shard-{shard:08d}.bin", zlib.crc32(body)
            with store.open_output_stream(f"{name}.{mark:08x}.part") as f:
                f.write(body)
            store.move(f"{name}.{mark:08x}.part", name)
            crcs = [zlib.crc32(r) for r in data]
            return pa.RecordBatch.from_arrays([pa.array(range(shard * per_shard, shard * per_shard + len(data)), pa.int64()), pa.array(crcs, pa.int64())], ["slot", "row_crc32"])

        shard, data = None, None
        for b in batches:
            for s, rows, block in zip(*(b.column(c).to_pylist() for c in ("shard", "rows", "block"))):
                if s != shard:
                    if data is not None:
                        yield close(shard, data)
                    shard, data = s, np.zeros((min(per_shard, n - s * per_shard), stride), "<u2")
                data[np.frombuffer(rows, "<i4")] = np.frombuffer(unpack(block), "<u2").reshape(-1, stride)
        if data is not None:
            yield close(shard, data)

    return run


def write_shards(
    docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, stride: int = 512, shard_bytes: int = SHARD_BYTES, key: int = 2024
) -> DataFrame:
    """Write the ids of ``docs`` as shards at once; returns the saved manifest, one row per part of a document.

    doc_id, start and length tell the part of the document's ids (the tokenizer's, then id 0;
    a null or empty text is the one id 0), ids_crc32 is that of its little-endian uint32 ids; slot, shard,
    byte_offset and offset tell where it lies; row_crc32 is the whole row's.  Rows hold ``stride``
    little-endian uint16 ids, 0 after the end of a split's last sequence; a shard has ``shard_bytes // (2 * stride)``
    rows.  Sequences are written once and numbered as they lie in that table, so numbering moves
    nothing; the ids move once, to their shard, and a task holds one shard.  Null ids stay null, repeated rows are documents of their own,
    other columns are not read.  An empty table writes no shard.
    """
    ws = Workspace(docs.sparkSession, "shards")
    per_shard = max(1, shard_bytes // (2 * stride))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = source.mapInArrow(_sequencer(path or tokenizer_path(), stride), f"ids binary, parts {PARTS}")
    placed_at = F.monotonically_increasing_id()
    table = ws.save(cut.withColumn("part", F.shiftright(placed_at, 33).cast("int")).withColumn("row", placed_at.bitwiseAND(F.lit((1 << 33) - 1))), "sequences", compression="zstd", **PAGES)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per input split, written so that Spark knows its size and broadcasts it only where it is small.
    counts = ws.save(table.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "counts")
    n = table.count()
    numbered = table.join(counts.select("part", "before"), "part").withColumn("number", F.col("before") + F.col("row"))
    moved = numbered.select("ids", "number").mapInArrow(_slotter(max(n, 1), key, per_shard), "shard long, rows binary, block binary")
    # The permutation fills every shard, so equal ranges of shards need no sampling for their bounds.
    shards = max(1, -(-n // per_shard))
    each = -(-shards // MAX_TASKS)
    dealt = moved.repartitionById(-(-shards // each), F.expr(f"int(shard div {each})")).sortWithinPartitions("shard")
    written = ws.save(dealt.mapInArrow(_writer(folder, stride, n, per_shard), "slot long, row_crc32 long"), "written")
    slots = numbered.select("parts", "number").mapInArrow(_numbered(max(n, 1), key), f"parts {PARTS}, slot long")
    rows = slots.join(written, "slot").select("slot", "row_crc32", F.explode("parts").alias("p"))
    place = F.expr(f"slot % {per_shard}")
    manifest = rows.select(
        "p.doc_id", "p.start", "p.length", "slot", F.expr(f"slot div {per_shard}").alias("shard"), (place * (2 * stride)).alias("byte_offset"), "p.offset", "p.ids_crc32", "row_crc32"
    )
    return ws.save(manifest, "manifest")


def _numbered(n: int, key: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("parts"), pa.array(feistel(b.column("number").to_numpy(), n, key))], ["parts", "slot"])

    return run


def read_slots(spark: SparkSession, folder: str, *, stride: int = 512, shard_bytes: int = SHARD_BYTES, start: int = 0) -> DataFrame:
    """(shard, row, ids) of every written row from slot ``start`` on, by Spark's binary reader."""
    per_shard = max(1, shard_bytes // (2 * stride))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    name = F.regexp_extract("path", r"shard-(\d+)\.bin", 1).cast("long")

    def cut(batches):
        for b in batches:
            for s, data in zip(b.column("shard").to_pylist(), b.column("content").to_pylist()):
                rows = [data[i : i + 2 * stride] for i in range(0, len(data), 2 * stride)]
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.binary())], ["shard", "row", "ids"])

    files = files.select(name.alias("shard"), "content").where(F.col("shard") >= start // per_shard)
    rows = files.mapInArrow(cut, "shard long, row long, ids binary")
    return rows.where(F.col("shard") * per_shard + F.col("row") >= start)
