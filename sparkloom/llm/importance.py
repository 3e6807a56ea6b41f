"""Importance resampling towards a target corpus, on hashed runs of words."""

from __future__ import annotations

import hashlib
import math
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import cut, plain
from .order import placed
from .store import Workspace

#: Features are hashed into so many buckets; tables of that length go to the driver and to every task.
BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 3
#: Bytes of text that a chunk owns; texts of more are dealt out by chunks.
CHUNK_BYTES = 32 << 10


def buckets(words: list[bytes], carried: int = 0) -> np.ndarray:
    """Buckets of all runs of 1 to ``RUN`` words that start before the last ``carried`` words."""
    own = len(words) - carried
    spaced = [b" " + w for w in words]
    run = list(map(crc32, words))
    runs = [run[:own]]
    for n in range(1, RUN):
        run = list(map(crc32, spaced[n:], run))  # the checksum goes on from that of the run before its last word
        runs.append(run[:own])
    return np.fromiter(chain.from_iterable(runs), np.int64, sum(map(len, runs))) % BUCKETS


def _pieces(text: str | None):
    """(words, carried) of each chunk of a text."""
    data = plain(text)
    for start, end, carried in cut(data, CHUNK_BYTES, RUN - 1):
        yield data[start:end].split(), carried


def _split(batches):
    """Chunks of long texts as rows: doc_id, digest of the text, chunk, carried, body."""
    for b in batches:
        for i, text in enumerate(b.column("text").to_pylist()):
            data = plain(text)
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            spans = list(cut(data, CHUNK_BYTES, RUN - 1))
            for at in range(0, len(spans), 256):
                part = spans[at : at + 256]
                n = len(part)
                columns = [
                    b.column("doc_id").take(pa.array([i] * n)), pa.array([digest] * n), pa.array(range(at, at + n), pa.int32()),
                    pa.array([c for _, _, c in part], pa.int32()), pa.array([data[s:e] for s, e, _ in part], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "chunk", "carried", "body"])


def _rows(batch):
    """(row, words, carried) of a batch of chunks or of texts."""
    if "body" in batch.schema.names:
        for i, (body, carried) in enumerate(zip(batch.column("body").to_pylist(), batch.column("carried").to_pylist())):
            yield i, body.split(), carried
    else:
        for i, text in enumerate(batch.column("text").to_pylist()):
            for words, carried in _pieces(text):
                yield i, words, carried


def _count(batches):
    """Each partition's own counts, one row a bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, words, carried in _rows(b):
            total += np.bincount(buckets(words, carried), minlength=BUCKETS)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])


def _weigh(gains: np.ndarray):
    def run(batches):
        for b in batches:
            n_words, n_features, weight = np.zeros((3, b.num_rows), np.int64)
            for i, words, carried in _rows(b):
                found = buckets(words, carried)
                n_words[i] += len(words) - carried
                n_features[i] += len(found)
                weight[i] += gains[found].sum()
            keep = [c for c in ("doc_id", "digest", "chunk") if c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n_words), pa.array(n_features), pa.array(weight)], [*keep, "n_words", "n_features", "weight"])

    return run


def noise(seed: int, doc_id) -> int:
    """A Gumbel draw in thousandths, fixed by the seed and the id; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(seed: int):
    def run(batches):
        for b in batches:
            drawn = np.array([noise(seed, x) for x in b.column("doc_id").to_pylist()], np.int64)
            score = pa.array(b.column("weight").to_numpy() + drawn)
            yield pa.RecordBatch.from_arrays([*b.columns, score], [*b.schema.names, "score"])

    return run


def _long(text: Column) -> Column:
    return F.octet_length(text) > CHUNK_BYTES


def _sides(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Short texts as they lie, and the chunks of long ones dealt out over all tasks."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    short = texts.where(~F.coalesce(_long(F.col("text")), F.lit(False)))
    chunks = texts.where(_long(F.col("text"))).mapInArrow(_split, f"doc_id {kind}, digest binary, chunk int, carried int, body binary")
    return short, chunks.repartition("doc_id", "digest", "chunk")


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of ``texts`` (doc_id, text): ``BUCKETS`` numbers on the driver."""
    short, chunks = _sides(texts)
    counted = short.mapInArrow(_count, "bucket int, n long").unionByName(chunks.mapInArrow(_count, "bucket int, n long"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    top_s, top_t = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratio = ((float(t + 1) * top_s) / (float(s + 1) * top_t) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def importance_sample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_words, n_features, weight, score, rank.

    ``weight`` is the sum of the gains of a text's runs of words, ``score`` adds a Gumbel draw, so
    that the highest scores are a sample without replacement with odds by weight.  ``rank``
    numbers the ``percent`` of texts of at least ``least_words`` words that are drawn (all others:
    null), ties to the smaller doc_id.

    Buckets are counted in one pass over all texts and weighed in a second one.  A long text is
    split at word boundaries into chunks that carry the next ``RUN - 1`` words and own the runs
    which start in them; chunks move to any task, and their sums meet again by document.

    A null or empty text has no features and weighs 0.  Rows that repeat an id are judged apart
    by their text; a null id draws as an empty one and comes last among ties.  Only ``doc_id``
    and ``text`` are read, so other columns may have any names.  An empty table gives no rows;
    an empty target has all gains from smoothing.
    """
    ws = Workspace(docs.sparkSession, "importance")
    texts = docs.select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    gains = bucket_gains(bucket_counts(texts), bucket_counts(target.select(F.lit(0).alias("doc_id"), "text")))
    short, chunks = _sides(texts)
    sums = "n_words long, n_features long, weight long"
    whole = short.mapInArrow(_weigh(gains), f"doc_id {kind}, {sums}")
    parts = chunks.mapInArrow(_weigh(gains), f"doc_id {kind}, digest binary, chunk int, {sums}")
    # Rows that repeat an id and its text are summed as one and then repeated.
    met = parts.groupBy("doc_id", "digest").agg(F.sum(F.when(F.col("chunk") == 0, 1)).alias("copies"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    met = met.select("doc_id", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
    measured = whole.unionByName(met.drop("_")).mapInArrow(_scored(seed), f"doc_id {kind}, {sums}, score long")
    measured = ws.save(measured, "measured")
    fit = F.col("n_words") >= least_words
    drawn = measured.where(fit).count() * percent // 100
    ranked = placed(measured.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id")], ws)
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return ranked.unionByName(measured.where(~fit).withColumn("rank", F.lit(None).cast("long")))
