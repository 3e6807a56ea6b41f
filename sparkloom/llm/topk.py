"""Exact top-k inner products, pruned by segment means and deviations.

With |x - q|**2 >= sum over segments of n * (mean difference)**2 + (deviation
difference)**2 as the lower bound of a distance, and <q, x> = (|q|**2 + |x|**2 - |x - q|**2) / 2,
a segment level bounds every score from above.  Levels go from few segments to
many; only vectors whose bound reaches a query's k-th best score so far go on, and the last
survivors get exact integer scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import bounds, sorted_groups
from .store import Workspace

#: Bytes of the vectors of a candidate block and of a query block; a task holds one of each.  The
#: larger they are, the fewer copies of a vector move: rows are copied once for each block of the other side.
CANDIDATE_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
#: Candidates of a block at least, while there are fewer blocks than shuffle partitions.
LEAST_CANDIDATES = 1024
LEVELS = (4, 16)
#: Pairs that are bounded or scored at once.
_PAIRS = 1 << 20
#: Survivors are scored by one product of matrices where they are more than this share of all pairs.
_DENSE = 0.02


def _cleaner(scale: float):
    def run(batches):
        for batch in batches:
            rows, data, dims = [], [], []
            for r, v in enumerate(batch.column(1)):
                if not v.is_valid or not batch.column(0)[r].is_valid:
                    continue
                x = v.values
                if x is None or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                rows.append(r)
                data.append(np.floor(scale * x).tobytes())
                dims.append(len(x))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "row", "dim", "v"])

    return run


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row, sqrt(n) * mean and the deviation's norm of each segment: their dot products bound scores."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1) if x.shape[1] else []:
        mean = part.mean(axis=1)
        out += [mean * np.sqrt(part.shape[1]), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0))


def is_small(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether all inner products are exact in doubles."""
    return max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) ** 2 * max(1, q.shape[1]) < 2**53


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products; exact beyond 2**53, limited to the range of a long."""
    if is_small(q, x):
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(high, max(low, sum(int(a) * int(b) for a, b in zip(r, s)))) for r, s in zip(q, x)], np.int64)


def survivors(q: np.ndarray, x: np.ndarray, stats_q: list, stats_x: list, banned: np.ndarray, k: int) -> np.ndarray:
    """(query, candidate) pairs whose bound at every level reaches the query's k-th score so far, as a mask."""
    slack = 1e-9 * np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :] + 1e-3
    bound = stats_q[0] @ stats_x[0].T + slack
    bound[banned] = -np.inf
    # The k vectors of highest coarse bound give each query a first k-th score.
    first = np.argpartition(-bound, min(k, x.shape[0] - 1), axis=1)[:, :k]
    floor = np.full(len(q), -np.inf)
    full = np.isfinite(np.take_along_axis(bound, first, 1)).all(axis=1) & (first.shape[1] == k)
    if full.any():
        rows = np.repeat(np.flatnonzero(full), k)
        floor[full] = exact_scores(q[rows], x[first[full].ravel()]).reshape(-1, k).min(axis=1)
    keep = (bound >= floor[:, None]) & np.isfinite(bound)
    for left, right in zip(stats_q[1:], stats_x[1:]):
        keep &= left @ right.T + slack >= floor[:, None]
    return keep


def block_top_k(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best of one block."""
    stats_x = [segment_stats(x, s) for s in LEVELS]
    small = is_small(q, x)
    step = max(1, _PAIRS // len(xid))
    found = []
    for a in range(0, len(qid), step):
        part = q[a : a + step]
        banned = qid[a : a + step, None] == xid[None, :]
        keep = survivors(part, x, [segment_stats(part, s) for s in LEVELS], stats_x, banned, k)
        if small and keep.mean() > _DENSE:
            score = np.where(keep, part @ x.T, -np.inf)
            if score.shape[1] > k:
                keep &= score >= np.partition(score, -k, axis=1)[:, -k, None]
            i, j = np.nonzero(keep)
            s = score[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(keep)
            s = np.concatenate([exact_scores(part[i[c : c + 16_384]], x[j[c : c + 16_384]]) for c in range(0, len(i), 16_384)]) if len(i) else np.zeros(0, np.int64)
        order = np.lexsort((xid[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        best = np.arange(len(i)) - np.searchsorted(i, np.arange(len(part)))[i] < k
        found.append((i[best] + a, j[best], s[best]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _searcher(k: int):
    def run(batches):
        for t in sorted_groups(batches, ["dim", "cblock", "qblock"]):
            ids, query = t.column("vec_id").to_numpy(), t.column("is_query").to_numpy()
            dims = t.column("dim").to_numpy()
            cut = bounds(t.column("_g").to_numpy())
            values, rows = t.column("v"), t.column("row").to_numpy()
            for a, b in zip(cut[:-1], cut[1:]):
                m = np.frombuffer(b"".join(values.slice(a, b - a).to_pylist()), np.float64).reshape(b - a, int(dims[a]))
                isq = query[a:b]
                if not isq.any() or isq.all():
                    continue
                qi, xi, xr = ids[a:b][isq], ids[a:b][~isq], rows[a:b][~isq]
                i, j, s = block_top_k(qi, m[isq], xi, m[~isq], k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(xi[j]), pa.array(xr[j]), pa.array(s)], ["query_id", "vec_id", "row", "score"])

    return run


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for rows whose id is divisible by ``every``.

    Components become floor(scale * x) in doubles; the score is their integer inner
    product; ties go to the smaller vec_id.  Vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part.  Vectors meet only
    those of their own length.  A query's own row is the one of its id, so rows that repeat an id
    are never answers to it.  Rows that repeat a query's id are one query: a candidate has the best of its scores
    with them.  Rows that repeat a candidate's id are answers of their own.  Fewer than k answers are all returned;
    an empty table gives none.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))
    clean = ws.save(source.mapInArrow(_cleaner(scale), "vec_id long, row long, dim int, v binary"), "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    total, asked, dim = clean.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max("dim")).first()
    size = 8 * max(1, dim or 1)
    cblocks, qblocks = max(1, -(-total * size // CANDIDATE_BYTES)), max(1, -(-asked * size // QUERY_BYTES))
    cblocks = max(cblocks, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_CANDIDATES)))
    part = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = clean.select("dim", part(cblocks, 1).alias("cblock"), every_block(qblocks).alias("qblock"), "vec_id", "row", F.lit(False).alias("is_query"), "v")
    q = clean.where(is_query).select("dim", every_block(cblocks).alias("cblock"), part(qblocks, 2).alias("qblock"), "vec_id", "row", F.lit(True).alias("is_query"), "v")
    keys = ["dim", "cblock", "qblock"]
    met = x.unionByName(q).repartition(*keys).sortWithinPartitions(*keys)
    partial = met.mapInArrow(_searcher(k), "query_id long, vec_id long, row long, score long")
    one = partial.groupBy("query_id", "vec_id", "row").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
