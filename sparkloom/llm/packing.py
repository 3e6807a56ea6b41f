"""Vector best-fit packing of pieces into sequences.

Pieces of equal length are interchangeable, so the packing is decided on the
histogram of lengths (at most ``tokens`` rows, whatever the corpus) and then
dealt to the pieces by their rank among equals.  The decision is the sequential
best-fit-decreasing rule over the whole corpus, with equal bins kept as one
class with a multiplicity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

#: Pieces of one length that one task numbers.
RANK_ROWS = 10_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold in all; attention cost is the sum of squared lengths."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


def demand(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


def best_fit(histogram: list[tuple[int, int]], capacity: Capacity, weights=(1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first bin, offset) and the number of bins.

    Lengths go from long to short.  Among the open bin classes that can take a
    piece under every capacity, ``norm`` picks the least weighted norm of what
    would remain and ``dot`` the least weighted dot product of demand and
    residual, both in shares of the capacities; ties go to the older class.  A bin is
    filled with pieces of the length before the next one, as the sequential rule
    would.
    """
    cap = capacity.vector()
    w = np.array(weights)
    free = np.zeros((0, 3), np.int64)
    base, mult, used = (np.zeros(0, np.int64) for _ in range(3))
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length, count in sorted(histogram, reverse=True):
        d = demand(length)
        if (d > cap).any():
            raise ValueError(f"a piece of length {length} is over the capacity {capacity}")
        rank, left = 0, count
        while left:
            ok = np.flatnonzero((free >= d).all(axis=1) & (mult > 0))
            if len(ok):
                rest = (free[ok] - d) / cap
                score = (w * rest * rest).sum(axis=1) if rule == "norm" else (w * (d / cap) * (free[ok] / cap)).sum(axis=1)
                c = int(ok[score.argmin()])
                f, first, m, at = free[c].copy(), int(base[c]), int(mult[c]), int(used[c])
            else:
                c, f, at = -1, cap, 0
                first, m = bins, left
            each = int((f // d).min())
            whole = min(m, left // each)
            takes = [(whole, each)] if whole else []
            if whole < m and (tail := left - whole * each) and tail < each:
                takes.append((1, tail))
            taken = 0
            for n_bins, t in takes:
                for k in range(t):
                    runs.append((length, rank, n_bins, first + taken, at + k * length))
                    rank += n_bins
                left -= n_bins * t
                free = np.vstack([free, f - t * d])
                base, mult, used = np.append(base, first + taken), np.append(mult, n_bins), np.append(used, at + t * length)
                taken += n_bins
            if c >= 0:
                base[c] += taken
                mult[c] -= taken
            else:
                bins += taken
        keep = mult > 0
        free, base, mult, used = free[keep], base[keep], mult[keep], used[keep]
    return np.array(runs, np.int64).reshape(-1, 5), bins


def _dealer(runs: np.ndarray):
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    key = (runs[:, 0] << 40) + runs[:, 1]

    def deal(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = runs[np.searchsorted(key, (length << 40) + rank, "right") - 1]
            cols = [b.column(n) for n in b.schema.names if n != "rank"]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r[:, 3] + rank - r[:, 1]), pa.array(r[:, 4])], [*names, "sequence_id", "offset"])

    return deal


def pack(pieces: DataFrame, *, capacity: Capacity | None = None, weights=(1.0, 0.01, 0.01), rule: str = "norm") -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    Every piece gets a place; places in a sequence are gapless from 0 and no
    sequence is over any capacity.  Pieces of length 0 or null are an error of the
    caller, as is one over a capacity.  Equal pieces of repeated rows get
    different places.  Extra columns of any names are carried; ``sequence_id`` and ``offset``
    of an earlier packing are replaced.  An empty table gives an empty result.
    """
    capacity = capacity or Capacity()
    ws = Workspace(pieces.sparkSession, "pack")
    # Columns go by place, so that none clashes with a name used here; places of an earlier packing are replaced.
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    names = [{"doc_id": "doc_id", "piece": "piece", "length": "length"}.get(c, f"_c{i}") for i, c in enumerate(kept)]
    # A salt of the row's place is written with it: rows that are equal in all else lie in different chunks.
    salt = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()).alias("_salt")
    table = ws.save(pieces.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], salt), "pieces")
    histogram = [(int(r[0]), int(r[1])) for r in table.groupBy("length").count().collect()]  # at most `tokens` rows
    runs, _ = best_fit(histogram, capacity, weights, rule)
    total = sum(n for _, n in histogram)
    chunks = max(16, -(-total // RANK_ROWS))
    chunked = table.withColumn("_chunk", F.pmod("_salt", F.lit(chunks)).cast("int"))
    before = chunked.groupBy("length", "_chunk").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_chunk", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = chunked.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "_chunk"]).select(*names, (F.col("_before") + F.col("_row") - 1).cast("long").alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "_salt") + ", sequence_id long, offset long"
    return ranked.mapInArrow(_dealer(runs), schema).toDF(*kept, "sequence_id", "offset")
