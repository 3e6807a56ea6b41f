"""Small groups of a sorted partition, without a call per group into Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Yield runs of whole groups as tables with an int64 column ``_g``.

    The partition must be sorted by ``keys`` (longs, ints).  A run ends at a
    group's end; only the group that crosses a batch's end is carried over, so
    memory holds a batch and one group.
    """
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield t.slice(0, last).append_column("_g", pa.array(np.cumsum(change[:last])))
        rest = t.slice(last).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.append_column("_g", pa.array(np.zeros(rest.num_rows, np.int64)))


def bounds(g: np.ndarray) -> np.ndarray:
    """First row of each group, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
