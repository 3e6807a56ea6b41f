"""MinHash near-duplicates: SuperMinHash, banding, exact verification, union-find.

Plan
----
1. One pass over the texts gives each document a 128-bit key of its shingle set
   and a SuperMinHash signature.  Documents with equal sets are one class, a node of
   its own; copies meet in a partially aggregated ``min``.
2. Signatures are cut into bands.  Nodes that share a band are candidates.
   The shingle sets of nodes with any candidate are written once.
3. Star round: each bucket's smallest node against the bucket's others,
   verified on the full sets.  Verified links are grouped by union-find.
4. Completion: in buckets that still hold several components, the nodes outside the bucket's
   largest component are compared, in blocks of signatures, with all others of the bucket: a
   giant group meets its few strangers once and is never compared with itself.  What agrees is
   verified on its best pair first; pairs of node and component that are then still apart are
   verified against every member of the component, in blocks.
   No pair that shares a bucket is left out, hot buckets included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U, mix, shingle_sets, text_blocks
from .components import components
from .groups import bounds, sorted_groups
from .store import Workspace
from .superminhash import band_keys, signatures

#: Nodes of a part or side in step 4; a task holds two.
BLOCK = 1024
#: Signatures that agree in this many hundredths less than asked are not verified: over six deviations of 128 places.
SLACK = 22
SIG = "id long, k1 long, k2 long, n_shingles long, sig binary"


def _signer(shingle: int, m: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, off in text_blocks(texts):
                sets, at = shingle_sets(data, off, shingle)
                sig = signatures(sets, at, m)
                k1, k2 = _set_keys(sets, at)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(k1), pa.array(k2), pa.array(np.diff(at)), pa.array([r.tobytes() for r in sig], pa.binary())],
                    ["id", "k1", "k2", "n_shingles", "sig"],
                )

    return run


def _bander(rows: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = band_keys(sig, rows)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, keys.shape[1]))], ["bucket", "id"])

    return run


def _set_keys(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that name each set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[U(0)], np.cumsum(mix(sets + U(s)), dtype=np.uint64)]) for s in (3, 5)]
        return [(c[at[1:]] - c[at[:-1]]).astype(np.int64) for c in sums]


def _set_maker(shingle: int):
    """Sets of the rows whose text is the one that their node stands for."""

    def run(batches):
        for batch in batches:
            want = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            for a, b, data, off in text_blocks(batch.column("text")):
                sets, at = shingle_sets(data, off, shingle)
                ok = np.flatnonzero(np.logical_and(*[k == w[a:b] for k, w in zip(_set_keys(sets, at), want)]))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(a + ok)), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in ok], pa.binary())], ["id", "elements"])

    return run


def _estimator(least: float):
    """Keep pairs whose signatures agree in at least ``least`` of the places."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sx", "sy"))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return run


def intersections(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted distinct arrays."""
    out = np.zeros((len(xs), len(ys)), np.int64)
    if not len(xs) or not len(ys):
        return out
    if len(xs) * len(ys) <= 4:
        for i, x in enumerate(xs):
            for j, y in enumerate(ys):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    flat = np.concatenate(ys)
    cuts = np.cumsum([0, *map(len, ys)])
    universe, code = np.unique(flat, return_inverse=True)
    step = max(1, 8_000_000 // max(1, len(universe)))
    for j in range(0, len(ys), step):
        part = ys[j : j + step]
        right = np.zeros((len(universe), len(part)), np.float32)
        right[code[cuts[j] : cuts[j + len(part)]], np.repeat(np.arange(len(part)), [len(p) for p in part])] = 1
        for i in range(0, len(xs), step):
            left = np.zeros((min(step, len(xs) - i), len(universe)), np.float32)
            for r, x in enumerate(xs[i : i + step]):
                at = np.searchsorted(universe, x)
                at[at == len(universe)] = 0
                left[r, at[universe[at] == x] if len(universe) else []] = 1
            out[i : i + step, j : j + step] = np.rint(left @ right)
    return out


def _verifier(percent: int):
    """Within a block, link each document of side x to one member of side y that it is near."""

    def run(batches):
        for t in sorted_groups(batches, ["component", "i", "j"]):
            ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
            sets = [np.frombuffer(b, np.uint64) for b in t.column("elements").to_pylist()]
            cut = bounds(t.column("_g").to_numpy())
            us, vs = [], []
            for a, b in zip(cut[:-1], cut[1:]):
                y = a + np.flatnonzero(side[a:b])
                x = a + np.flatnonzero(~side[a:b])
                if not len(x) or not len(y):
                    continue
                both = intersections([sets[i] for i in x], [sets[i] for i in y])
                total = np.array([len(sets[i]) for i in x])[:, None] + np.array([len(sets[i]) for i in y])[None, :]
                near = (100 * both >= percent * (total - both)) & (ids[x][:, None] != ids[y][None, :])
                hit = near.any(axis=1)
                us.append(ids[x][hit])
                vs.append(ids[y][near.argmax(axis=1)[hit]])
            if us:
                yield _pairs("u", np.concatenate(us), "v", np.concatenate(vs))

    return run


def _pair_verifier(percent: int):
    """Keep rows whose two sets are near."""

    def run(batches):
        for batch in batches:
            xs, ys = ([np.frombuffer(e, np.uint64) for e in batch.column(c).to_pylist()] for c in ("ex", "ey"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(xs, ys)], np.int64)
            keep = pa.array(100 * both >= percent * (total - both))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return run


def _neighbours(least: float, rows: int):
    """Within a block of one bucket: (node, foreign component, its member that agrees most, agreement).

    Side x holds nodes outside the bucket's main component, side y any.  A node asks members of the main
    component and of those with smaller names.  A pair is told in the bucket of
    the first band that it shares, so several shared bands make no more rows.
    """

    def run(batches):
        for t in sorted_groups(batches, ["bucket", "i", "j"]):
            ids, comp, main, side = (t.column(c).to_numpy() for c in ("id", "component", "main", "side"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
            bucket = t.column("bucket").to_numpy()
            cut = bounds(t.column("_g").to_numpy())
            found = []
            for a, b in zip(cut[:-1], cut[1:]):
                ys, xs = a + np.flatnonzero(side[a:b]), a + np.flatnonzero(~side[a:b])
                if not len(xs) or not len(ys):
                    continue
                earlier = rows * int(np.flatnonzero(band_keys(sig[a : a + 1], rows)[0] == bucket[a])[0])
                for i in xs:
                    y = ys[(comp[ys] != comp[i]) & ((comp[ys] == main[a]) | (comp[ys] < comp[i]))]
                    if not len(y):
                        continue
                    same = sig[y] == sig[i]
                    agree = same.mean(axis=1)
                    ok = agree >= least
                    if earlier:
                        ok &= ~same[:, :earlier].reshape(len(y), -1, rows).all(axis=2).any(axis=1)
                    y, agree = y[ok], agree[ok]
                    order = np.lexsort((ids[y], -agree, comp[y]))
                    first = order[np.flatnonzero(np.diff(comp[y][order], prepend=-1))]
                    found += [(ids[i], comp[k], ids[k], g) for k, g in zip(y[first], agree[first])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["id", "other", "member", "agree"])

    return run


def _pairs(a: str, x: np.ndarray, b: str, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], [a, b])


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    num_hashes: int = 128,
    rows: int = 4,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A document's set is its distinct ``shingle``-word shingles, words being runs
    of anything but ASCII white space with A-Z lower-cased; shorter texts have
    their whole sequence as one shingle.  Two documents are linked when
    ``100 * |intersection| >= percent * |union|``; ``component_id`` is the
    smallest id reachable by links and ``kept`` marks it.

    Null or empty texts have an empty set and are linked with nothing.  Rows that
    repeat an id are one document, whatever their texts: they share a component, which
    each of their texts links.  A row with a null id is
    kept, with a null component.  Other columns are not read; an empty table gives no rows.  Candidates share
    one of ``num_hashes / rows`` bands: with 32 bands of 4, a pair at 80 % is
    missed with probability 5e-8; signatures that agree in less than
    ``percent - SLACK`` hundredths of 128 places, which happens to such a pair with probability 1e-8, are not verified.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    least = max(0.0, (percent - SLACK) / 100)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = ws.save(source.mapInArrow(_signer(shingle, num_hashes), SIG), "signed")

    # Classes of equal sets, each a node named by its place in the written table.  Empty sets stay alone.
    full = signed.where("n_shingles > 0 AND id IS NOT NULL")
    grouped = full.groupBy("k1", "k2").agg(F.min(F.struct("id", "sig")).alias("m"))
    classes = ws.save(grouped.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", F.col("m.id").alias("doc"), F.col("m.sig").alias("sig")), "classes")

    bands = classes.select(F.col("node").alias("id"), "sig").mapInArrow(_bander(rows), "bucket long, id long")
    shared = bands.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("bucket", "lead")
    members = ws.save(bands.join(shared, "bucket"), "members")
    wanted = ws.save(classes.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "wanted")
    texts = source.join(wanted.select(F.col("doc").alias("id"), "node", "k1", "k2"), "id").select("node", "k1", "k2", "text")
    sets = ws.save(texts.mapInArrow(_set_maker(shingle), "id long, elements binary").dropDuplicates(["id"]), "sets")
    sigs = wanted.select(F.col("node").alias("id"), "sig")

    # Star round.
    star = members.where("id <> lead").select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct()
    near = (
        star.join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("sx")), "u")
        .join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("sy")), "v")
        .mapInArrow(_estimator(least), "u long, v long")
    )
    near = ws.save(near, "star")
    asks = near.select(F.col("v").alias("id"), F.col("u").alias("other"))
    links = _verify(asks, near.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct(), sets, percent, ws)
    twins = _repeated_ids(full, classes, ws)
    links = links if twins is None else links.unionByName(twins)
    comp = components(links, ws)

    # Completion: buckets that still hold several components.
    named = members.join(comp.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    named = ws.save(named, "named")
    asks = ws.save(_dealt(_sides(named, ws).join(sigs, "id"), "bucket", "i", "j").mapInArrow(_neighbours(least, rows), "id long, other long, member long, agree double"), "asks")
    asks = ws.save(asks.groupBy("id", "other").agg(F.max(F.struct("agree", "member")).alias("m")).select("id", "other", F.col("m.member").alias("member")), "best")
    if not asks.isEmpty():
        pairs = asks.select(F.col("id").alias("u"), F.col("member").alias("v"))
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("elements").alias("ex")), "u").join(sets.select(F.col("id").alias("v"), F.col("elements").alias("ey")), "v")
        links = links.unionByName(ws.save(both.mapInArrow(_pair_verifier(percent), "u long, v long"), "probed"))
        comp = components(links, ws)
        # What is in one component by now needs no other link.
        now = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_now"))
        apart = asks.join(now("id"), "id", "left").join(now("other"), "other", "left").where(F.coalesce("id_now", "id") != F.coalesce("other_now", "other"))
        apart = ws.save(apart.select("id", "other"), "apart")
        if not apart.isEmpty():
            links = links.unionByName(_verify(apart, named.select("id", "component").distinct(), sets, percent, ws))
            comp = components(links, ws)

    # Back to documents through their class; a component's name is its smallest document.
    labelled = classes.select("node", "k1", "k2", "doc").join(comp, "node")
    least_doc = ws.save(labelled.groupBy("component").agg(F.min("doc").alias("class_component")), "names")
    label = labelled.join(least_doc, "component").select("k1", "k2", "class_component")
    alone = classes.join(comp, "node", "left_anti").select("k1", "k2", F.col("doc").alias("class_component"))
    out = (
        signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("k1")).alias("k1"), F.when(F.col("n_shingles") > 0, F.col("k2")).alias("k2"))
        .join(ws.save(label.unionByName(alone), "labels"), ["k1", "k2"], "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("class_component", "id")).alias("component_id"))
        .withColumn("kept", F.col("component_id").isNull() | (F.col(id_col) == F.col("component_id")))
    )
    return out


def _repeated_ids(full: DataFrame, classes: DataFrame, ws: Workspace) -> DataFrame | None:
    """Links between the classes of one id's texts, or None where each id has one set."""
    pair = F.struct("k1", "k2")
    several = ws.save(full.groupBy("id").agg(F.min(pair).alias("a"), F.max(pair).alias("b")).where("a < b").select("id"), "repeated")
    if several.isEmpty():
        return None
    own = full.select("id", "k1", "k2").join(several, "id", "left_semi").distinct().join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node")
    first = own.groupBy("id").agg(F.min("node").alias("u"))
    return ws.save(own.join(first, "id").where("node <> u").select("u", F.col("node").alias("v")), "twins")


def _sides(named: DataFrame, ws: Workspace) -> DataFrame:
    """Blocks (bucket, i, j) of buckets with several components: part i of the nodes outside the main one, part j of all."""
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    shape = ws.save(top.select("bucket", F.col("m.component").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("xs"), F.ceil(F.col("n") / BLOCK).cast("int").alias("ys")), "buckets")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = named.join(shape, "bucket")
    own = ["bucket", "id", "component", "main"]
    x = placed.where("component <> main").select(*own, part(F.col("xs"), 1).alias("i"), every("ys").alias("j"), F.lit(False).alias("side"))
    y = placed.select(*own, every("xs").alias("i"), part(F.col("ys"), 2).alias("j"), F.lit(True).alias("side"))
    return x.unionByName(y)


def _verify(asks: DataFrame, members: DataFrame, sets: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """Links between each asking document (id, other) and the members (id, component) of ``other``.

    Members and askers of one component are dealt into blocks of about
    ``BLOCK`` by hash; a task sees one block of each.
    """
    asked = asks.groupBy("other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("xs"))
    sized = members.join(asked, members.component == asked.other, "left_semi").groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ys"))
    # Written, so that the joins with it hold no aggregate and a hot component's rows can be dealt anew.
    shape = ws.save(asked.join(sized, asked.other == sized.component).select("component", "xs", "ys"), "shape")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    x = asks.withColumnRenamed("other", "component").join(shape, "component").select("component", "id", part(F.col("xs"), 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("j"), F.lit(False).alias("side"))
    y = members.join(shape, "component").select("component", "id", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("i"), part(F.col("ys"), 2).alias("j"), F.lit(True).alias("side"))
    rows = x.unionByName(y).join(sets, "id")
    return ws.save(_dealt(rows, "component", "i", "j").mapInArrow(_verifier(percent), "u long, v long").distinct(), "links")
