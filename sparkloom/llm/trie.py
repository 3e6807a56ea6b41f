"""Prefix trie of conversations: nodes by digest, sums over subtrees by pointer jumping."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import placed
from .store import Workspace

#: Turns of a conversation that one block folds; longer ones are folded in several, dealt apart.
BLOCK = 64
#: Ids that one piece of a node's list of ends holds.
PIECE = 4096
#: Bytes of a node's digest.
DIGEST = 16
ROOT = bytes(DIGEST)


def _short(hexadecimal: Column) -> Column:
    return F.unhex(F.substring(hexadecimal, 1, 2 * DIGEST))


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn, in hex; the role's length keeps role and text apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def _fold(batches):
    """Digests of all prefixes of each block; rows come sorted by conversation, block and place.

    A prefix's digest is that of the prefix before it and its last turn.  Blocks start at fixed
    places, so that equal sequences have equal digests.
    """
    key, state = None, ROOT
    for b in batches:
        own, before = [], []
        for c, k, turn in zip(b.column("conv_id").to_pylist(), b.column("block").to_pylist(), b.column("digest").to_pylist()):
            if (c, k) != key:
                key, state = (c, k), None
            before.append(state)
            state = hashlib.sha256((state or ROOT) + turn).digest()[:DIGEST]
            own.append(state)
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("conv_id", "block", "place", "words")), pa.array(own, pa.binary()), pa.array(before, pa.binary())], ["conv_id", "block", "place", "words", "own", "before"])


def _chain(batches):
    """What each block of a conversation starts from; rows come sorted by conversation and block."""
    conv, state = None, None
    for b in batches:
        carry = []
        for c, total in zip(b.column("conv_id").to_pylist(), b.column("total").to_pylist()):
            if c != conv:
                conv, state = c, None
            carry.append(state)
            state = total if state is None else hashlib.sha256(state + total).digest()[:DIGEST]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(carry, pa.binary())], ["conv_id", "block", "carry"])


def _listed(batches):
    """Runs of up to ``PIECE`` ids of one node as text; rows come sorted by node and id."""
    node, ids = None, []

    def piece():
        text = ",".join(map(str, ids)).encode()
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([text], pa.binary())], ["node", "first", "ids"])

    for b in batches:
        for n, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()):
            if ids and (n != node or len(ids) == PIECE):
                yield piece()
                ids = []
            node = n
            ids.append(c)
    if ids:
        yield piece()


def _hashed(batches):
    """SHA-256 of each node's pieces, joined by commas; rows come sorted by node and first id."""
    node, state = None, None
    for b in batches:
        done = []
        for n, text in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
            if n != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text)
        yield _ends(done)
    if state is not None:
        yield _ends([(node, state.hexdigest())])


def _ends(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])


def _with_shares(batches):
    """How many first turns each conversation takes from another: unsigned crc32 of its decimal id, modulo 4."""
    for b in batches:
        h = pa.array(np.array([zlib.crc32(str(c).encode()) % 4 for c in b.column("conv_id").to_pylist()], np.int32))
        yield pa.RecordBatch.from_arrays([*b.columns, h], [*b.schema.names, "h"])


def rebuild(conversations: DataFrame, ws: Workspace, *, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """(members(conv_id, h), turns(conv_id, place, digest, words)) of the rebuilt conversations.

    Conversation c starts with the first h turns of c - c % family and goes on with its own
    turns after its first h.  Turns are numbered by ranges of (conv_id, turn), so that a
    conversation of any length is dealt over tasks; ties of ``turn`` go by the turn's digest.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), turn_digest(role, text).alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("key")]
    turns = ws.save(placed(ws.save(rows, "turns"), order, ws), "placed")
    first = ws.save(turns.groupBy("conv_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")).mapInArrow(_with_shares, "conv_id long, start long, n long, h int"), "members")
    numbered = turns.join(first, "conv_id").select("conv_id", "h", (F.col("place") - F.col("start")).alias("pos"), F.unhex("key").alias("digest"), "words")
    head = F.col("conv_id") - F.col("conv_id") % family
    # What a head lends: at most its first three turns, to at most `family` conversations.
    heads = numbered.where((F.col("conv_id") == head) & (F.col("pos") < 3)).select(F.col("conv_id").alias("head"), F.col("pos"), "digest", "words")
    takers = first.withColumn("head", head).join(first.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head")), "head", "left")
    takers = ws.save(takers.select("conv_id", "head", "h", F.least("h", F.coalesce("n_head", F.lit(0))).alias("lent")), "takers")
    lent = takers.where("lent > 0").join(heads, "head").where("pos < lent").select("conv_id", F.col("pos").alias("place"), "digest", "words")
    own = numbered.where("pos >= h").join(takers.select("conv_id", "lent"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("place"), "digest", "words")
    return takers.select("conv_id"), ws.save(lent.unionByName(own), "rebuilt")


def prefixes(turns: DataFrame, ws: Workspace) -> DataFrame:
    """(conv_id, depth, node, parent, words) for every prefix of one turn or more of ``turns``."""
    blocks = turns.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    folded = blocks.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    folded = ws.save(folded.mapInArrow(_fold, "conv_id long, block long, place long, words long, own binary, before binary"), "folded")
    first = folded.where("block = 0").select("conv_id", (F.col("place") + 1).alias("depth"), F.col("own").alias("node"), F.coalesce("before", F.lit(ROOT)).alias("parent"), "words")
    # Conversations of several blocks: what a block starts from is one row for each `BLOCK` turns.
    long_ones = folded.where(f"block > 0 AND place % {BLOCK} = 0").select("conv_id").distinct()
    totals = folded.join(long_ones, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.max_by("own", "place").alias("total"))
    carried = totals.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain, "conv_id long, block long, carry binary")
    carried = ws.save(carried, "carried").where("block > 0")
    later = folded.where("block > 0").join(carried, ["conv_id", "block"])
    after = lambda c: _short(F.sha2(F.concat("carry", c), 256))
    later = later.select("conv_id", (F.col("place") + 1).alias("depth"), after("own").alias("node"), F.when(F.col("before").isNull(), F.col("carry")).otherwise(after("before")).alias("parent"), "words")
    return ws.save(first.unionByName(later), "prefixes")


def _jumped(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """(node, n_leaves, saved_tokens) over whole subtrees, from (node, parent, depth, leaf, saved).

    Round k adds to each node the sums of the nodes 2 ** k below it, each of which covers the
    levels up to 2 ** k - 1 below itself; then each pointer jumps to its pointer's pointer.
    """
    sums = nodes.select("node", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    jump = nodes.where("depth > 0").select("node", F.col("parent").alias("to"), "depth")
    span = 1
    while not jump.isEmpty():
        gains = jump.join(sums, "node").groupBy("to").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        sums = ws.save(sums.join(gains.withColumnRenamed("to", "node"), "node", "left").select("node", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "sums")
        # A pointer that ends at the root goes no further; the others' targets have pointers of their own.
        far, step = jump.where(f"depth >= {2 * span}"), jump.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jump = ws.save(far.join(step, "to").select("node", F.col("next").alias("to"), "depth"), "jump")
        span *= 2
    return sums


def conversation_trie(conversations: DataFrame, *, family: int = 20) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, all
    but the last long.  A node is a distinct sequence of first turns; ``conv_id`` is its
    smallest member, so (conv_id, depth) names it.

    Texts are hashed and counted where they lie; only digests of 16 bytes and counts move.  Edges go
    from digest to digest, and sums over subtrees need a number of rounds that is the logarithm of the
    greatest depth.  A round's tables are written, so a lost executor costs a re-read.
    Nodes that many conversations share meet in partial aggregates; a node's ends are
    joined from pieces of up to ``PIECE`` ids that any task writes, then hashed as a stream.

    A null role or text is empty.  Turns with a null number come first; equal numbers go by
    digest, and repeated rows all count as turns.  Rows without conv_id belong to no
    conversation and take no part.  Extra columns are not read.  An empty table gives no rows.
    """
    ws = Workspace(conversations.sparkSession, "trie")
    members, turns = rebuild(conversations, ws, family=family)
    rows = prefixes(turns, ws)
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = ws.save(nodes.unionByName(top), "nodes")
    children = ws.save(nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")).where("node IS NOT NULL"), "children")
    full = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = ws.save(full.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "full")
    sums = _jumped(full, ws)
    # A conversation ends at its longest prefix, or at the root.
    last = rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = members.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(ROOT)).alias("node"))
    ends = ws.save(ends, "ends").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_listed, "node binary, first long, ids binary")
    ends = ends.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")
    up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = full.join(sums, "node").join(ends, "node", "left").join(up, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
