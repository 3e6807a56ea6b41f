"""Graph operators as iterated joins: breadth-first depth, PageRank, components, reachability.

Every round writes its state to the shared folder, so plans stay short and a lost
executor costs one round's re-read.  Edges are (src, dst); nodes are (id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import Levels, materialise

from .ranges import placed

DAMPING, ITERATIONS = 0.85, 25


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) once each, without loops."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) with zeros for orphans."""
    e = distinct_edges(edges)
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o"))).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def bfs(edges: DataFrame, roots: DataFrame, nodes: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(id, depth, parent): the least depth from any root, and the least parent of that depth.

    Targets outside ``nodes`` are not visited; expansion stops at ``max_depth``.
    """
    e = distinct_edges(edges)
    start = roots.select("id").distinct()
    if nodes is not None:
        e = e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        start = start.join(nodes.select("id"), "id", "left_semi")
    e = materialise(e)
    levels = Levels(e.sparkSession)
    frontier = levels.add(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast(start.schema["id"].dataType).alias("parent")))
    depth = 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        reached = frontier.select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.lit(depth).alias("depth"), F.min("src").alias("parent"))
        frontier = levels.add(reached.join(levels.all().select("id"), "id", "left_anti"))
    return levels.all()


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(id, rank): synchronous rounds, which broadcast nothing; the mass of nodes without targets is spread evenly."""
    e = distinct_edges(edges).join(_apart(nodes.select(F.col("id").alias("dst"))), "dst", "left_semi")
    out = _apart(e.groupBy("src").agg(F.count("*").alias("out")))
    links = materialise(e.join(out, "src").select("src", "dst", "out"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    state = materialise(nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("out", F.lit(0)).alias("out"), F.lit(1.0 / n).alias("rank")))
    for _ in range(iterations):
        lost = state.agg(F.sum(F.when(F.col("out") == 0, F.col("rank")).otherwise(0.0))).first()[0]
        gains = state.where("out > 0").select(F.col("id").alias("src"), (F.lit(damping) * F.col("rank") / F.col("out")).alias("share")).join(_apart(links.select("src", "dst")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("gain"))
        base = (1.0 - damping) / n + damping * lost / n
        state = materialise(state.join(_apart(gains), "id", "left").select("id", "out", (F.lit(base) + F.coalesce("gain", F.lit(0.0))).alias("rank")))
    return state.select("id", "rank")


def rank_score(rank: Column) -> Column:
    """0 to 100 against the largest rank, one decimal, half to even."""
    return F.bround(rank / F.max(rank).over(Window.partitionBy()) * 100, 1)


def scored(ranks: DataFrame) -> DataFrame:
    """(id, rank, page_rank); the maximum is one row and joins by broadcast."""
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.join(F.broadcast(top)).select("id", "rank", F.bround(F.col("rank") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0) * 100, 1).alias("page_rank"))


def _apart(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts: rounds that broadcast would each send a table of the nodes through the driver."""
    return df.hint("merge")


def _spread(state: DataFrame, e: DataFrame, backward: bool) -> DataFrame:
    """Push ``value`` along edges until nothing grows; a round pushes only what grew in the last one."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    state = state.select("id", "value", F.lit(True).alias("grew"))
    while True:
        fresh = state.where("grew").select(F.col("id").alias(a), "value")
        moved = e.join(_apart(fresh), a).groupBy(F.col(b).alias("id")).agg(F.max("value").alias("new"))
        state = materialise(state.join(_apart(moved), "id", "left").select("id", F.greatest("value", "new").alias("value"), F.coalesce(F.col("new") > F.col("value"), F.lit(False)).alias("grew")))
        if state.where("grew").isEmpty():
            return state.select("id", "value")


def _trimmed(e: DataFrame) -> DataFrame:
    """The written edges whose ends have both a source and a target among them; layers go until none is left to go."""
    n = e.count()
    while True:
        kept = e.join(_apart(e.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(_apart(e.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        e, before = materialise(kept), n
        n = e.count()
        if n == before:
            return e


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``induced`` without a broadcast."""
    return edges.join(_apart(nodes.select(F.col("id").alias("src"))), "src", "left_semi").join(_apart(nodes.select(F.col("id").alias("dst"))), "dst", "left_semi")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): strongly connected components named by their smallest node.

    Colouring: nodes without sources or targets among the rest are trimmed; each
    remaining node takes the largest node that reaches it as its colour, and a colour's owner
    with those that reach it within the colour are one component.  No nodes give no rows.
    """
    left = materialise(nodes.select("id").distinct())
    e = materialise(_within(distinct_edges(edges), left))
    done = Levels(left.sparkSession)
    while True:
        e = _trimmed(e)
        core = materialise(e.select(F.col("src").alias("id")).distinct())
        done.add(left.join(_apart(core), "id", "left_anti").select("id", F.col("id").alias("scc")))
        if core.isEmpty():
            return done.all()
        colours = materialise(_spread(core.select("id", F.col("id").alias("value")), e, backward=False).withColumnRenamed("value", "colour"))
        a, b = (_apart(colours.select(F.col("id").alias(k), F.col("colour").alias(c))) for k, c in (("src", "c1"), ("dst", "c2")))
        inside = materialise(e.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst"))
        marks = _spread(colours.select("id", F.when(F.col("id") == F.col("colour"), 1).otherwise(0).alias("value")), inside, backward=True)
        owned = materialise(colours.join(_apart(marks.where("value = 1").select("id")), "id", "left_semi"))
        names = owned.groupBy("colour").agg(F.min("id").alias("scc"))
        done.add(owned.join(_apart(names), "colour").select("id", "scc"))
        left = materialise(core.join(_apart(owned.select("id")), "id", "left_anti"))
        e = materialise(_within(e, left))


def cycles(sccs: DataFrame) -> DataFrame:
    """(scc, size) of components of two or more nodes."""
    return sccs.groupBy("scc").agg(F.count("*").alias("size")).where("size > 1")


def cycle_list(sccs: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(scc, ord, id): each component of two or more nodes as a closed list, from its least node by distance inside the component, then by id, and the least node again.

    A component of any size is a set of rows; they are numbered by ranges.  Members farther than ``max_depth`` are not listed; the
    last row's ``ord`` is the size of the component.
    """
    sccs = materialise(sccs.join(cycles(sccs), "scc"))
    a, b = (sccs.select(F.col("id").alias(k), F.col("scc").alias(c)) for k, c in (("src", "c1"), ("dst", "c2")))
    inside = materialise(distinct_edges(edges).join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst"))
    depth = bfs(inside, sccs.where("id = scc").select("id"), max_depth=max_depth).select("id", "depth")
    at = materialise(placed(materialise(sccs.join(depth, "id").select("scc", "id", "depth")), [F.asc("scc"), F.asc("depth"), F.asc("id")]))
    each = materialise(at.groupBy("scc").agg(F.min("place").alias("first")))
    listed = at.join(each, "scc").select("scc", (F.col("place") - F.col("first")).alias("ord"), "id")
    return listed.unionByName(sccs.where("id = scc").select("scc", F.col("size").alias("ord"), F.col("scc").alias("id")))


def focus(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(id) of the focused subgraph.

    Forward from the root; then backward from the root through nodes that the
    forward pass has not seen, so callers of a dependency alone stay out.
    """
    e = distinct_edges(edges)
    ahead = bfs(e, root).select("id")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    entered = ahead.join(root.select("id"), "id", "left_anti")
    back = back.join(entered.select(F.col("id").alias("dst")), "dst", "left_anti")
    return ahead.unionByName(bfs(back, root).select("id")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def god_nodes(metrics: DataFrame, total: int) -> DataFrame:
    """Top hubs of (id, page_rank, in_degree, out_degree, path) with their place.

    At least 3 and at most 10, a sixth of the nodes between, among those with two
    sources or three links.
    """
    k = min(max(3, total // 6), 10)
    hubs = metrics.where("in_degree >= 2 OR in_degree + out_degree >= 3")
    order = [F.desc("page_rank"), F.desc(F.col("in_degree") + F.col("out_degree")), F.upper("path")]
    top = hubs.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
