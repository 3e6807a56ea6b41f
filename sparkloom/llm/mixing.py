"""Mixing sources to target weights by whole copies and Pareto order sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

#: Keys are cut into so many ranges per source to find the cut without sorting a source in one task.
RANGES = 4096
#: A document's place in its source's order.
PLACE_COLUMNS = ("key", "doc_id", "size", "row")


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null and empty have none."""
    parts = F.size(F.split(text, r"[ \t-\r]+", -1))
    edge = lambda p: F.when(text.rlike(p), 1).otherwise(0)
    return F.when(F.length(text) > 0, parts - edge(r"^[ \t-\r]") - edge(r"[ \t-\r]\z")).otherwise(0).cast("long")


def uniform(seed: int, *cols) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double") + 0.5) / F.lit(float(2**52))


def _place() -> Column:
    return F.struct(*PLACE_COLUMNS)


def _poured(items: DataFrame, by: list[str], total: Column, place: str) -> DataFrame:
    """Add ``given``: ``total`` dealt among the rows of a group by ``weight``, none over its ``most``.

    What is over goes to the others by weight, until none is above.  That fixpoint is
    min(most, level * weight) for one level, which lies before the first row, in order of
    most / weight, that it leaves under its most.
    """
    one = items.withColumn("_turn", F.col("most") / F.col("weight"))
    up = Window.partitionBy(*by).orderBy("_turn", place).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    one = one.withColumn("_full", F.coalesce(F.sum("most").over(up), F.lit(0.0))).withColumn("_used", F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    one = one.withColumn("_level", (total - F.col("_full")) / (F.sum("weight").over(every) - F.col("_used")))
    # The first row that its level leaves at or under its most fixes the level for all after it.
    one = one.withColumn("_fix", F.min(F.when(F.col("_level") <= F.col("_turn"), F.struct("_turn", place, "_level"))).over(every)["_level"])
    given = F.when(F.col("_fix").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("_fix") * F.col("weight")))
    return one.withColumn("given", given).drop("_turn", "_full", "_used", "_level", "_fix")


def source_targets(sizes: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat in code point order, null last.

    Targets are ``share`` of all sizes dealt by weight; none exceeds ``cap`` times its
    source's size, and what is over goes to the others by weight, until none is above.
    Sources are put in order in one task: a row of some 100 bytes for each source, not for its documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    one = sizes.withColumn("_place", F.row_number().over(order)).withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    return _poured(one.withColumn("_total", total), [], F.col("_total"), "_place").select("source", "source_size", "weight", F.col("given").alias("target"))


def inclusion_plan(classes: DataFrame, targets: DataFrame, *, cap: float, tilt: float) -> DataFrame:
    """(source, cls, whole, p, missing): certain copies and inclusion odds of each size class of a source.

    A document of class b is wanted min(cap, level * 2 ** (tilt * b)) times, with the one level at which
    its source's words come to the target.  The whole part is certain, the rest is p;
    ``missing`` are the source's words beyond the certain ones.
    """
    items = classes.join(targets.select(F.col("source").alias("_s"), "target"), classes.source.eqNullSafe(F.col("_s"))).drop("_s")
    items = items.withColumn("weight", F.pow(F.lit(2.0), F.lit(float(tilt)) * F.col("cls")) * F.col("words")).withColumn("most", F.lit(float(cap)) * F.col("words"))
    some = _poured(items.where("words > 0"), ["source"], F.col("target"), "cls")
    wanted = F.col("given") / F.col("words")
    # A number a rounding error under a whole one is that one.
    some = some.withColumn("whole", F.floor(wanted + F.lit(1e-9))).withColumn("p", F.greatest(F.lit(0.0), wanted - F.col("whole")))
    some = some.withColumn("p", F.when((F.col("p") > 1e-9) & (F.col("whole") + 1 <= F.lit(float(cap))), F.col("p")))
    missing = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    some = some.select("source", "cls", F.col("whole").cast("long").alias("whole"), "p", missing.alias("missing"))
    return some.unionByName(items.where("words = 0").select("source", "cls", F.lit(0).cast("long").alias("whole"), F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("missing")))


def _sampled(pool: DataFrame, gaps: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Fill ``gaps`` (g_source, gap, at) from the pool's documents in order, passing over those that do not fit.

    A round takes, for each source, the documents after ``at`` that fit its gap up to the first at which
    their sum does not; one that was passed over never fits again.  Returns spans of places
    (s_source, lo, hi, room), of which documents of at most ``room`` words are taken, and the last gaps.
    """
    run = Window.partitionBy("g_source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("g_source").orderBy(*PLACE_COLUMNS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans, open_gaps, left = [], gaps, [gaps.select("g_source", "gap")]
    while True:
        now = open_gaps.where("at IS NOT NULL AND gap > 0")
        fits = pool.join(now, pool.source.eqNullSafe(now.g_source) & (F.col("size") <= F.col("gap")) & (_place() > F.col("at")))
        cells = fits.groupBy("g_source", "cell").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"), F.max("at").alias("at"))
        cells = cells.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        # The words before the range at the cut, or all where there is none.
        over = F.col("before") + F.col("words") > F.col("gap")
        cut = cells.groupBy("g_source").agg(F.max("gap").alias("gap"), F.max("at").alias("at"), F.min(F.when(over, F.col("cell"))).alias("c_cell"), F.sum(F.when(over, 0).otherwise(F.col("words"))).alias("used"))
        cut = ws.save(cut.withColumnRenamed("g_source", "k_source"), "cut")
        # Only the range at the cut is put in order.
        last = fits.select("g_source", "cell", *PLACE_COLUMNS).join(cut, F.col("g_source").eqNullSafe(F.col("k_source")) & (F.col("cell") == F.col("c_cell")))
        last = last.withColumn("upto", F.col("used") + F.sum("size").over(inner)).groupBy("k_source").agg(
            F.min(F.when(F.col("upto") > F.col("gap"), _place())).alias("hi"), F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("most")
        ).withColumnRenamed("k_source", "l_source")
        state = cut.join(last, cut.k_source.eqNullSafe(last.l_source), "left")
        state = ws.save(state.select(F.col("k_source").alias("s_source"), F.col("at").alias("lo"), "hi", F.col("gap").alias("room"), (F.col("gap") - F.coalesce("most", "used")).alias("left")), "round")
        if state.isEmpty():
            spans = spans or [state.select("s_source", "lo", "hi", "room")]
            break
        spans.append(state.select("s_source", "lo", "hi", "room"))
        left.append(state.select(F.col("s_source").alias("g_source"), F.col("left").alias("gap")))
        open_gaps = state.select(F.col("s_source").alias("g_source"), F.col("left").alias("gap"), F.col("hi").alias("at"))
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return union(spans), union(left).groupBy("g_source").agg(F.min("gap").alias("gap"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    tilt: float = 0.25,
    seed: int = 17,
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken; with ``carry`` its own columns in ``doc``, and copies.

    A source's target is met by unequal odds: a document's wanted number of copies grows with
    2 ** ``tilt`` for each doubling of its size and is at most ``cap`` (see ``inclusion_plan``).  Its whole part is
    allocated for certain, and the rest p is an inclusion
    probability.  Documents are ranked by Pareto keys, random odds u / (1 - u)
    over inclusion odds p / (1 - p), and the sample takes them in that order
    while it stays within the words that are missing.  One that does not fit is passed over and the
    next ones that do are taken, until none fits; the one document whose size best fills what is
    then left closes it, where that brings the total nearer.

    Sizes are words; a null text has size 0 and is taken with no words.  A null
    source is a source, last in order.  Ties of keys go to the smaller id;
    repeated rows are separate documents with equal keys, each decided on its own.  The random numbers
    depend on seed and id, so reruns agree.  Needs the columns named, reads no
    others; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "mix")
    size = word_count(F.col(text_col))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *own)
    # Written once with a number for each row, so that repeated rows can be told apart.
    base = ws.save(base.withColumn("cls", F.floor(F.log2(F.col("size") + 1)).cast("int")).withColumn("row", F.monotonically_increasing_id()), "sized")
    classes = ws.save(base.groupBy("source", "cls").agg(F.sum("size").alias("words")), "classes")
    targets = ws.save(source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, share=share, cap=cap), "targets")
    plan = ws.save(inclusion_plan(classes, targets, cap=cap, tilt=tilt), "plan")

    u = uniform(seed, "doc_id")
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    many = plan.select(F.col("source").alias("p_source"), F.col("cls").alias("p_cls"), "whole", "p")
    keyed = base.join(many, base.source.eqNullSafe(many.p_source) & (base.cls == many.p_cls)).drop("p_source", "p_cls").withColumn("key", odds / (1 + odds)).drop("p")
    pool = keyed.where("key IS NOT NULL AND size > 0").select("source", *PLACE_COLUMNS)
    pool = ws.save(pool.withColumn("cell", F.least(F.floor(F.col("key") * RANGES), F.lit(RANGES - 1)).cast("int")), "pool")
    start = F.struct(F.lit(-1.0).alias("key"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("row"))
    first = plan.groupBy(F.col("source").alias("g_source")).agg(F.max("missing").alias("gap")).withColumn("at", start)
    spans, gaps = _sampled(pool, ws.save(first, "gaps"), ws)
    # One row per source; a source has one span for each round.
    inside = ws.save(spans.groupBy("s_source").agg(F.collect_list(F.struct("lo", "hi", "room")).alias("spans")), "spans")

    # The closing document of each source.
    within = lambda s: (_place() > s["lo"]) & (s["hi"].isNull() | (_place() < s["hi"])) & (F.col("size") <= s["room"])
    taken = F.coalesce(F.exists("spans", within), F.lit(False))
    spare = pool.join(gaps, pool.source.eqNullSafe(gaps.g_source)).join(inside, pool.source.eqNullSafe(inside.s_source), "left").where(~taken)
    closing = spare.where(F.abs(F.col("gap") - F.col("size")) < F.abs("gap")).groupBy("g_source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("d"), "key", "doc_id", "row")).alias("m"))
    closing = closing.select("g_source", F.col("m.row").alias("closes"))
    told = targets.join(inside, targets.source.eqNullSafe(inside.s_source), "left").join(closing, targets.source.eqNullSafe(closing.g_source), "left")
    told = ws.save(told.select(F.col("source").alias("t_source"), "source_size", "target", "spans", "closes"), "decisions")
    out = keyed.join(told, keyed.source.eqNullSafe(told.t_source))
    extra = F.when(F.col("key").isNotNull() & (F.col("size") > 0) & (taken | F.coalesce(F.col("row") == F.col("closes"), F.lit(False))), 1).otherwise(0)
    copies = (F.col("whole") + extra).cast("long")
    if carry:
        return out.select("doc", copies.alias("copies"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))
