"""Selection of files under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import comments
from sparkloom.functions import text as T
from sparkloom.sources.shared import materialise

from .ranges import placed

OVERHEAD, LEAST_BUDGET = 500, 100
#: Candidates of one workspace that a round of the greedy selection looks at.
ROUND = 4096


def available(budget: int, overhead: int = OVERHEAD) -> int:
    return max(LEAST_BUDGET, budget - overhead)


def processed(text: Column, ext: Column, mode: str) -> Column:
    """The text as a budget sees it: without comments for ``Remove``."""
    return comments.strip_comments(text, ext) if mode == "Remove" else text


def totals(candidates: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """(workspace, full_tokens): all files' tokens with the fixed overhead."""
    return candidates.groupBy("workspace").agg((F.sum("tokens") + overhead).alias("full_tokens"))


def auto_tokens(files: DataFrame, budget: int, overhead: int = OVERHEAD) -> DataFrame:
    """Files with ``tokens``: comments go only in workspaces whose full text is over the budget."""
    sized = files.withColumn("full", T.token_estimate(F.col("content"))).withColumn("bare", T.token_estimate(comments.strip_comments(F.col("content"), F.col("ext"))))
    sized = sized.drop("content")
    over = sized.groupBy("workspace").agg(((F.sum("full") + overhead) > budget).alias("removed"))
    return sized.join(over, "workspace").withColumn("tokens", F.when(F.col("removed"), F.col("bare")).otherwise(F.col("full")))


def greedy(candidates: DataFrame, budget: int, overhead: int = OVERHEAD) -> DataFrame:
    """``candidates`` with ``included`` and ``reason``.

    Columns: workspace, path, is_root, is_companion, depth, importance, tokens,
    parents (array of paths).  Roots are always in.  The others come by
    companion, depth, importance and path; one is taken if it has no parent or an
    included one and fits what is left, else it is passed over and the next one is tried.

    Each round folds the next ``ROUND`` candidates of every workspace.  What a workspace can include is bounded
    by its budget, since a file has a token at least, and a round drops every
    candidate that no longer fits, so rows are never gathered without bound.
    """
    room = available(budget, overhead)
    roots = candidates.where("is_root")
    state = roots.groupBy("workspace").agg(F.sum("tokens").alias("acc"), F.collect_set("path").alias("inc"))
    state = materialise(state)
    order = [F.desc("is_companion"), F.asc("depth"), F.desc("importance"), F.upper("path")]
    # One order over all workspaces, by ranges: a workspace of any size is dealt over tasks.
    keyed = materialise(candidates.where("NOT is_root").select("workspace", "path", "tokens", "parents", "is_companion", "depth", "importance"))
    left = materialise(placed(keyed, [F.asc("workspace"), *order]).select("workspace", "path", "tokens", "parents", F.col("place").alias("turn")))
    taken = [state.select("workspace", F.explode("inc").alias("path"))]
    while True:
        fits = left.join(state.select("workspace", "acc"), "workspace", "left").where(F.col("tokens") + F.coalesce("acc", F.lit(0)) <= room)
        nth = F.row_number().over(Window.partitionBy("workspace").orderBy("turn"))
        block = materialise(fits.select("workspace", "path", "tokens", "parents", "turn", nth.alias("nth")).where(F.col("nth") <= ROUND))
        if block.isEmpty():
            break
        items = block.groupBy("workspace").agg(F.array_sort(F.collect_list(F.struct("turn", "path", "tokens", "parents"))).alias("items"), F.max("turn").alias("upto"))
        start = F.struct(F.coalesce("acc", F.lit(0).cast("long")).alias("acc"), F.coalesce("inc", F.array().cast("array<string>")).alias("inc"), F.array().cast("array<string>").alias("new"))

        def step(a: Column, x: Column) -> Column:
            ok = ((F.size(x["parents"]) == 0) | F.arrays_overlap(a["inc"], x["parents"])) & (a["acc"] + x["tokens"] <= room)
            grown = F.struct((a["acc"] + x["tokens"]).alias("acc"), F.concat(a["inc"], F.array(x["path"])).alias("inc"), F.concat(a["new"], F.array(x["path"])).alias("new"))
            return F.when(ok, grown).otherwise(a)

        folded = items.join(state, "workspace", "left").select("workspace", "upto", F.aggregate("items", start, step).alias("s"))
        folded = materialise(folded.select("workspace", "upto", "s.acc", "s.inc", "s.new"))
        taken.append(folded.select("workspace", F.explode("new").alias("path")))
        state = materialise(state.join(folded.select("workspace", F.col("acc").alias("a2"), F.col("inc").alias("i2")), "workspace", "full").select("workspace", F.coalesce("a2", "acc").alias("acc"), F.coalesce("i2", "inc").alias("inc")))
        left = materialise(left.join(folded.select("workspace", "upto"), "workspace", "left").where("upto IS NULL OR turn > upto").drop("upto"))
    included = taken[0]
    for t in taken[1:]:
        included = included.unionByName(t)
    out = candidates.join(included.distinct().withColumn("included", F.lit(True)), ["workspace", "path"], "left").withColumn("included", F.coalesce("included", F.lit(False)))
    return out.withColumn("reason", F.when(~F.col("included"), "TokenBudget"))


def summary(selected: DataFrame, budget: int, overhead: int = OVERHEAD) -> DataFrame:
    """(workspace, final_tokens, budget_met, root_alone)."""
    room = available(budget, overhead)
    sums = selected.groupBy("workspace").agg((F.sum(F.when(F.col("included"), F.col("tokens")).otherwise(0)) + overhead).alias("final_tokens"), (F.coalesce(F.sum(F.when(F.col("is_root"), F.col("tokens"))), F.lit(0)) > room).alias("root_alone"))
    return sums.withColumn("budget_met", (F.col("final_tokens") <= budget) | F.col("root_alone"))


def running_cut(files: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """Files listed until the first that overflows, with one at least: (workspace, path, tokens, total).

    Only the first ``budget + 1`` files of a workspace can be listed, so the limit
    is applied before rows meet.
    """
    w = Window.partitionBy("workspace").orderBy(*order)
    head = files.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= budget + 1)
    run = head.withColumn("total", F.sum("tokens").over(Window.partitionBy("workspace").orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.where((F.col("total") <= budget) | (F.col("_nth") == 1)).drop("_nth")
