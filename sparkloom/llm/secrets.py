"""Secret scans with corpus-wide ownership, in built-in functions only.

A candidate is a base match or a long mixed token.  Its value's hash is counted
over the distinct repositories and owners that hold it: a value that many owners hold, or that
lies in many repositories, is a copied example; one that few hold looks live.  Live tokens without any
assignment around them are added to a document's spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Fixed values of the scan: kinds in the order they are listed, and their patterns.
KINDS = ["assign", "access", "hex", "owned"]
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
SPAN = "array<struct<start:int,kind:int,end:int,value:bigint>>"
#: Matches of one text that are laid out together: places are summed up within and then over chunks.
CHUNK = 512


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters, in code points.

    The gaps between matches come from ``split``, so a match starts after the gaps
    and matches before it.
    """
    zipped = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    width = lambda x: x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = acc["at"] + width(x)
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(x["value"]).alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPAN)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / CHUNK).cast("int")), lambda i: F.slice(zipped, i * CHUNK + 1, F.lit(CHUNK)))
    starts = F.aggregate(
        F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + width(x))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )["out"]
    laid = F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step)["out"])
    return F.when(text.rlike(pattern), F.flatten(laid)).otherwise(none)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    owner_cols: tuple[str, ...] = ("source",),
    copied_owners: int = 3,
    copied_repos: int = 6,
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_live, n_copied, base_sha256, spans, owners.

    ``spans`` lists kind:start:end by start, then kind, in code points with the end
    exclusive.  Base kinds: an assignment of 12 or more value characters, an
    access key of 18 or more, a hexadecimal run of 16 or more.  ``owned`` adds
    tokens of 20 or more characters with a digit and a letter, not inside a base
    span, that fewer than ``copied_owners`` owners hold in fewer than ``copied_repos`` repositories of the corpus.
    ``n_live`` and ``n_copied`` count a document's spans by that test; ``owners`` lists
    start:owners:repositories:uses of every span, by start and kind.  A null text is empty;
    null repositories and owners are values of their own.  Rows that repeat a doc_id
    stay separate rows.  Extra columns are not read; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    empty = F.array().cast(SPAN)
    signs = text.contains("=") | text.contains(":")
    base = F.concat(
        F.when(signs, _spans(text, ASSIGN, 0, 2, 12)).otherwise(empty),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, 1, 0, 18)).otherwise(empty),
        _spans(text, HEX, 2, 0, 16),
    )
    # A token is looked at for what it holds only where the text has any.
    token = F.when(text.rlike(TOKEN), _token_spans(text)).otherwise(empty)
    row = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.struct(*[F.col(c) for c in repo_cols]).alias("repo"),
        F.struct(*[F.col(c) for c in owner_cols]).alias("owner"),
        base.alias("base"),
        token.alias("token"),
    )
    scanned = ws.save(row.withColumn("row", F.monotonically_increasing_id()), "scanned")
    inside = lambda t: F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"]))
    spans = scanned.select("row", "repo", "owner", F.explode(F.concat("base", F.filter("token", lambda t: ~inside(t)))).alias("s"))
    spans = spans.select("row", "repo", "owner", "s", F.col("s.value").alias("value"))

    # Distinct repositories and owners of each value: pairs first, then values.
    pairs = spans.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    owned = owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("uses"))
    # Written, so that the join with it holds no aggregate and the rows of a hot value can be dealt anew.
    owned = ws.save(owned, "owned")
    judged = spans.select("row", "value", "s").join(owned, "value").withColumn("live", (F.col("owners") < copied_owners) & (F.col("repos") < copied_repos))
    kept = judged.where("s.kind < 3 OR live")
    per_row = kept.groupBy("row").agg(F.collect_list("s").alias("all"), F.collect_list(F.struct("s.start", "s.kind", "owners", "repos", "uses")).alias("held"), F.count_if(F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))
    order = lambda a: F.array_sort(a)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.join(per_row, "row", "left").select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.sha2(_listed(order(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_listed(order(F.col("all"))), F.lit("")).alias("spans"),
        F.coalesce(F.array_join(F.transform(order(F.col("held")), lambda h: F.concat_ws(":", h["start"], h["owners"], h["repos"], h["uses"])), ","), F.lit("")).alias("owners"),
    )


def _token_spans(text: Column) -> Column:
    """Long tokens with a digit and a letter; the pattern of ``TOKEN`` splits them from their text."""
    hits = _spans(text, TOKEN, 3, 0, 20)
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pairs = F.arrays_zip(hits.alias("s"), words.alias("w"))
    mixed = F.filter(pairs, lambda p: p["w"].rlike("[0-9]") & p["w"].rlike("[A-Za-z]"))
    return F.transform(mixed, lambda p: p["s"])
