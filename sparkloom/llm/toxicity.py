"""Toxicity by class-conditional Kneser-Ney models.

Two classes, toxic and ordinary, have a model of words after words each.  Its lower level counts
a word by the distinct words before it, as Kneser and Ney do, so copies of a text add
nothing; its higher level interpolates with it.  At both levels counts are discounted, and what both classes share is
their backoff: every word, and every pair that is kept, has ``SHARED`` contexts dealt to the
classes by their size, so a rare expression gets nearly the same chance from both.  Pairs are
kept where the classes differ on them (``GAIN``); the counts of all others go to the backoff, so each
class's chances of the words after any word still add up to 1.  A word
that neither class knows is spelled by a Kneser-Ney character model with a shared lower
order.  A text is scored by the log-likelihood ratios of its words, normalised by
length over the whole text and over its most toxic stretches; a logistic curve fitted on
rows apart from the counted ones makes it a probability.

Counts come from every labelled row and stay in Spark.  The words and spellings of most
contexts and the pairs of most gain are broadcast, up to stated numbers; where there are more, a document's
other words and pairs get their ratios by joins, with the same values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import U, mix, text_blocks
from .store import Workspace

ORDER = 6
DISCOUNT = 0.75
#: Contexts that both classes share for each known word and each kept pair.
SHARED = 3.0
#: A pair of words is kept where twice its log-likelihood ratio against the classes' shares of
#: labelled rows comes to this: chance alone does so once in a thousand pairs.
GAIN = 10.83
#: Lengths of stretches, in words.
STRETCHES = (1, 8)
#: Bound of the held rows of each class that the curve is fitted on.
HELD_ROWS = 1_500
#: Bounds of the words and spellings that are broadcast, 16 bytes each; ratios of others are joined.
MAX_WORDS, MAX_GRAMS = 4_000_000, 1_000_000
#: Bound of the kept pairs that are broadcast, those of most gain; ratios of others are joined.
MAX_PAIRS = 2_000_000
#: Bits for each other pair, and at most, of the filter that tells which of a text's pairs may be such.
FAR_BITS, MOST_FAR_BITS = 16, 1 << 27
#: Bits for each labelled id, and at most, of the filter that keeps most other texts out of the join with labels.
FILTER_BITS, MOST_BITS = 16, 1 << 29
#: A spelling needs so many contexts of a class to be counted there.
LEAST_SPELLINGS = 8
#: A spelled word moves a score by no more than this.
SPELLED = 1.5
EDGES = " .,;:!?\"'()[]{}<>*_-"
#: Words that a task remembers, and bytes of text whose words it holds at once (a longer text is alone).
CACHE_WORDS, PART_BYTES = 100_000, 1 << 18
#: Pairs that a task combines and sorts at once, 17 bytes each (a text's own pairs stay together).
PAIR_BLOCK = 1 << 20
PAIRS = "w long, s long, v long, c0 long, c1 long"
#: The pairs of a word that is at least this part of a sample's words are dealt to so many tasks.
HOT_PART, SALTS = 1 / 500, 64


def key_of(word: str) -> int:
    """The 64-bit name of a word, as Spark's xxhash64 gives it; the empty word stands for a text's start and end."""
    k = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    return k - (1 << 64) if k >> 63 else k


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before.astype(np.uint64) * U(0x9E3779B97F4A7C15) + word.astype(np.uint64)).astype(np.int64)


def words_of(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(EDGES))]


def parts(b: pa.RecordBatch):
    """The rows of a batch, in slices of about ``PART_BYTES`` of text."""
    for lo, hi, _, _ in text_blocks(b.column("text"), PART_BYTES):
        yield b.slice(lo, hi - lo)


def padded(word: str) -> str:
    return "^" * (ORDER - 1) + word + "$"


class Table:
    """A lookup from 64-bit keys to numbers, in sorted arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, NaN where there is none."""
        out = np.full(len(keys), np.nan)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.values[at[hit]]
        return out


class Filter:
    """Which keys may be in a set: those whose bit is set; none of the set is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may(self, keys: np.ndarray) -> np.ndarray:
        at = keys % (8 * len(self.bits))
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class ToxicModel:
    """Log-likelihood ratios (toxic over ordinary) of words after words, with their spelling as backoff.

    ``whole`` says whether the tables hold all ratios of words; without it a word that is not in
    ``words`` has none here.  ``far`` tells which pairs, and first words of pairs, may be kept
    and not be here; without it there are none.
    """

    def __init__(self, words: Table, pairs: Table, seconds: Table, backoffs: Table, grams: Table, contexts: Table, whole: bool, far: Filter | None = None):
        self.words, self.pairs, self.backoffs, self.grams, self.contexts, self.whole, self.far = words, pairs, backoffs, grams, contexts, whole, far
        self.seconds = seconds  # the second words of all kept pairs

    def spelled(self, words: list[str]) -> np.ndarray:
        """The ratio of each word's spelling: of its n-grams, or of their histories where they are not counted."""
        spans = [(p, i) for p in map(padded, words) for i in range(ORDER - 1, len(p))]
        told = self.grams.get(np.array([key_of(p[i - ORDER + 1 : i + 1]) for p, i in spans], np.int64))
        rest = np.flatnonzero(np.isnan(told))
        told[rest] = np.nan_to_num(self.contexts.get(np.array([key_of(spans[j][0][spans[j][1] - ORDER + 1 : spans[j][1]]) for j in rest], np.int64)))
        owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        return np.clip(np.bincount(owner, told, len(words)), -SPELLED, SPELLED)


class Scorer:
    """A task's memory of words: their keys, ratios, and the backoff ratios of what follows them."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.keys = np.array([key_of("")], np.int64)
        self.ratio = np.zeros(1)
        self.after = self.model.backoffs.get(self.keys)
        self.ends = self.model.seconds.get(self.keys) > 0
        self.open = self._open(self.keys)

    def _open(self, keys: np.ndarray) -> np.ndarray:
        return self.model.far.may(keys) if self.model.far else np.zeros(len(keys), bool)

    def _learn(self, words: list[str]) -> None:
        keys = np.array([key_of(w) for w in words], np.int64)
        ratio = self.model.words.get(keys)
        new = np.flatnonzero(np.isnan(ratio))
        if self.model.whole and len(new):
            ratio[new] = self.model.spelled([words[i] for i in new])
        self.known.update(zip(words, range(len(self.keys), len(self.keys) + len(words))))
        self.keys, self.ratio = np.concatenate([self.keys, keys]), np.concatenate([self.ratio, ratio])
        self.after = np.concatenate([self.after, self.model.backoffs.get(keys)])
        self.ends = np.concatenate([self.ends, self.model.seconds.get(keys) > 0])
        self.open = np.concatenate([self.open, self._open(keys)])

    def ratios(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text its words' ratios, NaN where the tables have none or may lack the pair."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        new = list({w for t in texts for w in t if w not in self.known})
        if new:
            self._learn(new)
        known = self.known
        at = np.array([i for t in texts for i in (0, *(known[w] for w in t))], np.int64)
        if not len(at):
            return []
        before = self.after[at[:-1]]
        begins = ~np.isnan(before)
        # Only words that begin kept pairs, before words that end some, are looked up as pairs.
        may = np.flatnonzero(begins & self.ends[at[1:]])
        told = self.ratio[at[1:]] + np.nan_to_num(before)
        pairs = self.model.pairs.get(pair_key(self.keys[at[may]], self.keys[at[may + 1]]))
        told[may] = np.where(np.isnan(pairs), told[may], pairs)
        if self.model.far:
            told[self.open[at[:-1]]] = np.nan
            begin = np.flatnonzero(begins)
            told[begin[self.model.far.may(pair_key(self.keys[at[begin]], self.keys[at[begin + 1]]))]] = np.nan
        ends = np.cumsum([len(t) + 1 for t in texts])
        return [told[e - len(t) - 1 : e - 1] for e, t in zip(ends, texts)]


def best_stretches(a: np.ndarray) -> list[float]:
    """For each length the greatest sum of a stretch without gaps (NaN), -inf without one."""
    gap = np.isnan(a)
    sums = np.concatenate([[0.0], np.cumsum(np.where(gap, 0.0, a))])
    gaps = np.concatenate([[0], np.cumsum(gap)])
    out = []
    for n in STRETCHES:
        m = min(n, len(a))
        ok = (gaps[m:] - gaps[:-m]) == 0
        out.append(float((sums[m:] - sums[:-m])[ok].max()) if ok.any() else -math.inf)
    return out


def around_gaps(a: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that hold every stretch with a gap."""
    reach = max(STRETCHES) - 1
    out: list[tuple[int, int]] = []
    for g in np.flatnonzero(np.isnan(a)).tolist():
        lo, hi = max(0, g - reach), min(len(a), g + reach + 1)
        out[-1:] = [(out[-1][0], hi)] if out and lo <= out[-1][1] else [*out[-1:], (lo, hi)]
    return out


def features(n: int, total: float, best: list[float]) -> list[float]:
    """Mean ratio of the most toxic stretch of each length, of the whole text, and 1."""
    return [*(b / k for b, k in zip(best, STRETCHES)), total / n, 1.0] if n else [0.0] * (len(STRETCHES) + 1) + [1.0]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _combined(hot: np.ndarray, w: np.ndarray, v: np.ndarray, y: np.ndarray):
    """Equal pairs of a block once, in order of w and v: words that lie together pack well in a shuffle."""
    order = np.lexsort((v, w))
    w, v, y = w[order], v[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])]))
    c1 = np.add.reduceat(y, first, dtype=np.int64)
    c0 = np.diff(np.append(first, len(w))) - c1
    w, v = w[first], v[first]
    s = np.where(np.isin(w, hot), v % SALTS, 0)
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (w, s, v, c0, c1)], PAIRS.replace(" long", "").split(", "))
    for at in range(0, whole.num_rows, 65_536):
        yield whole.slice(at, 65_536)


def _pairs(hot: np.ndarray):
    """Counts by class of each word of the labelled texts, and of their ends, after the word before it, in blocks of ``PAIR_BLOCK``.

    s deals the pairs of ``hot`` words to several tasks.
    """

    def run(batches):
        keys: dict[str, int] = {}
        block: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in batches:
            for part in parts(b):
                for y, text in zip(part.column("label").to_pylist(), part.column("text").to_pylist()):
                    own = ["", *words_of(text or ""), ""]
                    if len(keys) > CACHE_WORDS:
                        keys.clear()
                    for w in own:
                        if w not in keys:
                            keys[w] = key_of(w)
                    ids = np.fromiter((keys[w] for w in own), np.int64, len(own))
                    block.append((ids[1:], ids[:-1], np.full(len(ids) - 1, y, np.int8)))
                    held += len(ids) - 1
                    if held >= PAIR_BLOCK:
                        yield from _combined(hot, *map(np.concatenate, zip(*block)))
                        block, held = [], 0
        if block:
            yield from _combined(hot, *map(np.concatenate, zip(*block)))

    return run


def _named(batches):
    """The words of the labelled texts, most of them once for a task; Spark's xxhash64 is their key."""
    seen: set[str] = set()
    for b in batches:
        for part in parts(b):
            new: list[str] = []
            for text in part.column("text").to_pylist():
                own = set(words_of(text or "")) - seen
                new += own
                if len(seen) > CACHE_WORDS:
                    seen.clear()
                seen |= own
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], ["word"])


EVIDENCE = "label int, doc_id long, n int, total double, best array<double>, ratios array<double>, lengths array<int>, words array<string>, befores array<string>"


def _evidence(model):
    """What the broadcast tables tell of each text; what lies around words without a ratio is kept for ``_filled``."""

    def run(batches):
        scorer = Scorer(model.value)
        for b in batches:
            for part in parts(b):
                rows = []
                texts = [words_of(t or "") for t in part.column("text").to_pylist()]
                for label, doc, words, a in zip(part.column("label").to_pylist(), part.column("doc_id").to_pylist(), texts, scorer.ratios(texts)):
                    if not words:
                        rows.append((label, doc, 0, 0.0, [0.0] * len(STRETCHES), [], [], [], []))
                        continue
                    ranges = around_gaps(a)
                    kept = [x for i, j in ranges for x in a[i:j].tolist()]
                    gaps = np.flatnonzero(np.isnan(a)).tolist()
                    befores = [words[i - 1] if i else "" for i in gaps]
                    rows.append((label, doc, len(words), float(np.nansum(a)), best_stretches(a), kept, [j - i for i, j in ranges], [words[i] for i in gaps], befores))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()))
                names = [c.split()[0] for c in EVIDENCE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


def _direct(model):
    """The features of each text from tables that hold all ratios, in one Python process."""

    def run(batches):
        scorer = Scorer(model.value)
        for b in batches:
            for part in parts(b):
                ratios = scorer.ratios([words_of(t or "") for t in part.column("text").to_pylist()])
                xs = [features(len(a), float(a.sum()), best_stretches(a) if len(a) else []) for a in ratios]
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("doc_id"), pa.array(xs, pa.list_(pa.float64()))], ["label", "doc_id", "x"])

    return run


def _pair_keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(pair_key(b.column("v").to_numpy(), b.column("w").to_numpy()))], ["key"])


def _spelled(model):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(model.value.spelled(b.column("word").to_pylist()))], ["word", "ratio"])

    return run


def _filled(batches):
    for b in batches:
        xs = []
        columns = (b.column(c).to_pylist() for c in ("n", "total", "best", "ratios", "lengths", "words", "befores", "found"))
        for n, total, best, kept, lengths, words, befores, found in zip(*columns):
            if words:
                known = {(f["before"], f["word"]): f["ratio"] for f in found}
                a = np.array(kept, float)
                fill = [known[p] for p in zip(befores, words)]
                a[np.isnan(a)] = fill
                total += sum(fill)
                cut = np.cumsum([0, *lengths])
                for i, j in zip(cut[:-1], cut[1:]):
                    best = [max(x, y) for x, y in zip(best, best_stretches(a[i:j]))]
            xs.append(features(n, total, best))
        yield pa.RecordBatch.from_arrays([b.column("label"), b.column("doc_id"), pa.array(xs, pa.list_(pa.float64()))], ["label", "doc_id", "x"])


def _grams(word: Column) -> Column:
    p = F.concat(F.lit("^" * (ORDER - 1)), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(p) - (ORDER - 1)), lambda i: F.substring(p, i, F.lit(ORDER)))


def word_chances(words: DataFrame) -> DataFrame:
    """Add p0, p1: each class's chance of a word by its contexts (c0, c1), with the backoff that both share.

    The lowest order is uniform over all words that either class knows; a class gives it its discounts
    and ``SHARED`` contexts for each word, by its share of all contexts.
    """
    n0, n1, size = words.agg(F.sum("c0"), F.sum("c1"), F.count("*")).first()
    n, out = [n0 or 0, n1 or 0], words
    for c in (0, 1):
        own = F.greatest(F.col(f"c{c}") - DISCOUNT, F.lit(0.0))
        most = SHARED * max(n[c], 1) / max(sum(n), 1)
        whole = words.agg(F.sum(own)).first()[0] or 0.0
        out = out.withColumn(f"p{c}", (own + most) / (whole + most * max(size, 1)))
    return out


def pair_chances(pairs: DataFrame, words: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(v, w, p0, p1) of the kept ``pairs`` (v, w, c0, c1), and (v, b0, b1), the share that backs off after v.

    Where ``pairs`` tell which are near, both do too; a word v is near with any of its pairs.  After any v, class c's chance of w is p_c of the pair, or b_c times the word's own where the pair is
    not kept; over all words they add up to 1.  A text's end is a word, so what follows v is as often as v.
    """
    t0, t1 = (x or 0 for x in words.agg(F.sum("t0"), F.sum("t1")).first())
    lead = words.select(F.col("w").alias("v"), *[(F.col(f"t{c}") + F.lit(max(t, 1) / max(t0 + t1, 1))).alias(f"n{c}") for c, t in enumerate((t0, t1))])
    own = lambda c: F.greatest(F.col(f"c{c}") - DISCOUNT, F.lit(0.0))
    kept = pairs.join(lead, "v").join(words.select("w", "p0", "p1"), "w")
    near = [c for c in pairs.columns if c == "near"]
    sums = pairs.groupBy("v").agg(F.count("*").alias("k"), F.sum(own(0)).alias("o0"), F.sum(own(1)).alias("o1"), *[F.max(c).alias(c) for c in near])
    heads = sums.join(lead, "v")
    for c in (0, 1):
        share = F.lit(SHARED) * F.col(f"n{c}") / (F.col("n0") + F.col("n1"))
        heads = heads.withColumn(f"s{c}", share).withColumn(f"z{c}", F.col(f"n{c}") + share * F.col("k")).withColumn(f"b{c}", (F.col(f"n{c}") - F.col(f"o{c}")) / F.col(f"z{c}"))
    heads = ws.save(heads.select("v", "s0", "s1", "z0", "z1", "b0", "b1", *near), "heads")
    kept = kept.drop("n0", "n1").join(heads.drop(*near), "v")
    told = [((own(c) + F.col(f"s{c}")) / F.col(f"z{c}") + F.col(f"b{c}") * F.col(f"p{c}")).alias(f"p{c}") for c in (0, 1)]
    return ws.save(kept.select("v", "w", *told, *near), "pairs"), heads.select("v", "b0", "b1", *near)


def least_within(table: DataFrame, column: Column, most: int) -> tuple[float, bool]:
    """The least value of ``column`` such that at most ``most`` rows have it or a greater one, and whether these are all.

    A row for each value comes to the driver.
    """
    least, rows = math.inf, 0
    for g, k in sorted(map(tuple, table.groupBy(column.alias("g")).count().collect()), reverse=True):
        rows += k
        if rows > most:
            break
        least = float(g)
    return least, rows <= most


class Tables:
    """Ratios of all words, kept pairs, spellings and their histories, as Spark tables, and a broadcast model of the first.

    Pairs that are not near are not broadcast; they, and the words that begin no near one, are told by
    a filter of bounded size; what it may hold is joined with the tables.
    """

    def __init__(self, words: DataFrame, pairs: DataFrame, ws: Workspace):
        spark = words.sparkSession
        words = ws.save(word_chances(words), "chances")
        self.words = ws.save(words.select("w", "word", (F.col("c0") + F.col("c1")).alias("n"), F.log(F.col("p1") / F.col("p0")).alias("ratio")), "ratios")
        self._spell(words.where("word <> ''"), ws)
        chances, backs = pair_chances(pairs, words, ws)
        found, all_words = self._first(self.words, ["w"], MAX_WORDS)
        all_pairs = "near" not in pairs.columns
        near = F.lit(True) if all_pairs else F.col("near")
        self.pairs = chances.select("v", "w", F.log(F.col("p1") / F.col("p0")).alias("ratio"), near.alias("near"))
        self.backs = backs.select("v", F.log(F.col("b1") / F.col("b0")).alias("ratio"), near.alias("near"))
        both = self.pairs.where("near").drop("near").toArrow()  # MAX_PAIRS rows at most
        back = self.backs.where("near").drop("near").toArrow()  # no more rows than these pairs
        far = None
        if not all_pairs:
            others = self.pairs.where("NOT near").select("v", "w").mapInArrow(_pair_keys, "key long").unionByName(self.backs.where("NOT near").select(F.col("v").alias("key")))
            far = self._filter(ws.save(others, "far"))
        grams, all_grams = self._first(self.grams.withColumn("key", F.xxhash64("gram")), ["key"], MAX_GRAMS)
        contexts, all_contexts = self._first(self.contexts.withColumn("key", F.xxhash64("past")), ["key"], MAX_GRAMS)
        self.spells = all_grams and all_contexts
        whole = all_words and self.spells
        self.whole = whole and all_pairs
        spelled = lambda t: Table(t["key"].to_numpy()[: t.num_rows * self.spells], values(t)[: t.num_rows * self.spells])
        values = lambda t: t["ratio"].to_numpy()
        ws.drop(words)
        ends = np.unique(both["w"].to_numpy())
        model = ToxicModel(
            Table(found["w"].to_numpy(), values(found)), Table(pair_key(both["v"].to_numpy(), both["w"].to_numpy()), values(both)),
            Table(ends, np.ones(len(ends))), Table(back["v"].to_numpy(), values(back)),
            spelled(grams), spelled(contexts), whole, far,
        )
        self.model = spark.sparkContext.broadcast(model)

    @staticmethod
    def _first(table: DataFrame, keys: list[str], most: int) -> tuple[pa.Table, bool]:
        """At most ``most`` rows, those of most contexts, and whether these are all."""
        least, whole = least_within(table, F.col("n"), most)
        return table.where(F.col("n") >= F.lit(least)).select(*keys, "ratio").toArrow(), whole

    @staticmethod
    def _filter(keys: DataFrame) -> Filter:
        """A filter of ``keys`` (key), ``FAR_BITS`` for each and ``MOST_FAR_BITS`` at most."""
        size = min(MOST_FAR_BITS, 32_768 * max(1, -(-keys.count() * FAR_BITS // 32_768)))
        out = np.zeros(size // 8, np.uint8)
        for r in bit_rows(keys, F.pmod("key", F.lit(size))).toLocalIterator():
            out[r["bucket"] * 4_096 : (r["bucket"] + 1) * 4_096] = np.frombuffer(r["bits"], np.uint8)
        return Filter(out)

    def _spell(self, counts: DataFrame, ws: Workspace) -> None:
        top = counts.select(F.explode(_grams(F.col("word"))).alias("gram"), "c0", "c1").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        top = ws.save(top, "grams")
        # Shared lower order: in how many contexts does a character follow a history?
        ends = top.groupBy(F.substring("gram", 2, ORDER - 1).alias("end")).agg(F.count("*").alias("n"))
        low = F.substring("end", 1, ORDER - 2)
        sums = ends.groupBy(low.alias("l")).agg(F.sum("n").alias("s"), F.count("*").alias("kinds"))
        lower = ends.join(sums, low == F.col("l")).select("end", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") / 300) / F.col("s")).alias("lower"))
        kept = top.where(F.greatest("c0", "c1") >= LEAST_SPELLINGS).withColumn("past", F.substring("gram", 1, ORDER - 1))
        for k in (0, 1):
            kept = kept.withColumn(f"c{k}", F.when(F.col(f"c{k}") >= LEAST_SPELLINGS, F.col(f"c{k}")).otherwise(0))
        kept = ws.save(kept, "kept")
        past = kept.groupBy("past").agg(*[F.sum(f"c{k}").alias(f"s{k}") for k in (0, 1)], *[F.count_if(F.col(f"c{k}") > 0).alias(f"kinds{k}") for k in (0, 1)])
        share = lambda k: F.when(F.col(f"s{k}") > 0, DISCOUNT * F.col(f"kinds{k}") / F.col(f"s{k}")).otherwise(1.0)
        past = past.select("past", "s0", "s1", share(0).alias("h0"), share(1).alias("h1"))
        self.contexts = ws.save(past.select("past", (F.col("s0") + F.col("s1")).alias("n"), F.log(F.col("h1") / F.col("h0")).alias("ratio")), "contexts")
        own = lambda k: F.when(F.col(f"s{k}") > 0, F.greatest(F.col(f"c{k}") - DISCOUNT, F.lit(0.0)) / F.col(f"s{k}")).otherwise(0.0) + F.col(f"h{k}") * F.col("lower")
        grams = kept.join(past, "past").join(lower, F.substring("gram", 2, ORDER - 1) == F.col("end"))
        self.grams = ws.save(grams.select("gram", (F.col("c0") + F.col("c1")).alias("n"), F.log(own(1) / own(0)).alias("ratio")), "spellings")

    def ratios(self, words: DataFrame, ws: Workspace) -> DataFrame:
        """word, ratio of distinct ``words`` (word)."""
        known = ws.save(words.join(self.words.select("word", "ratio"), "word", "left"), "known")
        unknown = known.where("ratio IS NULL")
        if self.spells:
            return known.where("ratio IS NOT NULL").unionByName(unknown.select("word").mapInArrow(_spelled(self.model), "word string, ratio double"))
        parts = unknown.select("word", F.explode(_grams(F.col("word"))).alias("gram"))
        parts = parts.join(self.grams.select("gram", F.col("ratio").alias("g")), "gram", "left").withColumn("past", F.substring("gram", 1, ORDER - 1))
        parts = parts.join(self.contexts.select("past", F.col("ratio").alias("c")), "past", "left")
        spelled = parts.groupBy("word").agg(F.sum(F.coalesce("g", "c", F.lit(0.0))).alias("ratio"))
        spelled = spelled.withColumn("ratio", F.greatest(F.lit(-SPELLED), F.least(F.lit(SPELLED), F.col("ratio"))))
        return known.where("ratio IS NOT NULL").unionByName(spelled)

    def told(self, asked: DataFrame, ws: Workspace) -> DataFrame:
        """before, word, ratio of distinct ``asked`` (before, word), from the whole tables: a kept pair's, or the word's with what backs off."""
        known = asked.join(self.ratios(asked.select("word").distinct(), ws), "word").withColumn("v", F.xxhash64("before")).withColumn("w", F.xxhash64("word"))
        known = known.join(self.backs.select("v", F.col("ratio").alias("after")), "v", "left").join(self.pairs.select("v", "w", F.col("ratio").alias("pair")), ["v", "w"], "left")
        return known.select("before", "word", F.coalesce("pair", F.col("ratio") + F.coalesce("after", F.lit(0.0))).alias("ratio"))

    def features(self, rows: DataFrame, ws: Workspace) -> DataFrame:
        """label, doc_id, x of ``rows`` (label, doc_id, text)."""
        schema = "label int, doc_id long, x array<double>"
        if self.whole:
            return rows.mapInArrow(_direct(self.model), schema)
        out = rows.mapInArrow(_evidence(self.model), EVIDENCE)
        none = F.array().cast("array<struct<before:string,word:string,ratio:double>>")
        out = ws.save(out.withColumn("row", F.monotonically_increasing_id()), "evidence")
        asked = out.select("row", F.explode(F.array_distinct(F.arrays_zip("befores", "words"))).alias("p")).select("row", F.col("p.befores").alias("before"), F.col("p.words").alias("word"))
        told = ws.save(self.told(ws.save(asked.select("before", "word").distinct(), "asked"), ws), "told")
        # A row's list is no longer than its text.
        found = asked.join(told, ["before", "word"]).groupBy("row").agg(F.collect_list(F.struct("before", "word", "ratio")).alias("found"))
        full = out.where(F.size("words") == 0).withColumn("found", none).unionByName(out.where(F.size("words") > 0).join(found, "row"))
        return full.mapInArrow(_filled, schema)


def hot_words(sample: DataFrame) -> np.ndarray:
    """Keys of the words that make up ``HOT_PART`` of ``sample`` (label, text) or more; they decide where pairs are counted, not what is."""
    counts = sample.select("label", "text").mapInArrow(_pairs(np.array([], np.int64)), PAIRS).groupBy("w").agg(F.sum(F.col("c0") + F.col("c1")).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= F.lit(HOT_PART * total)).select("w").toArrow()["w"].to_numpy()  # 1 / HOT_PART rows at most


def count_contexts(rows: DataFrame, toxic_share: float, ws: Workspace, hot: np.ndarray | None = None, *, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Words and kept pairs of all ``rows`` (label, text).

    Words: w (key), word, c0, c1 (distinct words before it in texts of each class), t0, t1 (how often it stands there).
    Pairs: v, w, c0, c1 (how often w follows v) where ``GAIN`` keeps them: with ``every`` all, as a model needs them, and
    where they are more than ``MAX_PAIRS`` whether each is near, of those of most gain; without it the near ones, for a look at them.  The empty word is a text's start and end.
    All pairs move once, combined in each task, to the tasks of their word (several for a ``hot`` one); both tables are made there.
    """
    hot = np.array([], np.int64) if hot is None else hot
    pairs = rows.select("label", "text").mapInArrow(_pairs(hot), PAIRS).repartition("w", "s")
    pairs = pairs.groupBy("w", "s", "v").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    none = F.lit(None).cast("long")
    # Counted by w and s without moving; then a row for each word moves.
    counted = pairs.groupBy("w", "s").agg(F.count_if(F.col("c0") > 0).alias("k0"), F.count_if(F.col("c1") > 0).alias("k1"), F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
    counted = counted.groupBy("w").agg(F.sum("k0").alias("c0"), F.sum("k1").alias("c1"), F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
    counted = counted.select(F.lit("words").alias("kind"), "w", none.alias("v"), "c0", "c1", "t0", "t1", F.lit(None).cast("string").alias("word"))
    share = [max(1e-9, 1 - toxic_share), max(1e-9, toxic_share)]
    part = lambda c: F.when(F.col(f"c{c}") > 0, F.col(f"c{c}") * F.log(F.col(f"c{c}") / ((F.col("c0") + F.col("c1")) * share[c]))).otherwise(0.0)
    # The gain, in hundredths, stands where words have their first count.
    gain = (200 * (part(0) + part(1))).cast("long")
    kept = pairs.where(gain >= 100 * GAIN).select(F.lit("pairs").alias("kind"), "w", "v", "c0", "c1", gain.alias("t0"), none.alias("t1"), F.lit(None).cast("string").alias("word"))
    named = rows.select("text").mapInArrow(_named, "word string").distinct()
    named = named.select(F.lit("names").alias("kind"), none.alias("w"), none.alias("v"), none.alias("c0"), none.alias("c1"), none.alias("t0"), none.alias("t1"), "word")
    all_ = ws.save(counted.unionByName(kept).unionByName(named), "counts")
    names = all_.where("kind = 'names'").select(F.xxhash64("word").alias("w"), F.col("word").alias("name"))
    words = all_.where("kind = 'words'").select("w", "c0", "c1", "t0", "t1").join(names, "w", "left").withColumn("word", F.coalesce("name", F.lit(""))).drop("name")
    pairs = all_.where("kind = 'pairs'")
    gain = F.least(F.col("t0"), F.lit(100_000))
    least, whole = least_within(pairs, gain, MAX_PAIRS)
    near = gain >= F.lit(least)
    pairs = (pairs if whole or every else pairs.where(near)).select("v", "w", "c0", "c1", *([near.alias("near")] if every and not whole else []))
    words, pairs = ws.save(words, "words"), ws.save(pairs, "marked")
    ws.drop(all_)
    return words, pairs


def bit_rows(keys: DataFrame, place: Column) -> DataFrame:
    """(bucket, bits): a bitmap of ``place``, 32,768 bits a row."""
    at = keys.select(place.alias("at")).select(F.expr("at div 32768").alias("bucket"), F.expr("at % 32768").alias("bit"))
    return at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_labelled(source: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """``source`` without most rows whose doc_id has no label; none that has one is lost.

    A bitmap over hashed ids, ``FILTER_BITS`` for each label and ``MOST_BITS`` (64 MB) at most, is
    broadcast; beyond that more rows pass, and the join with the labels drops them.
    """
    n = labels.count()
    size = min(MOST_BITS, 32_768 * max(1, -(-n * FILTER_BITS // 32_768)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    bits = ws.save(bit_rows(labels, place), "filter")
    placed = source.withColumn("_at", place).withColumn("bucket", F.expr("_at div 32768"))
    found = placed.join(F.broadcast(bits), "bucket")  # MOST_BITS at most
    byte = F.conv(F.hex(F.expr("substring(bits, int((_at % 32768) div 8) + 1, 1)")), 16, 10).cast("int")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, int(_at % 8))")) != 0).drop("_at", "bucket", "bits")


def fit(source: DataFrame, labels: DataFrame, ws: Workspace) -> tuple[Tables, np.ndarray]:
    """Tables of ratios and their curve from ``source`` (doc_id, text) and ``labels`` (doc_id, label 0/1).

    A quarter of the distinct texts of each class, by hash, and at most ``HELD_ROWS``, fit the
    curve; all others are counted.  Copies of a held text are not counted.
    """
    # Written, so that Spark knows the size of the labels before it chooses how to join them.
    labels = ws.save(labels.where("label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")), "labels")
    toxic_share = labels.agg(F.avg("label")).first()[0] or 0.0
    near = maybe_labelled(source.where("text IS NOT NULL AND doc_id IS NOT NULL"), labels, ws)
    near = near.select("doc_id", "text", F.xxhash64("text").alias("h"))
    marked = near.select("doc_id", "h").join(labels, "doc_id").where(F.pmod("h", F.lit(4)) == 0)
    one = marked.groupBy("label", "h").agg(F.min("doc_id").alias("doc_id")).withColumn("order", F.xxhash64("h"))
    held = ws.save(one.where("label = 1").orderBy("order").limit(HELD_ROWS).unionByName(one.where("label = 0").orderBy("order").limit(HELD_ROWS)), "held")
    few = F.broadcast(held.select("label", "h"))  # 2 * HELD_ROWS at most
    sample = near.join(F.broadcast(held.select("label", "h", "doc_id")), ["h", "doc_id"]).dropDuplicates(["label", "h"])
    sample = ws.save(sample, "sample").select("label", "doc_id", "text")
    counts = count_contexts(near.join(labels, "doc_id").join(few, ["label", "h"], "left_anti").select("label", "text"), toxic_share, ws, hot_words(sample), every=True)
    tables = Tables(*counts, ws)
    ws.drop(*counts)
    x = tables.features(sample, ws).toArrow()  # 2 * HELD_ROWS rows at most
    y = x["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return tables, np.array([3.0, 0.0, 0.0, -12.0])
    return tables, logistic(np.array(x["x"].to_pylist()), y)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each document, from a model fitted on ``labels`` (doc_id, label) of ``docs``.

    A null or empty text, or one without words, has no evidence: the curve's value at
    zero.  Without held labels of both classes a fixed curve is used.  Repeated rows get
    equal scores.  Other columns are not read; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "toxic")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tables, w = fit(source, labels, ws)
    x = tables.features(source.select(F.lit(None).cast("int").alias("label"), "doc_id", "text"), ws)
    at = sum((F.col("x")[i] * F.lit(float(c)) for i, c in enumerate(w)), F.lit(0.0))
    return x.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))).alias("score"))


def fold(id_col: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))
