"""Language ID by a linear-chain conditional random field over the words of a text.

Word features are hashed byte n-grams with word edges (the n-grams at an edge are
affixes) and the word itself (lexicon).  Transitions are learned from chains of
labelled texts, so labels can switch within a text; forward-backward gives each
word's marginals, and a text's language is the one with the most expected words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import U, mix, powers
from .store import Workspace

#: Hash rows of n-gram and lexicon weights.
GRAMS, LEXICON = 1 << 15, 1 << 16
SIZES = (1, 2, 3, 4)
#: Bounds of the labelled texts of each language that a model is fitted on: how many, and their bytes in all.
MAX_ROWS, MAX_BYTES = 200, 4_000_000
#: Texts of one training chain, and rounds of training.
CHAIN, ROUNDS = 8, 25
#: Words of a block in forward-backward.
BLOCK = 64
#: Bytes of the texts that a task holds as words and marginals at once (a longer text is alone), and what a text counts for at least.
RUN_BYTES, LEAST_BYTES = 1 << 18, 6 * BLOCK
CACHE_WORDS = 100_000
MARKS = b".,;:!?|\"'()[]{}<>*_#&%$=+-/\\"
#: A letter; numerals such as a half are word characters and no letters.
LETTER = regex.compile(r"\p{L}")


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram rows of all words in a row, each word's first, and its lexicon row."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    data = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03", np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes of the word from here on
    word = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(data), np.uint64)
        for n in range(1, max(SIZES) + 1):
            m = len(data) - n + 1
            if m <= 0:
                break
            h = h[:m] * U(257) + data[n - 1 :] + U(1)
            if n in SIZES:
                ok = left[:m] >= n
                rows.append((mix(h[ok] + U(n) * U(0x9E3779B97F4A7C15)) % U(GRAMS)).astype(np.int32))
                owners.append(word[:m][ok])
        first = ends - sizes
        v = data * powers(int(sizes.max()), U(0x100000001B3))[np.arange(len(data)) - np.repeat(first, sizes)]
        lex = (mix(np.add.reduceat(v, first)) % U(LEXICON)).astype(np.int32)
    rows_, owner = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    rows_, owner = rows_[order], owner[order]
    return rows_, np.searchsorted(owner, np.arange(len(words))), lex


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def emissions(self, rows: np.ndarray, first: np.ndarray, lex: np.ndarray) -> np.ndarray:
        """Scores of words: the mean of their n-grams' weights, plus the lexicon's."""
        n = np.diff(np.append(first, len(rows)))
        return np.add.reduceat(self.grams[rows], first, axis=0) / n[:, None] + self.lexicon[lex]


def forward_backward(e: np.ndarray, offsets: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of every position of the non-empty sequences; with ``pairs`` also expected transitions.

    Sequences are cut into blocks.  Block products give each block's incoming
    messages; then all blocks run side by side.
    """
    n_seq, L = len(offsets) - 1, e.shape[1]
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    nb = int(blocks.sum())
    at = np.arange(len(e)) - np.repeat(offsets[:-1], sizes) + np.repeat(first, sizes) * BLOCK
    X = np.ones((nb * BLOCK, L))
    X[at] = np.exp(e - e.max(axis=1, keepdims=True))
    real = np.zeros(nb * BLOCK, bool)
    real[at] = True
    X, real = X.reshape(nb, BLOCK, L).transpose(1, 0, 2).copy(), real.reshape(nb, BLOCK).T.copy()
    A = np.exp(transition - transition.max())
    s = np.exp(start - start.max())
    s = s / s.sum()
    head = np.zeros(nb, bool)
    head[first] = True
    norm = lambda v: v / v.sum(axis=-1, keepdims=True)

    P = np.broadcast_to(np.eye(L), (nb, L, L)).copy()
    for b in range(BLOCK):
        step = (P.reshape(-1, L) @ A).reshape(nb, L, L) * X[b][:, None, :]
        if b == 0:
            step[head] = (s * X[0][head])[:, None, :]
        P = np.where(real[b][:, None, None], step / step.sum(axis=(1, 2), keepdims=True), P)
    into = np.full((nb, L), 1.0 / L)
    out = np.full((nb, L), 1.0 / L)
    order = np.argsort(-blocks, kind="stable")
    counts = blocks[order]
    top = int(counts[0]) if n_seq else 0
    for k in range(1, top):
        cur = first[order[: np.searchsorted(-counts, -k, "left")]] + k  # sequences of more than k blocks
        into[cur] = norm((into[cur - 1][:, None, :] @ P[cur - 1])[:, 0])
    last = first + blocks - 1
    for k in range(1, top):
        cur = last[order[: np.searchsorted(-counts, -k, "left")]] - k
        out[cur] = norm((P[cur + 1] @ out[cur + 1][:, :, None])[:, :, 0])

    alpha = np.empty_like(X)
    v = into
    for b in range(BLOCK):
        step = (v @ A) * X[b]
        if b == 0:
            step[head] = s * X[0][head]
        v = np.where(real[b][:, None], norm(step), v)
        alpha[b] = v
    marginal = np.empty_like(X)
    expected = np.zeros((L, L))
    w = out
    for b in range(BLOCK - 1, -1, -1):
        marginal[b] = norm(alpha[b] * w)
        right = X[b] * w
        if pairs:
            use = real[b] & ~(head if b == 0 else np.zeros(nb, bool))
            before = (alpha[b - 1] if b else into)[use]
            joint = before[:, :, None] * A * right[use][:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        w = np.where(real[b][:, None], norm(right @ A.T), w)
    return marginal.transpose(1, 0, 2).reshape(-1, L)[at], expected


def split_words(text: str) -> list[bytes]:
    """Lower-cased words without marks at their edges; what is only marks is no word."""
    return [w for x in text.lower().encode().split() if (w := x.strip(MARKS))]


def train(texts: list[str], labels: list[str]) -> Model:
    """Fit by Adam on the whole chains; texts are chained in the order given."""
    names = sorted(set(labels))
    L = len(names)
    vocabulary: dict[bytes, int] = {}
    ids, ys, sizes, own = [], [], [], 0
    for i, (t, y) in enumerate(zip(texts, labels)):
        words = split_words(t)
        ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        ys += [names.index(y)] * len(words)
        own += len(words)
        if (i + 1) % CHAIN == 0 or i + 1 == len(texts):
            if own:
                sizes.append(own)
            own = 0
    model = Model(names, np.zeros((GRAMS, L)), np.zeros((LEXICON, L)), np.zeros((L, L)), np.zeros(L))
    if not ids:
        return model
    word, y = np.array(ids), np.array(ys)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    rows, first, lex = word_features(list(vocabulary))
    n = np.diff(np.append(first, len(rows)))
    gold = np.zeros((len(y), L))
    gold[np.arange(len(y)), y] = 1
    seen = np.zeros((L, L))
    inner = np.ones(len(y), bool)
    inner[offsets[:-1]] = False
    np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    model.transition += np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True))
    parts = [model.grams, model.lexicon, model.transition, model.start]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    gram_owner = np.repeat(np.arange(len(n)), n)
    for step in range(1, ROUNDS + 1):
        e = model.emissions(rows, first, lex)[word]
        p, expected = forward_backward(e, offsets, model.transition, model.start, pairs=True)
        diff = p - gold
        per_word = np.stack([np.bincount(word, diff[:, c], len(n)) for c in range(L)], axis=1)
        share = per_word / n[:, None]
        g = [
            np.stack([np.bincount(rows, share[gram_owner, c], GRAMS) for c in range(L)], axis=1),
            np.stack([np.bincount(lex, per_word[:, c], LEXICON) for c in range(L)], axis=1),
            expected - seen,
            diff[offsets[:-1]].sum(axis=0),
        ]
        for i, part in enumerate(parts):
            grad = g[i] / len(sizes) + 1e-4 * part
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            part -= 0.2 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    return model


class Tagger:
    """Expected words per language of texts, with a memory of word emissions."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.labels)))

    def shares(self, texts: list[str]) -> np.ndarray:
        """Per text, each label's share of the words; rows of zeros for texts without words."""
        sizes, p = self.marginals([split_words(t) for t in texts])
        out = np.zeros((len(texts), len(self.model.labels)))
        full = np.flatnonzero(sizes)
        if len(full):
            offsets = np.concatenate([[0], np.cumsum(sizes[full])])
            out[full] = np.add.reduceat(p, offsets[:-1], axis=0) / sizes[full][:, None]
        return out

    def runs(self, text: str) -> list[tuple[int, int, str, float]]:
        """Stretches (first word, end, label, mean marginal) of words of one likeliest label."""
        words = split_words(text)
        _, p = self.marginals([words])
        if not words:
            return []
        best = p.argmax(axis=1)
        cut = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(words)]
        return [(a, b, self.model.labels[best[a]], float(p[a:b, best[a]].mean())) for a, b in zip(cut[:-1], cut[1:])]

    def marginals(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The number of words of each text, and the label marginals of all words in a row."""
        L = len(self.model.labels)
        if len(self.known) > CACHE_WORDS:
            self.known, self.table = {}, np.zeros((0, L))
        known = self.known
        new = list({w for ws in split for w in ws if w not in known})
        if new:
            base = len(self.table)
            rows = [self.model.emissions(*word_features(new[i : i + 20_000])) for i in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table, *rows])
            known.update(zip(new, range(base, base + len(new))))
        sizes = np.array([len(ws) for ws in split], np.int64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return sizes, np.zeros((0, L))
        ids = np.array([known[w] for ws in split for w in ws], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes[full])])
        return sizes, forward_backward(self.table[ids], offsets, self.model.transition, self.model.start)[0]


def _predictor(model, field: int | None):
    """Languages of column 1, or of a field of the struct in column 0; column 0 goes along."""

    def run(batches):
        tagger = Tagger(model.value)
        names = model.value.labels
        for b in batches:
            texts = (b.column(0).field(field) if field is not None else b.column(1)).cast(pa.large_string())
            # A text takes whole blocks, so a short one counts as a block's words.
            lengths = np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), LEAST_BYTES)
            ends = np.cumsum(lengths)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_BYTES, "right")))
                part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                spoken = np.array([bool(LETTER.search(t)) for t in part])
                share = tagger.shares([t if ok else "" for t, ok in zip(part, spoken)]) if names else np.zeros((len(part), 1))
                best = share.argmax(axis=1)
                score = np.clip(share[np.arange(len(part)), best], 0, 1)
                ok = spoken & (len(names) > 0)
                pred = [names[i] if o else "und" for i, o in zip(best, ok)]
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(pred, pa.string()), pa.array(np.where(ok, score, 1.0))], [own.schema.names[0], "lang_pred", "score"])
                lo = hi

    return run


def fit(labelled: DataFrame, ws: Workspace):
    """A broadcast model from ``labelled`` (doc_id, text, lang): 32 * MAX_ROWS texts of all languages at most.

    Per language the documents of least hashed doc_id are chosen, ``MAX_ROWS`` and ``MAX_BYTES``
    at most, without their texts, which only the chosen ones then give.
    """
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    w = Window.partitionBy("lang").orderBy("order", "doc_id")
    ids = usable.select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id").alias("order")).where(F.col("bytes") <= MAX_BYTES // 8)
    ids = ids.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MAX_ROWS)
    ids = ids.withColumn("_b", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_b") <= MAX_BYTES)
    ids = ws.save(ids.select("doc_id", "order").distinct(), "chosen")
    some = usable.join(ids, "doc_id").dropDuplicates(["doc_id", "lang", "text"]).orderBy("order", "doc_id", "lang", "text").limit(32 * MAX_ROWS)
    rows = some.select("text", "lang").toArrow()
    return ws.spark.sparkContext.broadcast(train(rows["text"].to_pylist(), rows["lang"].to_pylist()))


def identify_language(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id (with ``carry`` a struct ``doc`` of every column), lang_pred, score for each row, by a model of ``labelled`` (doc_id, text, lang).

    ``score`` is the share of the text's words expected in ``lang_pred``.  A null
    text, or one without a letter, is ``und`` with score 1, as is every text where
    nothing is labelled.  Repeated rows get equal results; columns of any other name may be there, and an
    empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "crf")
    model = fit(labelled, ws)
    if carry:
        source, field = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), docs.columns.index(text_col)
    else:
        source, field = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), None
    schema = T.StructType([source.schema.fields[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(_predictor(model, field), schema)


def label_words(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``runs`` of each row: stretches of words (first_word, end_word, lang, score) of one language.

    Words are numbered from 0 as ``split_words`` gives them; ``score`` is the mean marginal of the
    stretch.  A null text, one without words, or nothing labelled gives no stretch.
    """
    ws = Workspace(docs.sparkSession, "crf")
    model = fit(labelled, ws)
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches):
        tagger = Tagger(model.value)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                texts = b.column(1).slice(lo, 64).to_pylist()
                runs = [[dict(zip(("first_word", "end_word", "lang", "score"), r)) for r in tagger.runs(t or "")] if model.value.labels else [] for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 64), pa.array(runs, kind)], ["doc_id", "runs"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, runs array<struct<first_word:int,end_word:int,lang:string,score:double>>")


def fold(id_col: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))
