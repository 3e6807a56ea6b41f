"""Exact, line and near-duplicate removal against brute force and on odd rows."""

import hashlib
import itertools
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, line_dedup, near_dedup
from sparkloom.llm.components import UnionFind
from sparkloom.llm.store import Workspace

SCHEMA = "doc_id long, text string, id string, bucket string, n long"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "w " * 30_000), (8, "w " * 30_000), (9, "é" * 50 + " x"), (9, "é" * 50 + " x")]


def shingles(text, k):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_truth(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    uf = UnionFind()
    for i, _ in sets:
        uf.find(i)
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            uf.union(a, b)
    return {i: uf.find(i) for i, _ in sets}


def corpus(seed, groups=12, copies=8):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 90))]
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 8))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(300)}"
            rows.append((n, " ".join(words)))
            n += 1
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_matches_all_pairs(spark, k):
    rows = corpus(k)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(table(spark, rows), shingle=k, percent=80).collect()}
    want = near_truth(rows, k, 80)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) and r["n_shingles"] == len(shingles(dict(rows)[i], k)) for i, r in got.items())


def test_near_in_one_hot_group(spark, monkeypatch):
    """Copies that differ among each other, in blocks smaller than the group."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(40):
        words = list(base)
        for at in rng.sample(range(60), rng.randrange(0, 7)):
            words[at] = f"x{n}_{at}"
        rows.append((n, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, rows), shingle=2).collect()}
    assert got == near_truth(rows, 2, 80)


def test_near_with_repeated_ids(spark):
    """Rows of one id are one document, and each of their texts keeps its links."""
    rng = random.Random(9)
    base = {c: [f"{c}{rng.randrange(900)}" for _ in range(60)] for c in "abcd"}

    def copy(c, n):
        words = list(base[c])
        for at in rng.sample(range(60), n):
            words[at] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(5, copy("a", 0)), (5, copy("b", 0)), (6, copy("a", 1)), (7, copy("b", 1)), (8, copy("a", 2)), (9, copy("b", 2))]
    rows += [(3, copy("c", 1)), (11, copy("c", 0)), (11, copy("d", 0)), (12, copy("d", 1)), (13, "alone here"), (13, "and there too")]
    rows += [(20, copy("a", 0)) for _ in range(30)]
    got = near_dedup.near_duplicates(table(spark, rows), shingle=2).collect()
    assert len(got) == len(rows) and all(r["component_id"] == near_truth(rows, 2, 80)[r["doc_id"]] for r in got)
    assert {r["component_id"] for r in got if r["doc_id"] == 12} == {3}


def test_near_giant_group_and_strangers(spark, monkeypatch):
    """A bucket with a giant component deals its members once for each block of strangers."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    named = spark.createDataFrame([(1, i, 0 if i < 400 else i) for i in range(403)] + [(2, 1, 0), (2, 2, 0)], "bucket long, id long, component long")
    sides = near_dedup._sides(named, Workspace(spark, "test"))
    assert sides.where("side").count() == 403 and sides.where("NOT side").count() == 3 * 101


def test_near_odd_rows(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table(spark, ODD), shingle=2).collect()), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == len(ODD)
    assert by[1] == (1, 0, 1, True) and by[2][2] == 2 and by[3][1:] == (0, 3, True)
    assert by[5][2] == 4 and by[6][2] == 6 and by[8][1:] == (1, 7, False) and by[None][2] is None and by[None][3]
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_exact(spark):
    rows = [r for r in ODD if r[0] not in (9, None)] + [(20, None), (21, "one"), (22, "ONE ")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(table(spark, rows), capacity=2).collect()}
    texts = {i: t or "" for i, t in rows}
    for i, t in texts.items():
        same = [j for j, u in texts.items() if u == t]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), i == max(same))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def exact_truth(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row by comparing all texts."""
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        same = ids[t or ""]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("key_bits,capacity", [(64, 4), (1, 1000), (1, 3), (3, 7)])
def test_exact_chains_of_colliding_keys(spark, key_bits, capacity):
    rng = random.Random(key_bits + capacity)
    rows = [(rng.choice([None, *range(30)]), f"t{rng.randrange(12)}") for _ in range(150)] + [(None, "only null"), (None, "only null"), (4, "x"), (4, "y")]
    got = exact_dedup.exact_duplicates(table(spark, rows), key_bits=key_bits, capacity=capacity).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact_truth(rows)


def test_exact_many_hot_buckets(spark):
    rows = [(i, f"t{i % 700}") for i in range(2100)]
    got = exact_dedup.exact_duplicates(table(spark, rows), capacity=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact_truth(rows)


def test_the_driver_holds_slots_at_any_size():
    rows = 10**9
    mean = rows >> 16
    rng = np.random.default_rng(1)
    counts = dict(enumerate(rng.poisson(mean, 1 << 16).tolist()))
    for hot in (7, 40_000, 65_000):
        counts[hot] += rows // 30
    buckets = exact_dedup.directory(counts, exact_dedup.capacity_for(rows), 16)
    assert sum(b.rows > exact_dedup.capacity_for(rows) for b in buckets) == 3 and len(buckets) <= 1 << 16


def test_exact_odd_and_empty(spark):
    got = exact_dedup.exact_duplicates(table(spark, ODD)).collect()
    assert sorted((tuple(r) for r in got), key=str) == exact_truth(ODD)
    twice = [r for r in got if r["doc_id"] == 9]
    assert [r["group_size"] for r in twice] == [2, 2] and all(r["kept"] for r in twice)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0
    low = exact_dedup.exact_duplicates(table(spark, [(1, "a"), (2, "A")]), normalise=F.lower).collect()
    assert {r["keep_id"] for r in low} == {2}


def test_directory_doubles_only_where_needed():
    d = exact_dedup.directory({0: 5, 1: 5, 4: 1, 7: 1}, 6, 3)
    assert [(b.prefix, b.depth, b.rows) for b in d] == [(0, 3, 5), (1, 3, 5), (1, 2, 0), (1, 1, 2)]
    assert sum(2 ** (3 - b.depth) for b in d) == 8
    below = exact_dedup.directory({0: 9, 3: 1}, 6, 2, prefix=5, depth=16)
    assert [(b.prefix, b.depth, b.rows) for b in below] == [(20, 18, 9), (21, 18, 0), (11, 17, 1)]


def lines_truth(rows, least=40, docs=5):
    keys = lambda t: [x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    held = {}
    for i, t in rows:
        for k in set(keys(t)):
            if i is not None:
                held.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x, k in zip(lines, keys(t)) if not (i is not None and len(k) >= least and len(held[k]) >= docs and i < max(held[k]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(1)
    pool = ["Common line number %d with enough letters in it" % i for i in range(6)] + ["é" * 40, "é" * 39, "short", "", "  COMMON line number 0 with enough letters in it\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(40)] + [(50, None), (51, "z" * 100_000)]
    for batches, text in ((1, True), (6, True), (4, False)):
        got = line_dedup.dedup_lines(table(spark, rows), batches=batches, with_text=text).collect()
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got), key=str) == lines_truth(rows)
        assert not text or all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_lines_count_documents_not_rows(spark):
    line = "a line that is long enough to count for the rule"
    rows = [(1, line)] * 4 + [(2, line), (3, line), (4, line + "\nother")]
    got = line_dedup.dedup_lines(table(spark, rows), with_text=False)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()), key=str) == lines_truth(rows)
    assert got.where("n_dropped > 0").count() == 0
    more = rows + [(9, line)]
    got = line_dedup.dedup_lines(table(spark, more), with_text=False)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got.collect()), key=str) == lines_truth(more)
    assert got.where("n_dropped > 0").count() == 7


def test_lines_odd_and_empty(spark):
    line = "a line that is long enough to count for the rule"
    rows = [(i, line) for i in range(4)] + [(None, line), (7, f"{line}\n{line}"), (7, line)]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got), key=str) == lines_truth(rows)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_runs_hold_exact_counts(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    rng = random.Random(0)
    want = {}
    for top in (300, 200, 100, 0):
        lines = {(top + rng.randrange(100), rng.randrange(20), 1) for _ in range(60)}
        for d, k, _ in lines:
            n, t = want.get(k, (0, -1))
            want[k] = (n + 1, max(t, d))
        runs.add(spark.createDataFrame(list(lines), "doc_id long, k1 long, k2 long"))
    assert {r["k1"]: (r["n_docs"], r["top_doc"]) for r in runs.merged().collect()} == want
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    runs.clear()
