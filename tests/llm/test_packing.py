"""Tokens, packing, shards and mixing."""

import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import mixing, packing, shards, tokens
from sparkloom.llm.store import Workspace

TEXTS = [None, "", " \t\n", "Hello, World! it's 42", "don't <|endoftext|> x", "İstanbul Ǆ ﬁ naïve Σίσυφος ΣΑΣ", "日本語 テスト e\u0301 \u00a0x", "a" * 5000, "trash " * 3000, "C:\\x/y_z--!!", "x\x1cy\x85z"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, length long, piece int")


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.tokenizer_path())
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    got = tokens.token_pieces(docs(spark, rows), length=700).orderBy("doc_id", "piece").collect()
    for i, t in enumerate(TEXTS):
        want = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        parts = [r for r in got if r["doc_id"] == i]
        assert [x for r in parts for x in tokens.as_ids(r["ids"]).tolist()] == want
        assert [r["start"] for r in parts] == list(range(0, len(want), 700)) and all(r["length"] == 700 for r in parts[:-1])
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in parts)


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(items) <= capacity.documents and sum(n * n for _, n in items) <= capacity.attention
    return len(bins)


def test_pack_carries_columns_of_any_names(spark):
    rows = [(1 if i % 3 else None, 0, 700, i, i + 1, i + 2, f"o{i}", "s") for i in range(30)]
    p = spark.createDataFrame(rows, "doc_id long, piece int, length long, rank long, _chunk int, _row int, offset string, `a b` string")
    out = packing.pack(p)
    got = out.collect()
    assert out.columns == ["doc_id", "piece", "length", "rank", "_chunk", "_row", "a b", "sequence_id", "offset"]
    assert sorted(r["rank"] for r in got) == list(range(30)) and all((r["_chunk"], r["_row"]) == (r["rank"] + 1, r["rank"] + 2) for r in got)
    assert check_packing(got, packing.Capacity()) == 15


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(2048, 5, 2048 * 2048), packing.Capacity(2048, 2048, 1_500_000)])
def test_every_capacity_holds(spark, capacity, rule):
    rng = random.Random(7)
    top = int(capacity.attention**0.5)
    rows = [(rng.randrange(50), 0, min(top, rng.choice([2048, 1, 17, rng.randrange(1, 2049)]))) for _ in range(700)]
    p = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = packing.pack(p, capacity=capacity, rule=rule).collect()
    assert len(got) == len(rows)
    n = check_packing(got, capacity)
    assert n >= -(-sum(r[2] for r in rows) // capacity.tokens)
    if capacity == packing.Capacity() and rule == "norm":
        assert n <= sum(r[2] for r in rows) / capacity.tokens * 1.03 + 1


def test_packing_equals_sequential_best_fit():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 90) for _ in range(300)]
    hist = [(s, sizes.count(s)) for s in set(sizes)]
    _, bins = packing.best_fit(hist, packing.Capacity(100, 100, 10_000), weights=(1, 0, 0))
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            best = min(fits)
            room.remove(best)
            room.append(best - s)
        else:
            room.append(100 - s)
    assert bins == len(room)


def test_packing_null_ids_and_ties(spark):
    rows = [(None, 0, 5)] * 30 + [(1, 0, 5)] * 3 + [(2, 0, 2048)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long")).collect()
    assert len(got) == len(rows) and check_packing(got, packing.Capacity()) == 2


def test_packing_empty_and_errors(spark):
    p = spark.createDataFrame([], "doc_id long, piece int, length long")
    assert packing.pack(p).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit([(3000, 1)], packing.Capacity())


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = shards.feistel(np.arange(n), n, 9)
    assert sorted(p) == list(range(n)) and (shards.feistel(p, n, 9, inverse=True) == np.arange(n)).all()


def test_shards_round_trip(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.tokenizer_path())
    rows = [(i, t, "s") for i, t in enumerate(TEXTS * 6)] + [(3, "again", "s"), (3, "again", "s"), (None, "no id", "s")]
    folder = Workspace(spark, "test").new_path("bin")
    size = 50 * 128
    man = shards.write_shards(docs(spark, rows), folder, stride=64, shard_bytes=size)
    assert man.count() == man.count()  # the manifest is saved: asking again writes nothing
    man = man.collect()
    back = {(r["shard"], r["row"]): r["ids"] for r in shards.read_slots(spark, folder, stride=64, shard_bytes=size).collect()}
    slots = {r["slot"] for r in man}
    assert slots == set(range(len(back))) and {s * 50 + r for s, r in back} == slots
    found = {}
    for r in man:
        row = back[(r["shard"], r["slot"] % 50)]
        ids = np.frombuffer(row, "<u2").astype("<u4")[r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and zlib.crc32(row) == r["row_crc32"]
        assert r["byte_offset"] == (r["slot"] % 50) * 128 and r["shard"] == r["slot"] // 50
        found.setdefault(r["doc_id"], []).append((r["start"], ids.tolist()))
    for i, t in [*enumerate(TEXTS * 6), (None, "no id")]:
        want = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        if i != 3:
            assert [x for _, part in sorted(found[i]) for x in part] == want
    again = [*tk.encode("again", add_special_tokens=False).ids, 0]
    assert sum(len(part) for _, part in found[3]) == len(tk.encode(TEXTS[3], add_special_tokens=False).ids) + 1 + 2 * len(again)
    used = sum(r["length"] for r in man)
    assert len(back) * 64 - used < 64 * 16  # only the last sequence of a split is padded
    assert shards.read_slots(spark, folder, stride=64, shard_bytes=size, start=70).count() == len(back) - 70
    assert shards.write_shards(docs(spark, []), Workspace(spark, "test").new_path("bin"), stride=64).count() == 0


def test_one_encoder_per_worker():
    a = tokens.encoder(tokens.tokenizer_path())
    assert tokens.encoder(tokens.tokenizer_path()) is a
    limit, tokens.CACHE_BYTES = tokens.CACHE_BYTES, 4_000
    try:
        want = [a.tokenizer.encode(f"some{i} words{i}", add_special_tokens=False).ids for i in range(300)]
        got = [tokens.as_ids(a.encode(f"some{i} words{i}".encode())).tolist() for i in range(300)]
        assert got == want and len(a) < 30 and len(a.parts) < 30
    finally:
        tokens.CACHE_BYTES = limit


def fill(sizes, weights, share, cap):
    """Deal by weight, cut what is over, and deal that again until none is."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(0, 200))), rng.choice(["b", "a", "c", "é", None])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " lead and trail \n", "only"), (None, "no id", "a")] + [(1003, "x " * 180, "a")] * 30
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    words = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = fill(sizes, (3, 1, 2), 1.5, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(25, 0.02 * target[s]), s
    again = mixing.mix_sources(docs(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_goes_on_after_a_long_document(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(3, 30) for _ in range(600)] + [1500, 1700, 1900, 2100] * 4
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)]
    got = mixing.mix_sources(docs(spark, rows), weights=(1,), share=0.5, cap=2.0, seed=seed).collect()
    keys = dict(spark.createDataFrame([(i,) for i in range(len(rows))], "doc_id long").select("doc_id", mixing.uniform(seed, "doc_id")).collect())
    g = [2 ** (0.25 * int(np.log2(n + 1))) for n in sizes]
    level = sum(sizes) / 2 / sum(a * b for a, b in zip(g, sizes))
    odds = {i: level * g[i] / (1 - level * g[i]) for i in keys}
    assert max(level * x for x in g) < 1
    keys = {i: (o := (u / (1 - u)) / odds[i]) / (1 + o) for i, u in keys.items()}
    missing, want = sum(sizes) / 2, set()
    for i in sorted(keys, key=lambda i: (keys[i], i)):
        if sizes[i] <= missing:
            want.add(i)
            missing -= sizes[i]
    spare = {i: abs(missing - sizes[i]) for i in keys if i not in want}
    best = min(spare, key=lambda i: (spare[i], keys[i], i))
    if spare[best] < missing:
        want.add(best)
    assert {r["doc_id"] for r in got if r["copies"]} == want
    assert abs(sum(r["taken"] for r in got) - sum(sizes) / 2) <= 15


def test_pareto_samples_hit_inclusion_odds(spark):
    """Over many seeds a size class is taken as often as its odds say, and longer documents more often."""
    sizes = [1, 3, 7, 15, 31] * 300
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)]
    g = {n: 2 ** (0.25 * int(np.log2(n + 1))) for n in set(sizes)}
    level = 0.5 * sum(sizes) / sum(g[n] * n for n in sizes)
    frame = docs(spark, rows).cache()
    taken, runs = dict.fromkeys(g, 0), 2
    for seed in range(runs):
        got = mixing.mix_sources(frame, weights=(1,), share=0.5, seed=seed).collect()
        assert abs(sum(r["taken"] for r in got) - sum(sizes) / 2) <= 1
        for r in got:
            taken[r["size"]] += r["copies"]
    for n, k in taken.items():
        p = level * g[n]
        assert 0 < p < 1 and abs(k / (300 * runs) - p) < 4 * (p * (1 - p) / (300 * runs)) ** 0.5, (n, k, p)


def test_mixing_carries_rows_and_whole_copies(spark):
    rows = [(i, "w " * (1 + i % 40), "a" if i % 3 else "b") for i in range(300)] + [(5, "other text", "a")]
    frame = docs(spark, rows)
    got = mixing.mix_sources(frame, weights=(50, 1), share=1.2, carry=True)
    flat = got.select("doc.*", "copies")
    assert flat.columns == [*frame.columns, "copies"] and flat.count() == len(rows)
    a = [r for r in flat.collect() if r["source"] == "a"]
    assert {r["copies"] for r in a if r["text"] != ""} <= {1, 2} and sum(r["copies"] for r in a) > len(a)  # the heavier source has whole copies
