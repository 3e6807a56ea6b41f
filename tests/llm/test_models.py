"""Language ID, toxicity, secrets, top-k and the pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import crf, queries, secrets, topk, toxicity
from sparkloom.llm.store import Workspace

SF = "/root/testdata/sf0.001"


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    e, A, s, off = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), np.array([0, 5, 7])
    p, _ = crf.forward_backward(e, off, A, s)
    for a, b in zip(off[:-1], off[1:]):
        total, marginal = 0.0, np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            w = np.exp(s[y[0]] + sum(e[a + i, y[i]] for i in range(b - a)) + sum(A[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += w
            for i in range(b - a):
                marginal[i, y[i]] += w
        assert np.allclose(marginal / total, p[a:b])


def test_forward_backward_is_one_chain_whatever_the_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    e, A, s, off = rng.normal(size=(500, 4)), rng.normal(size=(4, 4)), rng.normal(size=4), np.array([0, 350, 351, 500])
    want = crf.forward_backward(e, off, A, s, pairs=True)
    monkeypatch.setattr(crf, "BLOCK", 1024)
    got = crf.forward_backward(e, off, A, s, pairs=True)
    assert np.allclose(want[0], got[0]) and np.allclose(want[1], got[1])


def test_language(spark):
    en, de = "the house and the tree were with this other", "das haus und der baum waren mit diesem anderen"
    rng = random.Random(0)
    make = lambda words: " ".join(rng.choice(words.split()) for _ in range(30))
    train = [(i, make(en if i % 2 else de), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, None), (101, "", None), (102, "123 --- 456", None), (105, "½ ² ٣", None), (103, make(en), None), (104, make(de) + " " + make(en), None), (None, make(de), None), (103, "x " * 40_000, None)]
    schema = "doc_id long, text string, lang string, score double"
    docs = spark.createDataFrame([(*r, 1.0) for r in train + odd], schema)
    got = {}
    for r in crf.identify_language(docs, docs.where("doc_id < 60").select("doc_id", "text", "lang")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(got[i][0]["lang_pred"] == lang for i, _, lang in train)
    assert [got[i][0]["lang_pred"] for i in (100, 101, 102, 105)] == ["und"] * 4
    assert got[None][0]["lang_pred"] == "de" and 0.3 < got[104][0]["score"] < 0.7 and len(got[103]) == 2
    runs = {r["doc_id"]: r["runs"] for r in crf.label_words(docs.where("doc_id IN (101, 104)"), docs.where("doc_id < 60").select("doc_id", "text", "lang")).collect()}
    assert runs[101] == [] and [(r["lang"], r["first_word"], r["end_word"]) for r in runs[104]] == [("de", 0, 30), ("en", 30, 60)]
    kept = crf.identify_language(docs, docs.where("doc_id < 60").select("doc_id", "text", "lang"), carry=True)
    assert kept.columns == ["doc", "lang_pred", "score"] and kept.select("doc.*").columns == docs.columns and kept.count() == docs.count()
    assert crf.identify_language(docs.limit(0), docs.where("doc_id < 60").select("doc_id", "text", "lang")).count() == 0
    none = crf.identify_language(docs, docs.where("doc_id < 0").select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    ok, n = got.join(docs, "doc_id").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert ok / n > 0.93


def test_toxicity(spark):
    rng = random.Random(0)
    plain = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            for at in rng.sample(range(40), 2):
                words[at] = rng.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(words), 1.0))
    rows += [(900, None, 1.0), (901, "", 1.0), (902, "...", 1.0), (903, "word1 " * 30_000 + "vile", 1.0), (None, "word1 word2", 1.0), (5, "word3", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect() if r["doc_id"] != 5}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(300, 400) if i != 5)
    assert max(got[900], got[901], got[902]) < 0.5 and got[903] > 0.5 and all(0 <= v <= 1 for v in got.values())
    assert toxicity.score_toxicity(docs, labels.where("label = 9")).count() == len(rows)


@pytest.mark.parametrize("most", [None, 6])
def test_toxicity_counts_every_labelled_row(spark, monkeypatch, most):
    rng = random.Random(1)
    plain, marks = [f"word{i}" for i in range(40)], [f"{'zq' * 35}{i}" for i in range(4)]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 2 == 0:
            words[rng.randrange(20)] = marks[i // 2 % 4]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(500)], "doc_id long, label int")
    monkeypatch.setattr(toxicity, "MAX_ROWS", 4, raising=False)
    want = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all((want[i] >= 0.7) == (i % 2 == 0) for i in range(500, 600))
    if most:  # ratios of other words are joined, with equal results
        monkeypatch.setattr(toxicity, "MAX_WORDS", most)
        monkeypatch.setattr(toxicity, "MAX_GRAMS", most)
        got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_toxicity_chances_by_brute_force(spark, monkeypatch):
    """Counts, kept pairs and chances of both classes; the chances after any word add up to 1."""
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(12)]
    rows = [(0, " ".join(rng.choice(plain) for _ in range(rng.randrange(0, 14)))) for _ in range(60)] + [(1, None), (0, "")]
    rows += [(1, " ".join([*(rng.choice(plain) for _ in range(4)), "go", "away", rng.choice(["now", "w1"])])) for _ in range(20)]
    pairs, before = {}, {}
    for y, text in rows:
        own = ["", *(text or "").split(), ""]
        for v, w in zip(own, own[1:]):
            pairs.setdefault((v, w), [0, 0])[y] += 1
            before.setdefault(w, (set(), set()))[y].add(v)
    share = [0.75, 0.25]
    gain = {k: 2 * sum(n * np.log(n / (sum(c) * share[y])) for y, n in enumerate(c) if n) for k, c in pairs.items()}
    kept = {k: pairs[k] for k, g in gain.items() if g >= toxicity.GAIN}
    assert ("go", "away") in kept and 0 < len(kept) < len(pairs)
    ws = Workspace(spark, "test")
    # Words that make up enough of a sample are dealt to several tasks.
    table = spark.createDataFrame(rows, "label int, text string")
    often = {w: sum(sum(c) for (_, x), c in pairs.items() if x == w) for w in before}
    monkeypatch.setattr(toxicity, "HOT_PART", 0.05)
    hot = toxicity.hot_words(table)
    assert set(hot.tolist()) == {toxicity.key_of(w) for w, k in often.items() if k >= 0.05 * sum(often.values())} and 0 < len(hot) < len(before)
    words, got = toxicity.count_contexts(table, 0.25, ws, hot)
    # Blocks that end amid the rows add up to the same counts; only hot words have a salt.
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 50)
    batch = pa.RecordBatch.from_pylist([{"label": y, "text": t} for y, t in rows], pa.schema([("label", pa.int32()), ("text", pa.string())]))
    added: dict[tuple[int, int], list[int]] = {}
    blocks = list(toxicity._pairs(hot)([batch]))
    for r in (r for b in blocks for r in b.to_pylist()):
        total = added.setdefault((r["v"], r["w"]), [0, 0])
        total[0] += r["c0"]
        total[1] += r["c1"]
        assert r["s"] == (r["v"] % toxicity.SALTS if r["w"] in hot.tolist() else 0)
    assert len(blocks) > 1 and added == {(toxicity.key_of(v), toxicity.key_of(w)): c for (v, w), c in pairs.items()}
    names = {toxicity.key_of(w): w for w in before}
    assert {r["word"]: (r["c0"], r["c1"], r["t0"], r["t1"]) for r in words.collect()} == {
        w: (len(a), len(b), *(sum(c[y] for (_, x), c in pairs.items() if x == w) for y in (0, 1))) for w, (a, b) in before.items()
    }
    assert {(names[r["v"]], names[r["w"]]): [r["c0"], r["c1"]] for r in got.collect()} == kept
    # Unigrams: discounted contexts and the shared uniform base.
    D, S = toxicity.DISCOUNT, toxicity.SHARED
    n = [sum(len(b[y]) for b in before.values()) for y in (0, 1)]
    p = []
    for y in (0, 1):
        mass = {w: max(len(b[y]) - D, 0) + S * n[y] / sum(n) for w, b in before.items()}
        p.append({w: m / sum(mass.values()) for w, m in mass.items()})
    chances = ws.save(toxicity.word_chances(words))
    for r in chances.collect():
        assert abs(r["p0"] - p[0][r["word"]]) < 1e-12 and abs(r["p1"] - p[1][r["word"]]) < 1e-12
    told, heads = toxicity.pair_chances(got, chances, ws)
    told = {(names[r["v"]], names[r["w"]]): (r["p0"], r["p1"]) for r in told.collect()}
    t = [sum(c[y] for c in pairs.values()) for y in (0, 1)]
    for r in heads.collect():
        v = names[r["v"]]
        for y in (0, 1):
            total = sum(told[(v, w)][y] if (v, w) in told else r[f"b{y}"] * p[y][w] for w in before)
            assert abs(total - 1) < 1e-9
            m = [sum(c[z] for (x, _), c in pairs.items() if x == v) + t[z] / sum(t) for z in (0, 1)]
            own = [w for x, w in kept if x == v]
            s = S * m[y] / sum(m)
            z = m[y] + s * len(own)
            b = (m[y] - sum(max(kept[(v, w)][y] - D, 0) for w in own)) / z
            assert abs(b - r[f"b{y}"]) < 1e-9
            assert all(abs((max(kept[(v, w)][y] - D, 0) + s) / z + b * p[y][w] - told[(v, w)][y]) < 1e-9 for w in own)
    monkeypatch.setattr(toxicity, "MAX_PAIRS", 1)
    assert toxicity.count_contexts(spark.createDataFrame(rows, "label int, text string"), 0.25, ws)[1].count() <= 1


def test_toxicity_reads_pairs_of_words(spark):
    """Words that both classes use alike, toxic only in one order."""
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(24)]
        at = rng.randrange(20)
        words[at : at + 2] = ["red", "blue"] if i % 3 == 0 else ["blue", "red"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(700)], "doc_id long, label int")).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in range(700, 900)) >= 190


@pytest.mark.parametrize("most", [0, 40])
def test_toxicity_joins_pairs_beyond_the_bound(spark, monkeypatch, most):
    """Pairs that are not broadcast, and words that begin no other, give the same scores by joins."""
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(24)]
        for at in (2, 8, 14):
            k = rng.randrange(60)
            words[at : at + 2] = [f"a{k}", f"b{k}"] if i % 3 == 0 else [f"b{k}", f"a{k}"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(700)], "doc_id long, label int")
    want = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MAX_PAIRS", most)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_toxicity_filter_keeps_every_labelled_row(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(0, 3000, 7).selectExpr("id AS doc_id", "1 AS label")
    kept = toxicity.maybe_labelled(docs, labels, Workspace(spark, "test"))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and ids >= set(range(0, 3000, 7)) and len(ids) < 900


def test_toxicity_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_toxicity(spark, sf).where("held_out")
    ok = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("rate"))
    rate = {r["toxic"]: r["rate"] for r in ok.collect()}
    assert rate[1] >= 0.5 and rate[0] <= 0.05


BASE = [
    (0, 2, 12, re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    (1, 0, 18, re.compile(r"AKIA[A-Z0-9]+")),
    (2, 0, 16, re.compile(r"[0-9a-f]+")),
]


def base_spans(text):
    out = [(m.start(), kind, m.end()) for kind, g, least, p in BASE for m in p.finditer(text) if len(m[1 if g else 0]) >= least]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(5)
    bits = ["token=", "secret: ", "API_KEY' = \"", "password", "abcdef0123456789", "AK" + "IA", "ABCDEFGH12345678", " ", "é😀", "=", ":", "\n", "\"", "deadbeefdeadbeefdead", "Zz9" * 8, "x.y-z_", "PassWD =  "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))), rng.choice(["a", "b", None]), None) for i in range(300)]
    rows += [(1000, None, "a", "en"), (1001, "", None, None), (1002, "f" * 50_000 + " token=" + "q" * 50_000, "a", "en"), (1003, rows[0][1], "b", "de"), (1003, rows[0][1], "b", "de")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lang string, spans string")
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _, _ in rows}
    names = ["assign", "access", "hex"]
    for r in got:
        want = base_spans(text[r["doc_id"]])
        line = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in want) for n in range(3)]
        listed = r["spans"].split(",") if r["spans"] else []
        assert [x for x in listed if not x.startswith("owned")] == (line.split(",") if line else [])


def test_secret_ownership(spark):
    live, copied, vendored = "Live9" * 5, "Copy7" * 5, "Vend3" * 5
    rows = [(1, f"see {live} here", "a", "en"), *[(10 + i, f"doc {copied} end", s, "en") for i, s in enumerate("abcd")]]
    rows += [(30 + i, f"lib {vendored} end", "ab"[i % 2], f"l{i // 2}") for i in range(6)] + [(40, f"x {vendored}", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: (r["spans"], r["n_live"], r["n_copied"], r["owners"]) for r in secrets.scan_secrets(docs).collect()}
    assert got[1] == ("owned:4:29", 1, 0, "4:1:1:1") and got[10] == ("", 0, 0, "")
    # Two owners, but six repositories: widely copied; with the owner null there are three and seven.
    assert got[30] == ("", 0, 0, "") and got[40] == ("", 0, 0, "")
    few = {r["doc_id"]: r["owners"] for r in secrets.scan_secrets(docs, copied_owners=9, copied_repos=9).collect()}
    assert few[30] == "4:3:7:7" and few[10] == "4:4:4:4"
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_secret_ownership_separates_examples_from_live_ones(spark):
    """Precision and recall on planted values: live ones of one or two owners, examples of many."""
    rng = random.Random(2)
    value = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(23)) + "7q"
    rows, live = [], set()
    for n in range(60):
        v, hot = value(), n % 3 == 0
        owners = rng.sample(range(20), rng.randrange(3, 9) if hot else rng.randrange(1, 3))
        for o in owners:
            rows.append((len(rows), f"key {v}", f"s{o}", "en"))
            if not hot:
                live.add(len(rows) - 1)
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    assert {r["doc_id"] for r in got if "owned" in r["spans"]} == live


def test_secrets_of_one_text_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(secrets, "CHUNK", 4)
    text = " ".join(f"é{i:020x}" if i % 3 else f"token={'q' * (10 + i % 7)}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a", "en")], "doc_id long, text string, source string, lang string")
    names = ["assign", "access", "hex"]
    want = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base_spans(text))
    assert secrets.scan_secrets(docs).first()["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize("dim,dense", [(1, 0.02), (5, 1.0), (64, 0.02)])
def test_top_k(spark, monkeypatch, dim, dense):
    for name, value in (("CANDIDATE_BYTES", 40 * 8 * dim), ("QUERY_BYTES", 3 * 8 * dim), ("_PAIRS", 64), ("_DENSE", dense)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(dim)
    vec = np.round(rng.normal(size=(260, dim)), 1).astype(np.float32)
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(vec)]
    bad = [(1000, None, "c"), (1001, [None] + [1.0] * (dim - 1), "c"), (1002, [float("nan")] * dim, "c"), (1050, [float("inf")] * dim, "c"), (None, [1.0] * dim, "c"), (1004, [9.0] * (dim + 1), "c")]
    again = [(7, [0.5] * dim, "c"), (50, [0.7] * dim, "c"), rows[100], (8, rows[9][1], "c")]
    df = spark.createDataFrame(rows + bad + again, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in topk.top_k(df, every=50).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows + again]
    for q in {i for i, _ in ok if i % 50 == 0}:
        own = [x for i, x in ok if i == q]
        scores = sorted(((-max(int(x @ y) for x in own), i) for i, y in ok if i != q))[:5]
        assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(scores)}
    assert set(got) == {i for i, _ in ok if i % 50 == 0}


def test_top_k_reads_doubles(spark):
    df = spark.createDataFrame([(0, [0.1, 1e39]), (1, [0.1, 0.0]), (2, [0.3, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df).collect()}
    assert got == {(0, 1): (2, 25 * 76), (0, 2): (1, 25 * 25)}


def test_top_k_few_and_large(spark):
    df = spark.createDataFrame([(0, [3e30, 1.0]), (1, [2e30, -1.0]), (50, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df).collect()
    assert {(r["query_id"], r["rank"]) for r in got} == {(0, 1), (0, 2), (50, 1), (50, 2)} and max(r["score"] for r in got) == 2**63 - 1
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_pipeline(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12345 ...", "en", "src0", 9), (9002, None, None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r["doc_id"] for r in docs.collect()]
    assert not {9001, 9002} & set(seen["language_id"]) and len(seen["language_id"]) == extra.count() - 2 + spark.read.parquet(f"{SF}/documents.parquet").count()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    last = {}
    for i in seen["language_id"]:
        last[texts[i]] = max(i, last.get(texts[i], -1))
    assert sorted(seen["exact_dedup"]) == sorted(last.values())
    assert set(seen["near_dedup"]) <= set(seen["exact_dedup"]) and len(set(seen["near_dedup"])) == len(seen["near_dedup"])
    assert set(seen["mix_sources"]) <= set(seen["near_dedup"]) and max(seen["mix_sources"].count(i) for i in set(seen["mix_sources"])) <= 2
    final = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == set(seen["mix_sources"])


def test_pipeline_odd_rows(spark, tmp_path):
    """Clashing names, repeated ids of several texts, null ids, and an empty table."""
    words = lambda seed: " ".join(random.Random(seed).choice("the house and tree were with this other".split()) + str(seed) for _ in range(30))
    rows = [(i, words(i), "en", "s", 9.0, 1, "x") for i in range(12)] + [(3, words(7), "en", "s", 9.0, 1, "y"), (None, words(40), None, None, 1.0, 2, "z"), (5, None, "en", "s", 0.0, 3, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, copies int, `doc` string")
    stages = dict(corpus_pipeline.STAGES)
    judged = stages["language_id"](spark, docs, "")
    assert judged.columns == docs.columns and judged.where("text IS NULL").count() == 0
    assert sorted(((r["doc_id"], r["doc"]) for r in stages["exact_dedup"](spark, docs.where("text IS NOT NULL"), "").collect()), key=str) == sorted([(i, "x") for i in range(12)] + [(None, "z")], key=str)
    mixed = stages["mix_sources"](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.where("doc_id = 3").groupBy("doc").count().where("count > 2").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_language_runs_hold_few_short_texts():
    """Short texts take a whole block each, so their number bounds a run as well as their bytes."""
    texts = [f"word{i}" for i in range(3000)] + [None, "", "x" * (2 * crf.RUN_BYTES), "one more"]
    held = []

    class Told:
        value = crf.train(["the cat", "le chat"], ["en", "fr"])

    real = crf.Tagger.shares
    crf.Tagger.shares = lambda self, part: held.append(len(part)) or real(self, part)
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
        rows = [x for b in crf._predictor(Told, None)(iter([batch])) for x in b.column(0).to_pylist()]
    finally:
        crf.Tagger.shares = real
    assert rows == list(range(len(texts))) and max(held) <= crf.RUN_BYTES // crf.LEAST_BYTES
