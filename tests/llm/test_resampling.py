"""Importance resampling, licence scans and the conversation trie."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import importance, licences, order, trie
from sparkloom.llm.chunks import cut, plain
from sparkloom.llm.store import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 20])
@pytest.mark.parametrize("carry", [0, 2, 12])
def test_chunks_own_every_word_once(size, carry):
    for text in ["", " ", "a", "A-b  c", "x" * 500 + " y", "  one two, three Ünï 4 five " * 9]:
        data, got = plain(text), []
        spans = list(cut(data, size, carry))
        for s, e, c in spans:
            w = data[s:e].split()
            got += w[: len(w) - c]
            assert c == carry or not data[e:].strip()
            assert w == [x.encode() for x in words(text)][len(got) - (len(w) - c) : len(got) + c]
        assert [g.decode() for g in got] == words(text)


def brute_importance(docs, target, percent=5, least=20):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    ss, tt = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * ss / ((s[b] + 1) * tt)))
    out = []
    for i, x in docs:
        f = features(x)
        w = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = fit[: len(fit) * percent // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(rank)] + [(*r, None) for r in [*fit[len(rank) :], *(r for r in out if r[1] < least)]], key=str)


@pytest.fixture
def texts():
    rng = random.Random(3)
    pool = [f"W{i}" for i in range(40)] + ["ä", "ß9", "x_y", "日本"]
    line = lambda n: " ".join(rng.choices(pool, k=n)) + rng.choice([".", " ", ", "])
    rows = [(i, line(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for i in range(120)]
    rows += [(200, line(30000)), (201, "long" * 30000), (202, "a " * 40000), (203, None), (204, ""), (205, " \n-"), (None, line(25)), (None, None)]
    rows += [(206, rows[0][1]), (207, rows[120][1]), (207, rows[120][1]), (207, line(50)), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("size", [50, 1 << 15])
def test_importance_equals_brute_force(spark, texts, monkeypatch, size):
    monkeypatch.setattr(importance, "CHUNK_BYTES", size)
    target = ["W1 W2 W3", "", None, "ä W7 日本 W7"] * 3
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in texts], "doc_id long, text string, weight int, rank int, chunk int, n int").repartition(3)
    got = importance.importance_sample(docs, spark.createDataFrame([(t, 0) for t in target], "text string, bucket int"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_importance(texts, target)


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance.importance_sample(none, some).collect() == []
    (row,) = importance.importance_sample(some, none, percent=100).collect()
    assert tuple(row)[1:] == brute_importance([(1, "a " * 30)], [], 100)[0][1:] and row["rank"] == 1


def test_places_in_order_with_weights(spark):
    rows = [(i % 7, i, i % 3 + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, w long").repartition(5)
    got = order.placed(df, [df["k"].asc(), df["v"].desc()], Workspace(spark, "t"), weight="w").collect()
    at = 0
    for r, want in zip(sorted(got, key=lambda r: r["place"]), sorted(rows, key=lambda r: (r[0], -r[1]))):
        assert (r["k"], r["v"], r["w"], r["place"]) == (*want, at)
        at += want[2]


# Licences


@pytest.mark.parametrize(
    "text, labels, openness, plainly",
    [
        ("MIT", ["mit"], 3, "MIT"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2"], 2, "GPL-2.0-only WITH Classpath-exception-2.0"),
        ("MIT OR Apache-2.0 AND GPL-3.0+", ["apache-2", "gpl-3", "mit"], 3, "MIT OR Apache-2.0 AND GPL-3.0+"),
        ("(MIT OR Apache-2.0) AND GPL-3.0-or-later", ["apache-2", "gpl-3", "mit"], 1, "(MIT OR Apache-2.0) AND GPL-3.0-or-later"),
        ("((MIT))", ["mit"], 3, "MIT"),
        ("mit and (isc and zlib)", ["isc", "mit", "zlib"], 3, "mit AND (isc AND zlib)"),
        ("LicenseRef-x or CC-BY-NC-4.0", ["cc-by-nc", "licenseref-x"], 0, "LicenseRef-x OR CC-BY-NC-4.0"),
        ("MIT */", ["mit"], 3, "MIT"),
        ("MIT and then some", ["mit", "then"], 0, "MIT AND then"),
        ("MIT OR", ["mit"], 3, "MIT"),
        ("MIT OR (ISC", ["mit"], 3, "MIT"),
        ("MIT) x", ["mit"], 3, "MIT"),
        ("(MIT OR ISC) WITH x", ["isc", "mit"], 3, "MIT OR ISC"),
        ("GPL-2.0 WITH x WITH y", ["gpl-2"], 2, "GPL-2.0 WITH x"),
        ("MIT\nOR ISC", ["mit"], 3, "MIT"),
    ],
)
def test_expressions(text, labels, openness, plainly):
    got = licences.evaluate(text)
    assert (got.labels, got.openness, got.text) == (labels, openness, plainly)


def test_expressions_that_are_none():
    for text in ["", "OR MIT", "(MIT", "()", "-", "WITH", "\nMIT"]:
        assert licences.evaluate(text) is None


def test_deep_and_long_expressions():
    deep = licences.evaluate("(" * 20000 + "MIT" + ")" * 20000)
    assert deep.text == "MIT"
    many = licences.evaluate(" AND ".join(f"L{i}" for i in range(20000)))
    assert len(many.labels) == 20000 and many.text.count(" AND ") == 19999
    nested = licences.evaluate("(MIT OR " * 5000 + "ISC" + ")" * 5000)
    assert nested.labels == ["isc", "mit"] and nested.openness == 3


def brute_licences(text):
    w = words(text)
    places = lambda phrases: [(i, n) for p, n in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base, notices = places(licences.BASE), places(licences.NOTICES)
    tags = []
    for tag in licences.TAGS:
        sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        low = (text or "").translate(LOWER)
        for m in re.finditer(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + sep.join(tag.split()) + ":", low):
            tags.append(licences.evaluate(text[m.end() :]))
    tags = [t for t in tags if t]
    labels = sorted({n for _, n in base + notices} | {x for t in tags for x in t.labels})
    at = [i for i, _ in base]
    score = round(1 - 0.05 ** len(tags) * 0.2 ** (len(base) + len(notices)), 9)
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in base})), ",".join(labels), score, min((t.openness for t in tags), default=None)


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_licences_equal_brute_force(spark, monkeypatch, size):
    if size != 1 << 20:  # in this process; the workers keep their own size
        monkeypatch.setattr(licences, "CHUNK_BYTES", size)
    cases = [
        None, "", "Under the MIT License.", "under the mit license under the MIT-license", "xunder the mit license", "under the mit licenses", "Licensed under the Apache License, Version 2.0.",
        "CC BY-NC 4.0 and cc-by-sa", "GNU General Public License, version 3.", "// SPDX-License-Identifier: (MIT OR GPL-2.0) AND ISC */\nunder the mit license",
        "SPDX-License-Identifier MIT", "SPDX-License-Identifier: ?", "aspdx-license-identifier: MIT", "Ünder the mit license x", "cc by nc by nc cc by nc", "License-Expression: Apache-2.0",
        "word " * 3000 + "cc by nc " + "é" * 3000 + " apache license version 2", "apache license version 2 0 spdx license identifier: ZLIB spdx-license-identifier:MIT",
    ]
    for t in cases:
        n, found = licences.scan(t)
        assert (n, sum(f[2] == "base" for f in found)) == brute_licences(t)[:2]
        assert sorted({x for f in found for x in f[3]}) == sorted(filter(None, brute_licences(t)[5].split(",")))
    docs = spark.createDataFrame([(None if i == 3 else i % 12, t, "x", 1) for i, t in enumerate(cases)], "doc_id long, text string, labels string, findings int").repartition(3)
    got = licences.summarise(licences.find_licences(docs)).collect()
    want = [(None if i == 3 else i % 12, *brute_licences(t)) for i, t in enumerate(cases)]
    assert sorted(((*tuple(r)[:8], r["openness"]) for r in got), key=str) == sorted(want, key=str)
    assert licences.summarise(licences.find_licences(docs.limit(0))).collect() == []


# The conversation trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = convs.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, m in members.items():
        own = (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0)
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += own
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))
        yield min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()


def trie_rows():
    rng = random.Random(5)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", "d  e\nf", "é x y z"]))
    rows = [(c, t, *turn()) for c in range(90) for t in range(rng.randrange(1, 7))]
    rows += [(200, t, "user", f"w {t % 3}") for t in range(300)] + [(201, t, "user", f"w {t % 3}") for t in range(260)] + [(202, t, "user", f"w {t % 3}") for t in range(128)]
    rows += [(300 + c, t, "user", "same") for c in range(60) for t in range(4)]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (7, 1, "x", "tie"), (7, 1, "x", "tie two"), (None, 0, "user", "lost"), (413, 0, "u", "only")]
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 64)
    rows = trie_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(3)
    got = sorted(map(tuple, trie.conversation_trie(df).collect()))
    assert got == sorted(brute_trie(rows), key=lambda r: (r[0], r[1]))


def test_ends_in_many_pieces(spark):
    rows = [(c, 0, "user", "hi") for c in range(20, 9020)]
    got = {r["depth"]: r for r in trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sum(r["n_children"] for r in got.values()) == len(got) - 1 and got[0]["n_convs"] == 9000
    assert [tuple(r) for r in got.values()] and sorted(map(tuple, got.values())) == sorted(brute_trie(rows))


def test_trie_of_an_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
