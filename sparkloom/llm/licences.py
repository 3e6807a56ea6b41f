"""Licence notices and identifier tags in whole texts."""

from __future__ import annotations

import functools
import itertools
import re
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import cut, plain

#: Phrases whose places are counted.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further phrases of licence notices, by the label that they show.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit license": "mit",
    "apache license 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license v 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
}
#: Words of the tags that an expression of identifiers follows after a colon.
TAGS = ("spdx license identifier", "license expression", "licence expression")
#: Openness of an identifier by its first letters, the longest that fits: 3 permissive, 2 weak copyleft, 1 strong copyleft, 0 restricted or unknown.
OPENNESS = {
    "0bsd": 3, "afl": 3, "apache": 3, "artistic": 3, "bsd": 3, "bsl": 3, "cc-by": 3, "cc0": 3, "isc": 3, "mit": 3, "ncsa": 3, "openssl": 3, "postgresql": 3,
    "psf": 3, "python": 3, "unicode": 3, "unlicense": 3, "wtfpl": 3, "x11": 3, "zlib": 3,
    "cddl": 2, "cpl": 2, "epl": 2, "eupl": 2, "lgpl": 2, "mpl": 2, "ms-rl": 2, "ofl": 2,
    "agpl": 1, "cc-by-sa": 1, "gpl": 1, "osl": 1, "sspl": 1,
    "busl": 0, "cc-by-nc": 0, "cc-by-nd": 0, "elastic": 0, "licenseref": 0, "documentref": 0,
}
#: Chance that a place of each kind is no statement of a licence.
DOUBT = {"tag": 0.05, "base": 0.2, "notice": 0.2}
CHUNK_BYTES = 1 << 20
_CARRY = max(len(p.split()) for p in [*BASE, *NOTICES, *TAGS]) - 1


class Node(NamedTuple):
    """An operand or an operator of an expression: its text, how open it is, how tightly it binds, and what it joins."""

    text: str
    openness: int
    binds: int
    left: Node | None = None
    right: Node | None = None


class Terms(NamedTuple):
    """The value of an expression: its licences' labels, how open it is, and its text with only the brackets it needs."""

    labels: list[str]
    openness: int
    text: str


def label(identifier: str) -> str:
    """An identifier's label: lower-case, without "only" and "or later", a version's last ``.0`` and versions of cc licences."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"(-\d+)\.0$", r"\1", name)
    return re.sub(r"^(cc-by[a-z-]*|cc0)-\d[\d.]*$", r"\1", name)


def openness(name: str) -> int:
    fits = [k for k in OPENNESS if name == k or re.match(re.escape(k) + r"[-.\d]", name)]
    return OPENNESS[max(fits, key=len)] if fits else 0


#: How tightly each operator binds; an operand binds tightest.
BINDS = {b"or": 1, b"and": 2, b"with": 3}
OPERAND = 4
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:+-]*))")


def _joined(op: bytes, a: Node, b: Node) -> Node:
    """All terms hold under AND, so the least open counts; a reader may choose under OR; an exception lifts a strong copyleft to a weak one."""
    if op == b"with":
        value = 2 if a.openness == 1 else a.openness
    else:
        value = (min if op == b"and" else max)(a.openness, b.openness)
    return Node(op.decode().upper(), value, BINDS[op], a, b)


def _terms(root: Node) -> Terms:
    """Written out with a stack of its own, so that depth has no limit."""
    out, labels, todo = [], set(), [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.left is None:
            out.append(n.text)
            labels.add(label(n.text))
        else:
            for side in (n.right, n.left):
                if side is n.right and n.binds == BINDS[b"with"]:
                    todo.append(side.text)  # an exception is no licence
                elif side.binds < n.binds or (side is n.right and side.binds == n.binds):
                    todo += [")", side, "("]
                else:
                    todo.append(side)
                if side is n.right:
                    todo.append(f" {n.text} ")
    return Terms(sorted(labels), root.openness, "".join(out))


def evaluate(text: str | bytes, at: int = 0) -> Terms | None:
    """The value of the longest expression that begins at ``at``, by the shunting-yard rule; None where there is none.

    ``WITH`` binds tighter than ``AND`` and that tighter than ``OR``, in any case; equal ones
    group to the left.  A licence stands left of WITH and an exception right of it, each a plain
    name.  An expression ends before what cannot go on from it: a second operand in a row, an
    operator without an operand, a bracket that is not closed, the line's end, any other character.
    """
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    operands: list[Node] = []
    operators: list[bytes] = []
    depth, want = 0, True
    last: Node | None = None

    def close(values: list[Node], ops: list[bytes], floor: int) -> None:
        while ops and ops[-1] != b"(" and BINDS[ops[-1]] >= floor:
            b, a = values.pop(), values.pop()
            values.append(_joined(ops.pop(), a, b))

    while m := _TOKEN.match(data, at):
        sign, word = m.groups()
        op = word.lower() if word and word.lower() in BINDS else None
        after_with = operators[-1:] == [b"with"]
        if want and sign == b"(" and not after_with:
            operators.append(sign)
            depth += 1
        elif want and word and not op:
            operands.append(Node(word.decode(), openness(label(word.decode())), OPERAND))
            want = False
        elif not want and op and not (op == b"with" and (after_with or operands[-1].binds != OPERAND)):
            close(operands, operators, BINDS[op])
            operators.append(op)
            want = True
        elif not want and sign == b")" and depth:
            close(operands, operators, 0)
            operators.pop()
            depth -= 1
        else:
            break
        at = m.end()
        if not want and not depth:  # whole up to here; at depth 0 the stacks hold a few entries
            values, ops = list(operands), list(operators)
            close(values, ops, 0)
            last = values[-1]
    return _terms(last) if last else None


class _Phrase(NamedTuple):
    kind: str
    label: str
    words: int


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    known: dict[str, list[_Phrase]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, name in phrases.items():
            known.setdefault(f" {phrase} ", []).append(_Phrase(kind, name, len(phrase.split())))
    for phrase, items in known.items():
        auto.add_word(phrase, (len(phrase), items))
    auto.make_automaton()
    return auto


def scan(text: str | None) -> tuple[int, list[tuple]]:
    """(words, findings) of a text; a finding is (word, words, kind, labels, expression, openness).

    Words are counted from 0.  A tag is a finding only where an expression follows it.
    """
    data, raw = plain(text), None
    n_words, found = 0, []
    for start, end, carried in cut(data, CHUNK_BYTES, _CARRY):
        words = data[start:end].split()
        own = len(words) - carried
        line = " " + b" ".join(words).decode("latin-1") + " "
        for stop, (length, items) in _automaton().iter(line):
            word = line.count(" ", 0, stop - length + 1)
            if word >= own:
                continue
            for p in items:
                if p.kind != "tag":
                    found.append((n_words + word, p.words, p.kind, [p.label], None, openness(p.label)))
                    continue
                raw = raw if raw is not None else text.encode("utf-8", "surrogatepass")
                last = next(itertools.islice(re.finditer(rb"[^ ]+", data[start:end]), word + p.words - 1, None)).end()
                if raw[start + last : start + last + 1] == b":" and (terms := evaluate(raw, start + last + 1)):
                    found.append((n_words + word, p.words, "tag", terms.labels, terms.text, terms.openness))
        n_words += own
    return n_words, sorted(found, key=lambda f: (f[0], f[2], f[1], f[3]))


FINDING = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()), ("kind", pa.string()), ("labels", pa.list_(pa.string())), ("expression", pa.string()), ("openness", pa.int32())]))
_FIELDS = [f.name for f in FINDING.value_type]


def _scan(batches):
    for b in batches:
        for at in range(0, max(b.num_rows, 1), 512):  # findings of a few texts at a time
            part = b.slice(at, 512)
            got = [scan(t) for t in part.column("text").to_pylist()]
            found = pa.array([[dict(zip(_FIELDS, f)) for f in fs] for _, fs in got], FINDING)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), found], ["doc_id", "n_words", "findings"])


def find_licences(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_words, findings.

    ``findings`` lists, in order of words, the places of licence phrases and of identifier tags:
    word (from 0), words, kind ("base", "notice", "tag"), labels, expression (of a tag, written
    plainly) and openness (3 permissive, 2 weak copyleft, 1 strong copyleft, 0 restricted or unknown).

    An Aho-Corasick automaton goes once over the words of a text, in chunks of ``CHUNK_BYTES`` that
    carry the words of the longest phrase; a word of any length stays whole.  What follows a tag goes
    through ``evaluate``.  A null or empty text has no words and no findings.  Rows that
    repeat an id, and rows without one, are judged by their own text.  Only ``doc_id`` and ``text``
    are read, so other columns may have any names; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = "array<struct<word long, words int, kind string, labels array<string>, expression string, openness int>>"
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, n_words long, findings {found}")


def _of(kind: str) -> Column:
    return F.filter("findings", lambda f: f["kind"] == kind)


def _listed(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda f: f["labels"])))), ",")


def summarise(found: DataFrame) -> DataFrame:
    """Counts, labels and a score for each row of ``find_licences``.

    ``score`` is the chance that some finding states a licence, each at its own (``DOUBT``).
    ``openness`` is the least of the findings that are tags, null without any.
    """
    base = F.transform(_of("base"), lambda f: f["word"])
    tags = _of("tag")
    kept = F.lit(1.0)
    for kind, doubt in DOUBT.items():
        kept = kept * F.pow(F.lit(doubt), F.size(_of(kind)))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        _listed(_of("base")).alias("base_labels"), _listed(F.col("findings")).alias("labels"), F.round(1 - kept, 9).alias("score"),
        F.array_join(F.transform(tags, lambda f: f["expression"]), "; ").alias("expressions"), F.array_min(F.transform(tags, lambda f: f["openness"])).alias("openness"),
    )
