"""Token ids of whole texts by a public tokenizer, and fixed-length pieces of them."""

from __future__ import annotations

import array
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a worker's memory of encoded words may take; the older half goes when it is full.
CACHE_BYTES = 96 << 20
#: What an entry takes besides its word and ids: two objects and its place in the table.
ENTRY_BYTES = 180


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory(dict):
    """A mapping that holds half of ``CACHE_BYTES`` of keys and values, and the half before it in ``old``, from which ``recall`` takes what is still in use."""

    used = 0
    old: dict = {}

    def keep(self, key, ids: bytes) -> bytes:
        self.used += len(key) + len(ids) + ENTRY_BYTES
        if self.used > CACHE_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self[key] = ids
        return ids

    def recall(self, key) -> bytes | None:
        ids = self.old.get(key)
        return ids if ids is None else self.keep(key, ids)


class WordEncoder(Memory):
    """Ids of a text as little-endian uint32 bytes, word by word; it is its own memory of words.

    The tokenizer drops white space and never looks across it, so the ids of a
    text are those of its words in turn.  A new word made of printable ASCII and
    Latin letters goes straight to the tokenizer's BPE model: its normal form is
    its lower case, and ``PIECES`` splits it.  Any other word, and any that may
    hold a special token, goes through the whole tokenizer.  ASCII capitals are lowered and
    signs at the ends of words parted from them at once for the whole text, so that the word is found in the memory.
    """

    #: Fixed values of the tokenizer file: its split pattern.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = r"[\x21-\x7EÀ-ÖØ-öø-įı-ſ]+"
    #: Signs behind an ASCII letter, up to the word's end: a piece of their own, whatever the word is.
    ENDS = rb"[!-/:-@\[-`{-~](?<=[A-Za-z].)[!-/:-@\[-`{-~]*+(?![^\t-\r ])"
    #: ASCII signs: at a word's end they are one piece.
    SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(self.PIECES).findall
        self.plain = re.compile(self.PLAIN).fullmatch
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.part_ends = re.compile(self.ENDS).sub
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.parts = Memory()

    def _part(self, piece: str) -> bytes:
        ids = self.parts.get(piece) or self.parts.recall(piece)
        if ids is None:
            spelled = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = self.parts.keep(piece, array.array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes())
        return ids

    def __missing__(self, word: bytes) -> bytes:
        known = self.recall(word)
        if known is not None:
            return known
        if word.isalpha():  # ASCII letters alone are one piece
            low = word.lower()
            if low != word:
                return self.keep(word, self[low])
            return self.keep(word, array.array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes())
        stem = word.rstrip(self.SIGNS)
        if stem.isalpha() and b"<|" not in word:
            return self[stem] + self._part(word[len(stem) :].decode())
        text = word.decode()
        if not self.plain(text) or "<|" in text:
            return self.keep(word, array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
        text = text.lower()
        if text.isalpha():
            return self.keep(word, self._part(text))
        return self.keep(word, b"".join([self._part(p) for p in self.pieces(text)]))

    def encode(self, text: bytes) -> bytes:
        if b"<|" not in text:
            text = self.part_ends(rb" \g<0>", text.lower())
        return b"".join([self[w] for w in text.split()])


#: The encoders of this worker process, by tokenizer path: tasks that follow each other share one.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _cutter(path: str, length: int, with_ids: bool):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for lo in range(0, batch.num_rows, 256):
                rows, piece, start, size, crc, ids = [], [], [], [], [], []
                for r, t in enumerate(texts.slice(lo, 256)):
                    data = enc.encode(t.as_py() or b"") + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(data), 4 * length)):
                        p = data[at : at + 4 * length]
                        rows.append(lo + r)
                        piece.append(k)
                        start.append(at // 4)
                        size.append(len(p) // 4)
                        crc.append(zlib.crc32(p))
                        if with_ids:
                            ids.append(p)
                cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``length`` token ids: doc_id, piece, start, length, ids_crc32[, ids].

    A document's ids are the tokenizer's without special tokens, then id 0, so a
    null or empty text has the one id 0.  ``ids`` holds little-endian uint32.  A
    null doc_id stays null; repeated rows give repeated pieces; an empty table gives none.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return source.mapInArrow(_cutter(path or tokenizer_path(), length, with_ids), schema)


def as_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")
