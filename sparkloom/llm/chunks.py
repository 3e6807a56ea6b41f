"""Words of whole texts in chunks of bounded size that share a few words with the next one."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Keeps a-z, 0-9 and every byte above ASCII, lower-cases A-Z; all other bytes become spaces.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 0x20 for c in range(256))

_NEXT = re.compile(rb" *[^ ]+")


def plain(text: str | None) -> bytes:
    """The words of a text at their own places, with spaces for all else; the length in bytes stays."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES) if text else b""


def cut(data: bytes, size: int, carry: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, carried) of each chunk of ``data``; at least one, whatever the data.

    A chunk owns the words that begin in its first ``size`` bytes or a little more: it ends at
    a space, so that a word longer than ``size`` stays whole.  It goes on over the next
    ``carry`` words, which the next chunk owns (fewer at the end of the data).
    """
    at, end = 0, len(data)
    while True:
        own = data.find(b" ", at + size) if at + size < end else -1
        if own < 0:
            yield at, end, 0
            return
        stop = own
        carried = 0
        while carried < carry and (m := _NEXT.match(data, stop)):
            stop, carried = m.end(), carried + 1
        yield at, stop, carried
        at = own
