"""Texts cut where byte-level pre-tokenization always cuts, so that equal parts are encoded once.

The split pattern never matches across a space that follows a non-space: such a space starts the next match. So a text
is the sequence of its parts between those places, and a part's ids do not depend on its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: White space by any engine's reading: Unicode's and the four separators below space.
_OTHER_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0                　"
_ASCII_BEFORE = tuple(c + " " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_OTHER_BEFORE = tuple(c + " " for c in _OTHER_SPACE)
_CUT = re.compile(rf"(?<=[^\s{_OTHER_SPACE}])(?= )")
SPACES = frozenset(" \n\t\r\x0b\x0c" + _OTHER_SPACE)
#: Letters, then ASCII symbols: the split pattern has a match begin at the first symbol.
_TAIL = re.compile(r"([^\W\d_]+)([!-/:-@\[-^`{-~]+)")
#: Parts over this length are rarely repeated and are forgotten after use; of the others so many bytes are remembered as
#: new, and as many from before, in each Python worker; what is still used moves over when the new ones are full.
REMEMBERED_CHARS, REMEMBERED_BYTES = 40, 96 << 20
#: Bytes that a remembered part takes besides its characters: a string, its ids and a place in the table.
_PART_BYTES = 200
#: Characters of texts whose new parts are encoded together.
TOGETHER = 1 << 20

#: By vocabulary: what this worker process has encoded, for the tasks that it runs one after the other.
_KNOWN: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def cut(text: str) -> tuple[str, list[str]]:
    """(first part, later parts without the space that each begins with)."""
    if any(c in text for c in _ASCII_BEFORE) or not text.isascii() and any(c in text for c in _OTHER_BEFORE):
        head, *rest = _CUT.split(text)
        return head, [r[1:] for r in rest]
    head, *rest = text.split(" ")
    return head, rest


class Remembering:
    """ids of texts as little-endian unsigned 32-bit integers; encode(new parts) is asked for each part once.

    encode gets parts without the space before them and gives the ids of both; encode_first gets first parts.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], encode_first: Callable[[list[str]], list[bytes]], vocabulary: str):
        self.encode, self.encode_first, self.vocabulary = encode, encode_first, vocabulary
        self.known, self.before = _KNOWN.get(vocabulary, ({}, {}))

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= TOGETHER or i == len(texts) - 1:
                yield from self._together(texts[start : i + 1])
                start, size = i + 1, 0

    def _together(self, texts: list[str | None]) -> list[bytes]:
        heads, rests = zip(*[cut(t or "") for t in texts])
        if len(self.known) * (_PART_BYTES + REMEMBERED_CHARS) > REMEMBERED_BYTES:
            self.known, self.before = {}, self.known
            _KNOWN[self.vocabulary] = self.known, self.before
        known, new = self.known, set().union(*rests).difference(self.known)
        known.update((p, self.before[p]) for p in new & self.before.keys())
        new = list(new.difference(known))
        stems = {p: m.groups() for p in new if (m := _TAIL.fullmatch(p))}  # ends of sentences and such: the stem is often known
        needed = {s for s, _ in stems.values()} | (set(new) - stems.keys())
        known.update((p, self.before[p]) for p in needed & self.before.keys())
        whole = list(needed - known.keys())
        known.update(zip(whole, self.encode(whole)))
        tails = list({t for _, t in stems.values()})
        tail = dict(zip(tails, self.encode_first(tails)))
        known.update((p, known[s] + tail[t]) for p, (s, t) in stems.items())
        first = list(set(heads) - {""})
        head = {"": b""} | dict(zip(first, self.encode_first(first)))
        at = known.__getitem__
        out = [head[h] + b"".join(map(at, rest)) for h, rest in zip(heads, rests)]
        for p in (*new, *whole):
            if len(p) > REMEMBERED_CHARS:
                known.pop(p, None)
        return out
