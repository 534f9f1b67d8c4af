"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The trie of all pieces gets, at each node, a failure link and the number of pieces that are complete when the link is
taken. A walk over a word then counts the pieces of greedy longest match in one pass, without building any piece: each
byte either goes down the trie or follows failure links that add their counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Words over this many bytes are not remembered; the others up to this many a task.
REMEMBERED_BYTES, REMEMBERED = 48, 300_000


class Automaton:
    """count(word): pieces of greedy longest match; 0 where some part of the word has no piece (an unknown word).

    vocabulary: pieces as bytes. The first piece of a word is looked up as it is, later ones behind `inner` (a prefix
    such as b"##"; empty: one set of pieces for all places).
    """

    def __init__(self, vocabulary: Iterable[bytes], inner: bytes = b"##"):
        step: dict[int, int] = {}  # node * 256 + byte -> node
        self.root = 1 if inner else 0  # where later pieces start; first pieces start at 0
        ends = [False] * (self.root + 1)
        for piece in vocabulary:
            later = inner and piece.startswith(inner)
            node, rest = (self.root, piece[len(inner) :]) if later else (0, piece)
            for byte in rest:
                key = node << 8 | byte
                if key not in step:
                    step[key] = len(ends)
                    ends.append(False)
                node = step[key]
            ends[node] = bool(rest) and node > self.root
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in step.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        fail, pops = [-1] * len(ends), [0] * len(ends)
        level = sorted({0, self.root})
        while level:  # breadth first: links lead to shorter strings
            following = []
            for u in level:
                for byte, v in children.get(u, ()):
                    following.append(v)
                    if ends[v]:
                        fail[v], pops[v] = self.root, 1
                        continue
                    z, n = fail[u], pops[u]
                    while z >= 0 and (z << 8 | byte) not in step:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = step[z << 8 | byte], n
            level = following
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        step, fail, pops = self.step, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (down := step.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 0
                total += pops[node]
                node = fail[node]
            node = down
        while node != self.root:  # what is left after the last byte
            if fail[node] < 0:
                return 0
            total += pops[node]
            node = fail[node]
        return total


def byte_of_character() -> dict[str, int]:
    """Bytes by the printable characters that byte-level vocabularies write for them."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_pieces(path: str) -> list[bytes]:
    """The vocabulary of a byte-level tokenizer file as pieces: bytes, with the space before a word's first piece."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    byte = byte_of_character()
    return [bytes(map(byte.__getitem__, token)) for token in vocabulary if all(c in byte for c in token)]


def count_pieces(docs: DataFrame, pieces: Iterable[bytes], inner: bytes = b"", before: bytes = b" ", text: str = "text") -> DataFrame:
    """docs (all columns) with n_words, n_pieces and n_unknown.

    Words are runs of non-space (ASCII white space divides), each with `before` put in front; n_pieces adds one for a
    word that the vocabulary cannot spell, n_unknown counts those. Null text has no words. Whole texts are counted; a
    very long word takes time in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces, inner))

    def make():
        automaton, known = shared.value, {}

        def count(word: bytes) -> int:
            n = automaton.count(before + word)
            if len(word) <= REMEMBERED_BYTES:
                known[word] = n
            return n

        def work(texts: pa.Array) -> list[pa.Array]:
            out = []
            for t in texts:
                if len(known) > REMEMBERED:
                    known.clear()
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                counts = [known[w] if w in known else count(w) for w in words]
                unknown = counts.count(0)
                out.append((len(words), sum(counts) + unknown, unknown))
            return [pa.array(c, pa.int64()) for c in (np.array(out, np.int64).reshape(-1, 3).T)]

        return work

    return common.with_arrow_columns(docs, [text], "n_words long, n_pieces long, n_unknown long", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, pieces and unknown words of every document; null texts count as empty, repeated rows repeat."""
    pieces = byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    return count_pieces(common.table(spark, sf_dir, "documents").select("doc_id", "text"), pieces).select("doc_id", "n_words", "n_pieces", "n_unknown")


QUERIES = {"op2_longest_match_counts": query}
