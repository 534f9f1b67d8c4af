"""Byte-level BPE over length-bucketed, padded numpy matrices.

The matches of the split pattern are rows of a matrix, padded to the longest of their length bucket; a match longer than
the last bucket is several rows, which are its blocks in order. Each round every match merges its leftmost pair of
minimum rank, which may lie across two blocks; pairs are looked up in an open-addressing hash table, and matches without
a pair left leave the matrix, which is compacted. A round touches one block of a match, so a match of any length stays
in the matrix at a cost of one round a merge.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .segments import Remembering

#: Upper ends of the length buckets, in bytes; the last one is the length of a block.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Matrix cells that are merged together; a single longer match is merged alone.
CELLS = 1 << 21
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class PairTable:
    """(left id, right id) to merged id, in arrays with linear probing."""

    def __init__(self, ranks: Mapping[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(x, np.uint64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.uint64),) * 3
        key = left << np.uint64(32) | right
        bits = max(4, int(np.ceil(np.log2(max(1, len(key)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.probes = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, _NONE, np.int32), 1
        todo, slot = np.arange(len(key)), ((key * _MIX) >> self.shift).astype(np.int64)
        while len(todo):
            free = self.keys[slot[todo]] == 2**64 - 1
            want, first = np.unique(slot[todo][free], return_index=True)
            placed = todo[free][first]
            self.keys[want], self.values[want] = key[placed], merged[placed].astype(np.int32)
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += len(todo) > 0

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, _NONE where there is no such pair or an id is padding (negative)."""
        out = np.full(left.shape, _NONE, np.int32)
        at = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        key = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        slot = ((key * _MIX) >> self.shift).astype(np.int64)
        flat = out.ravel()
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 2**64 - 1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & self.mask
            if not len(at):
                break
        return out


def class_stand_ins() -> dict[int, str]:
    """For characters that `regex` and the contract's library class differently: a stand-in of the library's class.

    The two know different versions of Unicode; the library's own reading of each class is asked for.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    byte, out = {bytes([i]): i for i in range(256)}, {}
    for kind, stand_in in ((r"[^\s\p{L}\p{N}]", "\xa7"), (r"\p{L}", "\xe9"), (r"\p{N}", "1")):
        library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=byte, special_tokens={})
        theirs = set(bytes(library.encode_ordinary(every)).decode())
        out.update((ord(c), stand_in) for c in theirs.difference(regex.findall(kind, every)))
    return out


class Encoder:
    """Ids of texts by ranks of byte strings; needs all 256 single bytes among them."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str, table: PairTable | None = None, stand_ins: Mapping[int, str] | None = None):
        self.ranks, self.table = ranks, table or PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # white space as Unicode's property, which the contract's library takes \s for
        self.pattern = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.stand_ins = class_stand_ins() if stand_ins is None else stand_ins
        self.tokens = dict(zip(ranks.values(), ranks))
        self.name = zlib.crc32(repr((pattern, sorted(self.tokens.items()))).encode())

    def split(self, part: str) -> list[str]:
        if part.isascii() or (plain := part.translate(self.stand_ins)) == part:
            return self.pattern.findall(part)
        return [part[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        matches = [[m.encode() for m in self.split(p)] for p in parts]
        ids = self.encode_matches(list({m for own in matches for m in own}))
        return [b"".join(map(ids.__getitem__, own)) for own in matches]

    def encode_later(self, parts: list[str]) -> list[bytes]:
        """Parts that stand behind a space."""
        return self.encode_parts([" " + p for p in parts])

    def encode_matches(self, matches: list[bytes]) -> dict[bytes, bytes]:
        out, buckets = {}, {}
        for m in matches:
            whole = self.ranks.get(m)
            if whole is not None:
                out[m] = whole.to_bytes(4, "little")
            else:
                width = next((b for b in BUCKETS if len(m) <= b), BUCKETS[-1])
                blocks = -(-len(m) // width)
                buckets.setdefault((width, 1 << (blocks - 1).bit_length()), []).append(m)
        for (width, blocks), rows in buckets.items():
            for at in range(0, len(rows), step := max(1, CELLS // (width * blocks))):
                out.update(zip(rows[at : at + step], self._merged(rows[at : at + step], width)))
        return out

    def _merged(self, matches: list[bytes], width: int) -> list[bytes]:
        """Ids of matches, each in as many blocks (rows) of `width` tokens as it needs."""
        blocks = np.array([-(-len(m) // width) for m in matches])
        first = np.r_[0, np.cumsum(blocks)[:-1]]
        rows, n_rows = np.arange(blocks.sum()), int(blocks.sum())
        length = np.fromiter(map(len, matches), np.int64, len(matches))
        size = np.full(n_rows, width)
        size[first + blocks - 1] = length - (blocks - 1) * width
        flat = self.byte[np.frombuffer(b"".join(m.ljust(k * width, b"\0") for m, k in zip(matches, blocks.tolist())), np.uint8)].reshape(n_rows, width)
        ids = np.where(np.arange(width) < size[:, None], flat, np.int32(-1))
        after, before = rows + 1, rows - 1
        after[first + blocks - 1] = before[first] = -1
        pair = np.full((n_rows, width), _NONE, np.int32)
        pair[:, :-1] = self.table.look_up(ids[:, :-1], ids[:, 1:])
        on = np.flatnonzero(after >= 0)
        pair[on, size[on] - 1] = self.table.look_up(ids[on, size[on] - 1], ids[after[on], 0])
        at = pair.argmin(axis=1)  # of each row; the first of equal ranks is the leftmost
        key = self._keys(pair, at, rows)
        match, done, written = np.arange(len(matches)), [b""] * len(matches), np.zeros(len(matches), bool)
        while True:
            low = np.minimum.reduceat(key, first)  # of each match: least rank, then first row
            live = low >> 32 != _NONE
            for k in np.flatnonzero(~live & ~written):
                own = slice(first[k], first[k] + blocks[k])
                done[match[k]] = ids[own][np.arange(ids.shape[1]) < size[own, None]].astype("<u4").tobytes()
            if not live.any():
                return done
            written = ~live
            if live.mean() < 0.7:  # compaction: rows of matches that are done go
                kept = np.repeat(live, blocks)
                place = np.cumsum(kept) - 1
                ids, pair, at, size = ids[kept], pair[kept], at[kept], size[kept]
                after, before = (np.where(x[kept] >= 0, place[x[kept]], -1) for x in (after, before))
                low = place[low[live] & 0xFFFFFFFF] | low[live] >> 32 << 32
                key = self._keys(pair, at, np.arange(len(ids)))
                match, blocks, written = match[live], blocks[live], written[live]
                first = np.r_[0, np.cumsum(blocks)[:-1]]
            else:
                low = low[live]
            if (used := int(size.max())) < ids.shape[1]:  # columns that are padding everywhere
                ids, pair = ids[:, :used], pair[:, :used]
            row, rank = low & 0xFFFFFFFF, (low >> 32).astype(np.int32)
            p = at[row]
            ids[row, p] = rank
            last = p + 1 == size[row]
            self._drop(ids, pair, size, row[~last], p[~last] + 1)
            touched = [row]
            if last.any():
                here, there = row[last], after[row[last]]
                self._drop(ids, pair, size, there, np.zeros(len(there), np.int64))
                empty = size[there] == 0
                here, gone = here[empty], there[empty]
                after[here] = after[gone]
                follow = after[here] >= 0
                before[after[here[follow]]] = here[follow]
                touched.append(there)
            inner, beyond = p + 1 < size[row], after[row]
            follower = np.where(inner, ids[row, np.minimum(p + 1, ids.shape[1] - 1)], np.where(beyond >= 0, ids[beyond, 0], -1))
            pair[row, p] = self.table.look_up(rank, follower)
            back = np.where(p > 0, row, before[row])
            has, spot = back >= 0, np.where(p > 0, p - 1, size[back] - 1)
            back, spot = back[has], spot[has]
            pair[back, spot] = self.table.look_up(ids[back, spot], rank[has])
            touched.append(back[p[has] == 0])
            for own in touched:
                if len(own):
                    at[own] = pair[own].argmin(axis=1)
                    key[own] = self._keys(pair, at, own)

    @staticmethod
    def _keys(pair: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Least rank of each row above the row's number: the least key of a match is its leftmost row of least rank."""
        return pair[rows, at[rows]].astype(np.int64) << 32 | rows

    @staticmethod
    def _drop(ids: np.ndarray, pair: np.ndarray, size: np.ndarray, row: np.ndarray, p: np.ndarray) -> None:
        """Takes the token at p out of each row."""
        if len(row):
            keep = np.arange(ids.shape[1] - 1) < p[:, None]
            for cells, filler in ((ids, -1), (pair, _NONE)):
                own = cells[row]
                own[:, :-1] = np.where(keep, own[:, :-1], own[:, 1:])
                own[:, -1] = filler
                cells[row] = own
            size[row] -= 1

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, text: str = "text", decode: bool = False) -> DataFrame:
    """docs (all columns) with n_tokens and ids (binary: little-endian unsigned 32-bit); with decode also decoded.

    decoded is the bytes that the ids stand for. Null text counts as empty: no ids, no bytes. Special tokens' strings
    are ordinary text. Whole texts are encoded; the vocabulary is broadcast, its size is that of its file.
    """
    shared = docs.sparkSession.sparkContext.broadcast((dict(ranks), PairTable(ranks), pattern, class_stand_ins()))

    def make():
        own, table, split, stand_ins = shared.value
        encoder = Encoder(own, split, table, stand_ins)
        remembering = Remembering(encoder.encode_later, encoder.encode_parts, f"ranks {encoder.name}")

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = list(remembering.ids(texts.to_pylist()))
            out = [pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())]
            return [*out, pa.array([encoder.decode(b) for b in ids], pa.binary())] if decode else out

        return work

    return common.with_arrow_columns(docs, [text], "n_tokens long, ids binary" + ", decoded binary" * decode, make)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts and digests of all documents; a null text is empty, repeated rows repeat."""
    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, ranks, public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_matrix_bpe": query}
