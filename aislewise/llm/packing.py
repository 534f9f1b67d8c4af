"""Sum-of-squares online packing of tokenized documents into fixed windows."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordpiece import byte_of_character

WINDOW = 2048
END_ID = 1


class Packer:
    """Windows filled online: each remainder goes to the fill level that minimises the sum of squared level counts.

    count[f] is the number of open windows with f tokens, windows[f] their numbers. A document is cut at whole windows
    only. A piece's window and offset are final when it is placed, so an open window is one number here, however many
    are open; windows that never fill up are padded.
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.made = window, 0
        self.count = np.zeros(window + 1, np.int64)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, total: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window number, offset) of each piece of a document of total tokens."""
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            yield start, self.window, self._new(), 0
        if total > whole:
            size = total - whole
            level = self._level(size)
            number = self.windows[level].pop() if level else self._new()
            self.count[level] -= level > 0
            if level + size < self.window:
                self.windows[level + size].append(number)
                self.count[level + size] += 1
            yield whole, size, number, level

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _level(self, size: int) -> int:
        """The fill level to use, 0 for a new window; of equal changes the fullest level."""
        n = self.window
        have, then = self.count[1 : n - size + 1], 2 * self.count[size + 1 : n + 1] + 1
        then[-1:] = 0  # a full window is no level
        change = np.where(have > 0, then - 2 * have + 1, np.iinfo(np.int64).max)[::-1]
        best = int(change.argmin()) if len(change) else 0
        return n - size - best if len(change) and change[best] <= 2 * self.count[size] + 1 else 0


def tokenizer_encoder(definition: str):
    """encode(texts): ids of the tokenizers library as little-endian unsigned 32-bit integers; definition: a byte-level BPE JSON file.

    Texts go whole to tiktoken over the file's own vocabulary and pattern, which merges the same pairs in the same order
    three times faster; texts that hold an added token's string go to tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    byte = byte_of_character()
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if t not in added}
    fast = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[bytes]:
        out = [b"" if any(a in t for a in added) else fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes() for t in texts]
        rest = [i for i, t in enumerate(texts) if t and not out[i]]
        for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    return encode


def pack_documents(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (with_ids: also ids).

    path: a tokenizer's JSON file of byte-level kind, read on the driver and broadcast. Null and empty texts are the
    end id alone. Each task packs its own rows as they come, without a shuffle; sequence_id holds the task's partition
    in its high bits, so a repeated task gives the same rows. Windows that a task leaves partly filled are the padding:
    a few hundred a task at most for documents of mixed sizes, so its share falls with the rows of a task. Repeated
    rows and ids are documents of their own. An empty table gives an empty table; other columns are not read.
    """
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(window), TaskContext.get().partitionId() << 40
        encode = tokenizer_encoder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, common.ROWS_AT_ONCE):
                part = batch.slice(i, common.ROWS_AT_ONCE)
                row, out = [], []
                for k, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for start, size, number, offset in packer.add(len(ids) // 4):
                        own = ids[4 * start : 4 * (start + size)]
                        row.append(k)
                        out.append((start, size, zlib.crc32(own), len(ids) // 4, base + number, offset, own))
                columns = list(zip(*out))
                arrays = [part.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in columns[:6]]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[6], pa.binary())] * with_ids, names=names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; null and empty texts are one token, repeated rows are packed one by one."""
    return pack_documents(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_sum_of_squares_packing": query}
