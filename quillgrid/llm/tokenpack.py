"""Token-id output: documents packed best-fit-decreasing into matrices of sequences.

A document's ids end with the end id. Longer documents than a sequence are cut losslessly into full pieces and a rest.
Pieces are placed longest first, each into the fullest sequence that still has room; a segment tree over the free
capacities finds it. Documents are dealt to shards by their ids; a task packs a shard, in blocks of a bounded number of tokens, so
that the sequences don't hang on files or cores and a lost task is made again alike. Rows of a matrix are filled up with the end id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, materialize
from quillgrid.llm.encoding import byte_tokens, clean, tokenizer_path

LENGTH = 2048
END = 50256
SHARD = 4096  # expected documents of a shard
BLOCK_TOKENS = 8_000_000  # held by a task at once

OUT = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>, position_resets array<int>"
_OUT = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("position_resets", pa.list_(pa.int32()))])
ROWS_AT_ONCE = 512  # of a matrix, handed to the JVM


class Capacities:
    """Bins by free capacity under a segment tree of counts: the smallest free capacity of at least x in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, free: int, bin_: int) -> None:
        self.bins.setdefault(free, []).append(bin_)
        at = free + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(free, bin) of the fullest bin with room for ``least``, taken out; None if there is none."""
        at = least + self.size
        while not self.tree[at]:
            while at & 1:  # a right child: up, until there is a right neighbour
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        free = at - self.size
        while at:
            self.tree[at] -= 1
            at >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in ``lengths``; equal lengths in their order."""
    open_, bins = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_.take(lengths[i])
        if found is None:
            free, k = capacity, len(bins)
            bins.append([])
        else:
            free, k = found
        bins[k].append(i)
        if free > lengths[i]:
            open_.add(free - lengths[i], k)
    return bins


def _rows(held: list[tuple[int | None, int, np.ndarray]], first: int, length: int) -> Iterator[pa.RecordBatch]:
    bins = best_fit_decreasing([len(ids) for _, _, ids in held], length)
    for at in range(0, len(bins), ROWS_AT_ONCE):
        rows = []
        for n, own in enumerate(bins[at : at + ROWS_AT_ONCE], first + at):
            pieces = [held[i] for i in own]
            ends = np.cumsum([0] + [len(ids) for _, _, ids in pieces]).tolist()
            matrix = np.full(length, END, dtype="<u2")
            matrix[: ends[-1]] = np.concatenate([ids for _, _, ids in pieces])
            rows.append({"sequence_id": n, "n_tokens": ends[-1], "ids": matrix.tobytes(), "cu_seqlens": ends, "doc_ids": [d for d, _, _ in pieces], "doc_starts": [s for _, s, _ in pieces], "position_resets": ends[:-1]})
        yield pa.RecordBatch.from_pylist(rows, _OUT)


def _pack(batches: Iterator[pa.RecordBatch], path: str, length: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    tokens, end = byte_tokens(path), np.array([END], dtype="<u2")
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 40
    held, size = [], 0
    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode_all(map(clean, batch.column("text").to_pylist())), strict=True):
            ids = np.concatenate([ids, end])
            held += [(doc_id, start, ids[start : start + length]) for start in range(0, len(ids), length)]
            size += len(ids)
            if size >= block_tokens:
                yield from _rows(held, number, length)
                number, held, size = number + len(held), [], 0  # no block has more rows than pieces
    if held:
        yield from _rows(held, number, length)


def pack_token_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.tiktoken", length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row a sequence: ids (``length`` little-endian uint16), n_tokens without filling, cu_seqlens (0, then the end of each
    segment), doc_ids and doc_starts (of each segment: its document and its place there), position_resets (where positions
    begin at 0 again).

    Null text is empty and gives the end id alone. A null doc_id stays null; repeated rows are packed each by itself; an
    empty table gives no rows. Other columns are not read. Documents are dealt to shards by their ids (those without one by their
    texts) and packed in the order of ids and texts; the number of shards hangs on the number of documents alone, so the same
    table gives the same sequences whatever its files, their order and the cores."""
    read = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = max(1, -(-read.count() // SHARD))
    order = [F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.col("doc_id"), F.xxhash64("text"), F.length("text")]
    dealt = read.repartition(shards, order[0]).sortWithinPartitions(*order)
    return dealt.mapInArrow(partial(_pack, path=tokenizer_path(tokenizer), length=length, block_tokens=block_tokens), OUT)


def write_matrices(packed: DataFrame, path: str | None = None) -> DataFrame:
    """Packed rows as Parquet, read back: column ``ids`` in order is the id matrix, the other columns its segment index.

    Without a path they go to the shared folder."""
    if path is None:
        return materialize(packed, "matrices")
    packed.write.parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids): the segments out of packed rows, which put in order are the documents again."""
    segments = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_starts")).alias("k", "s"))
    begin, end = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    return segments.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_starts").alias("start"), F.expr("substring(ids, 2 * cu_seqlens[k] + 1, 2 * (cu_seqlens[k + 1] - cu_seqlens[k]))").alias("ids"), (end - begin).alias("length"))


@F.pandas_udf(T.LongType())
def crc32(ids: pd.Series) -> pd.Series:
    return pd.Series([zlib.crc32(x) for x in ids], dtype="int64")
