"""Token-ID / binary output: patched frame-of-reference shards, written in ascending doc_id order and read back.

A shard (little-endian) holds whole documents:
  header   8s magic "SLPFOR01", u32 n_docs, u32 n_ids, u32 n_blocks, u32 block length, u64 ids before it in its part
  docs     n_docs + 1 times u32: first id of each document in the shard
  blocks   n_blocks + 1 times u32 byte start in body and exception start (the index), then minimum u32 and width u8
  body     each block's id - minimum, packed at the block's width (that of its `percentile`)
  outliers u8 position and u32 full difference of those ids that do not fit the width
Blocks are independent, so a reader seeks to block i // BLOCK by the index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

MAGIC, BLOCK, HEAD = b"SLPFOR01", 256, struct.Struct("<8s4IQ")


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as BLOCK * width / 64 words each."""
    out = np.zeros((len(v), BLOCK // 64, max(width, 1)), np.uint64)
    lanes = v.reshape(len(v), BLOCK // 64, 64).astype(np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= lanes[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - shift)
    return out[:, :, :width].reshape(len(v), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    n = len(packed)
    out = np.zeros((n, BLOCK // 64, 64), np.uint64)
    words, mask = packed.reshape(n, BLOCK // 64, width), np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        x = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = x & mask
    return out.reshape(n, BLOCK)


def encode_shard(ids: np.ndarray, doc_starts: np.ndarray, before: int = 0, percentile: int = 90) -> bytes:
    """doc_starts: the first id of each document and, last, len(ids)."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    bound = np.partition(diff, at, axis=1)[:, at] if blocks else low
    width = np.ceil(np.log2(bound.astype(np.float64) + 1)).astype(np.uint8)
    fits = diff < (np.uint64(1) << width.astype(np.uint64))[:, None]
    out_block, out_at = np.nonzero(~fits)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate(([0], np.cumsum(size)))
    body = np.zeros(int(start[-1]) // 8, np.uint64)
    low_bits = diff & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        body[(start[of] // 8)[:, None] + np.arange(int(w) * (BLOCK // 64))] = _pack(low_bits[of], int(w))
    outliers = np.concatenate(([0], np.cumsum(np.bincount(out_block, minlength=blocks)))) if blocks else np.zeros(1, np.int64)
    return b"".join((
        HEAD.pack(MAGIC, len(doc_starts) - 1, n, blocks, BLOCK, before), np.asarray(doc_starts, "<u4").tobytes(),
        start.astype("<u4").tobytes(), outliers.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(),
        body.astype("<u8").tobytes(), out_at.astype(np.uint8).tobytes(), diff[out_block, out_at].astype("<u4").tobytes(),
    ))


def decode_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, first ids of documents (and the end), ids before the shard in its part."""
    magic, docs, n, blocks, length, before = HEAD.unpack_from(payload)
    if magic != MAGIC or length != BLOCK:
        raise ValueError("not a token shard")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    doc_starts, start, outliers = take("<u4", docs + 1), take("<u4", blocks + 1).astype(np.int64), take("<u4", blocks + 1).astype(np.int64)
    low, width = take("<u4", blocks), take("u1", blocks)
    body = take("<u8", int(start[-1]) // 8 if blocks else 0)
    out_at, out_diff = take("u1", int(outliers[-1])), take("<u4", int(outliers[-1]))
    diff = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        diff[of] = _unpack(body[(start[of] // 8)[:, None] + np.arange(int(w) * (BLOCK // 64))], int(w))
    diff[np.repeat(np.arange(blocks), np.diff(outliers)), out_at] = out_diff
    return (diff + low[:, None]).astype(np.uint32).reshape(-1)[:n], doc_starts, before


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = 1 << 20) -> DataFrame:
    """Tokenise docs (doc_id, text) and store them in ascending doc_id order; returns the stored table, read anew.

    The table has (part, shard, n_docs, n_ids, doc_ids, payload): a row is one shard file of about `shard_ids` ids,
    more only for a longer document. Spark's own writer commits them, so any store that Spark reaches will do and a
    lost executor leaves no half-written shard. Null text is empty; null doc_ids come first; equal doc_ids are ordered
    by a hash of the text; other columns are ignored; an empty table gives an empty one.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc, part, end = encoder(tokenizer), TaskContext.get().partitionId(), np.array([end_id], np.uint32).tobytes()
        docs_in, pieces, ends, n, before, shard = [], [], [0], 0, 0, 0

        def row() -> pa.RecordBatch:
            payload = encode_shard(np.frombuffer(b"".join(pieces), np.uint32), np.array(ends), before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(docs_in)], pa.int64()), pa.array([n], pa.int64()), pa.array([docs_in], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["part", "shard", "n_docs", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                docs_in.append(doc)
                pieces.append(ids)
                n += len(ids) // 4
                ends.append(n)
                if n >= shard_ids:
                    yield row()
                    docs_in, pieces, ends, before, n, shard = [], [], [0], before + n, 0, shard + 1
        if docs_in:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return stage(ordered.mapInArrow(shards, "part int, shard int, n_docs long, n_ids long, doc_ids array<long>, payload binary"), "tokens")


def read_tokens(stored: DataFrame) -> DataFrame:
    """Documents of a stored table: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    What comes before each part is summed from one number a part; parts are as many as the writer's tasks.
    """
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, payload, base in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids, starts, before = decode_shard(payload.as_py())
                raw, at = ids.astype("<u4").tobytes(), starts.astype(np.int64)
                crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(at[:-1] + (base + before)), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.join(F.broadcast(base), "part").select("doc_ids", "payload", "base").mapInArrow(documents, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]))
