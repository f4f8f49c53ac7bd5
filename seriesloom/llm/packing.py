"""Best-fit packing by sum of squares: each piece goes where the squared counts of open bins per gap become smallest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document of (doc_id, text): its ids and end_id, cut only beyond capacity.

    Null text is empty (one piece of one id); repeated rows and null doc_ids give rows of their own; other columns are
    ignored. No shuffle.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc, end, size = encoder(tokenizer), np.array([end_id], np.uint32).tobytes(), capacity * 4
        for batch in batches:
            out = []
            for doc, text, salt in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = memoryview(enc.encode(text.as_py()) + end)
                out += [(doc, at // size, at // 4, len(x) // 4, zlib.crc32(x), salt + at) for at in range(0, len(ids), size) for x in (ids[at : at + size],)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    # salt tells repeated rows apart and deals pieces out evenly, whatever their keys
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("salt")).mapInArrow(pieces, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given.

    Placing s in a bin of gap g changes the sum over gaps of squared bin counts by 2 (n[g-s] - n[g] + 1); full bins are
    not counted and a new bin has gap `capacity`, of which there are always some uncounted ones. Ties go to the smaller
    gap, so that bins fill up.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        change = 2 * (n[: capacity - s + 1] - n[s:] + 1)  # by g - s
        change[0] = 1 - 2 * n[s]  # a bin that becomes full leaves the sum
        change = np.where(n[s:] > 0, change, 1 << 40)
        change[capacity - s] = 2 * n[capacity - s] + 1 if s < capacity else 0
        gap = int(change.argmin()) + s
        if gap == capacity:
            b, used = used, used + 1
        else:
            b = open_bins[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            n[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, group: int = 8192, loose: float = 0.99) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, salt).

    Pieces are dealt by a hash of their salt to groups of about `group`, each packed alone, longest first. The bins that
    a group leaves less than `loose` full are opened again and their pieces packed with those of other groups, in as
    many groups as there are such pieces, so what a group wastes at its end does not add up. Both times a group has about
    `group` pieces, which bounds its memory.
    """
    pieces = stage(pieces, "pieces")
    n = pieces.count()
    groups = max(1, round(n / group))

    def place(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable")
            bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
            fill = np.bincount(bins, weights=pdf["length"].to_numpy())
            return pdf.assign(sequence_id=(pdf["bucket"].to_numpy().astype(np.int64) * 2 + level) * (1 << 20) + bins, offset=offsets, fill=fill[bins].astype(np.int64))

        return run

    def packed(df: DataFrame, count: int, level: int) -> DataFrame:
        dealt = df.withColumn("bucket", F.pmod(F.xxhash64("salt", F.lit(level)), F.lit(count)))
        return dealt.groupBy("bucket").applyInPandas(place(level), PIECES + ", bucket long, sequence_id long, offset long, fill long")

    first = stage(packed(pieces, groups, 0), "packed")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if groups == 1:
        return first.select(*kept)
    full = F.col("fill") >= int(loose * capacity)
    rest = first.where(~full).select("doc_id", "piece", "start", "length", "ids_crc32", "salt")
    again = packed(rest, max(1, -(-rest.count() // group)), 1)
    return first.where(full).select(*kept).unionByName(again.select(*kept))
