"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the whole corpus. Its index cuts it into blocks by content: of the k-grams in each window of `window`
words the one of smallest hash is the window's anchor, and a block holds all places with one anchor. Equal windows have
equal anchors, so a document needs to be matched with no block but those of its own anchors. A run of windows with one
anchor is a segment.

Each document is then parsed greedily from left to right: a factor goes on as long as every window of it lies in the
reference elsewhere. Where all segments of a block are equal it takes the whole segment at a step. Where they differ, a
factor may end inside the segment, and there each window is looked up on its own, which gives the exact boundary.
Factors of `window` words or more are the duplicate spans; shorter ones cannot arise. What a classical parse would
copy from one place may come from several, as only the length of factors decides here, not their source.

Words are compared by two independent 64-bit hashes: windows by both, segments of a block by one, since the other half is
the anchor. For n windows a wrong match has a chance of about n * n / 2**129.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, row_keys, split_join, text_slices
from .words import Spans, Words, gram_starts, mix, words

_PLACE = np.uint64((1 << 30) - 1)
#: A segment is one number: first window << _SHIFT | number of windows.
_SHIFT = 20


def segments(w: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each segment: first window, number of windows, text, anchor hash and content hash."""
    spans, n = Spans(w.hash), len(w.hash)
    grams = np.full(n, np.uint64(2**64 - 1))
    at, _ = gram_starts(w.ptr, k)
    grams[at] = spans.of(at, k)
    first, text = gram_starts(w.ptr, window)
    if not len(first):
        return first, first, text, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # the smallest gram of each window, the leftmost of equal ones: hash above, place below
    low = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width, size = window - k + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    anchor = (low[first] & _PLACE).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.concatenate((start, [len(first)])))
    begin, anchor = first[start], anchor[start]
    # of the second lane, so that it is independent of the anchor
    content = mix(Spans(w.second, 1).of(begin, window - 1 + count) + (anchor - begin).astype(np.uint64) * np.uint64(0x9E3779B1) + (count.astype(np.uint64) << np.uint64(40)))
    return begin, count, text[start], grams[anchor], content


def parse(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of the greedy factors, from runs of matched windows in any order.

    A factor begins at the leftmost matched window that no factor covers and goes on as long as the next is matched.
    """
    order = np.argsort(start, kind="stable")
    start, end = start[order], start[order] + count[order]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.concatenate((np.flatnonzero(new)[1:], [len(start)])) - 1] - start[new]


def _factors(w: Words, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Factors of all texts of a slice, starts counted in the slice, from each text's packed runs."""
    n = np.array([len(x) for x in lists], np.int64)
    at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    # texts keep apart, as a window lies in one text: the last windows of a text have no starts
    return parse((at >> _SHIFT) + w.ptr[np.repeat(np.arange(len(n)), n)], at & ((1 << _SHIFT) - 1))


def matched_runs(rows: DataFrame, window: int = 35, k: int = 12) -> DataFrame:
    """(KEYS, runs): for rows (text, KEYS, others) with any, all runs of windows that occur again somewhere, packed.

    Shuffled are one row for each segment (about one in 12 words), the rows once by their keys, with all columns so that
    the caller's join by them reuses that shuffle, and one row for each window of blocks that hold different segments. Counts and sets are partial before each shuffle and hot keys are joined, so one
    passage in every document splits well; a row's runs are at most its windows, however often they or it occur.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            w = words(batch.column(2))
            begin, count, text, anchor, content = segments(w, window, k)
            at, of = ((begin - w.ptr[text]) << _SHIFT) | count, pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(at)], names=["anchor", "content", *KEYS, "at"])

    places = rows.select(*KEYS, "text").mapInArrow(anchors, "anchor long, content long, __k1 long, __k2 long, at long")
    blocks = places.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1")
    matched = split_join(places, blocks.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchor")
    whole = matched.where("not mixed").select(*KEYS, "at")
    ends = matched.where("mixed").groupBy(*KEYS).agg(F.collect_set("at").alias("ends"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            w, lists = words(batch.column("text")), batch.column("ends")
            n = np.array([len(x) for x in lists], np.int64)
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text, start, count = np.repeat(np.arange(len(n)), n), at >> _SHIFT, at & ((1 << _SHIFT) - 1)
            first = np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            text = np.repeat(text, count)
            here, of = first + w.ptr[text], pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(Spans(w.hash).of(here, window).view(np.int64)), pa.array(Spans(w.second, 1).of(here, window).view(np.int64)), *[batch.column(k).take(of) for k in KEYS], pa.array((first << _SHIFT) | 1)], names=["h1", "h2", *KEYS, "at"])

    single = split_join(rows, ends, *KEYS).mapInArrow(windows, "h1 long, h2 long, __k1 long, __k2 long, at long")
    again = single.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    found = split_join(single, again, "h1", "h2").select(*KEYS, "at")
    return whole.unionByName(found).groupBy(*KEYS).agg(F.collect_set("at").alias("runs"))


def factors(docs: DataFrame, window: int = 35, k: int = 12) -> DataFrame:
    """doc_id, start and length in words of each factor of each row that is long enough to be a duplicate span.

    Factors of one document may overlap by less than a window. Repeated rows have factors each.
    """
    rows = docs.select("doc_id", "text", *row_keys())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            w = words(batch.column("text"))
            start, count = _factors(w, batch.column("runs"))
            text = np.searchsorted(w.ptr, start, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(start - w.ptr[text]), pa.array(count + window - 1)], names=["doc_id", "start", "length"])

    return split_join(rows, matched_runs(rows, window, k), *KEYS).mapInArrow(run, "doc_id long, start long, length long")


def remove_repeats(docs: DataFrame, window: int = 35, k: int = 12) -> DataFrame:
    """docs with n_words, n_removed and kept: the words left, joined by one space.

    A word goes if a factor covers it, so if a window of `window` words of its document covers it whose sequence starts
    anywhere else, in the same document too; windows are judged on the input. Null text has no words; shorter texts
    keep all; repeated rows repeat each other, so they lose all windows; other columns pass, but those named as a new
    one are replaced; an empty table gives an empty one.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    rest = [c for c in docs.columns if c != "text"]
    others = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    rows = docs.select("text", others.alias("__rest"), *row_keys())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            w = words(batch.column("text"))
            start, count = _factors(w, batch.column("runs").fill_null([]))
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + count + window - 1, -1)
            stay = np.cumsum(edge)[:-1] == 0
            kept_before = np.concatenate(([0], np.cumsum(stay)))
            n_kept = np.diff(kept_before[w.ptr])
            s, e = w.start[stay], w.end[stay]
            size = e - s + 1  # with the space that follows; the last of a text has none
            total = np.concatenate(([0], np.cumsum(size)))
            out = w.data[np.minimum(np.arange(total[-1]) - np.repeat(total[:-1] - s, size), max(len(w.data) - 1, 0))] if total[-1] else np.zeros(0, np.uint8)
            out[total[1:] - 1] = 32
            ends = total[kept_before[w.ptr]]
            last = ends[1:][n_kept > 0] - 1
            mask = np.ones(len(out), bool)
            mask[last] = False
            offsets = ends - np.concatenate(([0], np.cumsum(n_kept > 0)))
            kept = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out[mask].tobytes()))
            n_words = np.diff(w.ptr)
            yield pa.RecordBatch.from_arrays([batch.column("__rest"), batch.column("text"), pa.array(n_words), pa.array(n_words - n_kept), kept], names=["__rest", "text", "n_words", "n_removed", "kept"])

    joined = split_join(rows, matched_runs(rows, window, k), *KEYS, how="left")
    kind = joined.select("__rest").schema.simpleString()[7:-1]
    done = joined.mapInArrow(cut, f"{kind},text:string,n_words:bigint,n_removed:bigint,kept:string")
    columns = {c: F.col(f"__rest.c{i}").alias(c) for i, c in enumerate(rest)}
    return done.select(*[columns.get(c, F.col(c)) for c in docs.columns], "n_words", "n_removed", "kept")


ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT rid, unnest(range(1, len(w) - 33)) AS s FROM docs WHERE len(w) >= 35),
windows AS (SELECT rid, s, array_to_string(w[s:s + 34], ' ') AS body FROM starts JOIN docs USING (rid)),
again AS (SELECT rid, s, count(*) OVER (PARTITION BY body) AS n FROM windows),
gone AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(s, s + 35)) AS p FROM again WHERE n > 1)),
each AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM each ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)"""
