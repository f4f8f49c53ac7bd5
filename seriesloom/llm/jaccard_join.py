"""N-gram Jaccard join: universe partition and pigeonhole signatures, then exact verification on the words.

Tokens are hashed into segments. Two linked sets of a size band differ in h tokens at most, and each difference spoils one
segment. A band is indexed in the way that costs least (`allocation`):

- by segments, h + 1 of them: one stays equal;
- by subsets of j segments in groups of `width`: a group with at most width - j spoiled ones keeps j equal;
- by one-deletion neighbourhoods, h // 2 + 1 segments: one has one difference at most, so its token sums agree, or do
  when one token is left out.

Bands share a number of segments, but a set is indexed by its first groups only, as many as its own size can need.

A segment that is empty proves nothing (in neighbourhoods, one of a single token neither), and no signature is made of it.
Each set has some more segments than differences for such weak ones (`slack`: two deviations above their mean). Of a pair
one set with no more weak segments than that is enough. The few sets with more are indexed by all segments, for the sake
of the others, and among themselves by the first h + 1 tokens in the order of hashes: of h differences one of these is
common to both.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEYS, discard, row_keys, split_join, stage, text_slices
from .components import components
from .words import Spans, gram_starts, mix, words


@dataclass(frozen=True)
class Options:
    """Two sets link when `of` * intersection >= `at` * union. n: words in a shingle. growth: of size bands.

    match: chance that two segments of one token agree, for the cost of an index; block: tokens of sets that one task
    compares with as many others; small and rounds: see set_components.
    """

    n: int = 3
    at: int = 90
    of: int = 100
    growth: float = 2.0
    match: float = 0.001
    block: int = 1_000_000
    small: int = 8
    rounds: int = 2


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, distinct and sorted in each text, the start of each text's (and the end), and second hashes."""
    w = words(column, lower=True)
    spans, others, count = Spans(w.hash), Spans(w.second, 1), np.diff(w.ptr)
    start, text = gram_starts(w.ptr, n)
    few = np.flatnonzero((count > 0) & (count < n))
    token = np.concatenate((spans.of(start, n), spans.of(w.ptr[few], count[few])))
    second = np.concatenate((others.of(start, n), others.of(w.ptr[few], count[few])))
    text = np.concatenate((text, few))
    order = np.lexsort((token, text))
    token, text, second = token[order], text[order], second[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    token, text, second = token[new], text[new], second[new]
    return token, np.searchsorted(text, np.arange(len(column) + 1)), second


def _set_hashes(token: np.ndarray, ptr: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set, sums over its tokens; 0 for empty sets."""
    n, out = np.diff(ptr).astype(np.uint64), []
    for x, salt in ((token, 0xA5A5A5A5A5A5A5A5), (second, 0x3C6EF372FE94F82B)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(x ^ np.uint64(salt)))))
        h = mix((total[ptr[1:]] - total[ptr[:-1]]) + mix(n + np.uint64(salt)))
        h[n == 0] = 0
        out.append(h)
    return out[0], out[1]


def _set_ids(token: np.ndarray, ptr: np.ndarray, second: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The first hash, or for those that several sets have (`shared`, sorted) one of both."""
    a, b = _set_hashes(token, ptr, second)
    if len(shared):
        a = np.where(np.isin(a, shared), mix(a ^ mix(b)), a)
    return a.view(np.int64)


def bands(o: Options, top: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands, so wide that a set links into its own and the next at most."""
    edges, growth = [1], max(o.growth, o.of / o.at)
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, int(edges[-1] * growth)))
    return np.array(edges, np.int64)


@dataclass(frozen=True)
class Layout:
    """How a band is indexed: groups of `width` segments, of which subsets of j are taken, or (near) single segments
    with one-deletion neighbourhoods. A segment of `near` tokens or fewer is weak."""

    groups: int
    width: int
    j: int
    near: bool

    @property
    def segments(self) -> int:
        return self.groups * self.width

    def slack(self, size: np.ndarray | float, segments: int | None = None) -> np.ndarray:
        """Weak segments of a set of that size: two deviations above the mean."""
        m = float(segments or self.segments)
        load = np.asarray(size, np.float64) / m
        weak = m * np.exp(-load) * (1 + load * self.near)
        return (weak + 2 * np.sqrt(weak) + 0.5).astype(np.int64)

    def needed(self, apart: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Groups of which one is good after so many differences and weak segments."""
        if self.near:
            return apart // 2 + 1 + slack
        return -(-(apart + 1 + slack) // (self.width - self.j + 1))

    def room(self, apart: np.ndarray) -> np.ndarray:
        """The largest slack for which all groups are enough."""
        return self.groups - 1 - apart // 2 if self.near else self.groups * (self.width - self.j + 1) - 1 - apart


def _layout(h: int, most: int, width: int, j: int, near: bool) -> Layout:
    """The band's largest sets need all groups; for smaller ones slack ends at what is left of them."""
    shape, m = Layout(1, width, j, near), width
    for _ in range(20):
        m = width * int(shape.needed(np.int64(h), shape.slack(most, m)))
    return Layout(m // width, width, j, near)


def allocation(counts: dict[int, int], o: Options) -> dict[int, Layout]:
    """The layout of each band with sets: the cheapest, by index rows and chance matches.

    counts: sets by band, as many entries as bands. Bands in which only equal sets link get none.
    """
    edges, out = bands(o), {}
    for band, n in counts.items():
        least, most = int(edges[band]), int(edges[band + 1]) - 1
        h = int(_most_apart(most, most, o))
        if h:
            costs = []
            for i, (width, j, near) in enumerate(((1, 1, False), (3, 2, False), (4, 2, False), (1, 1, True))):
                x = _layout(h, most, width, j, near)
                rows = x.groups + least if near else x.groups * math.comb(width, j)
                evidence = max(0.0, least / x.groups - 1 if near else j * least / x.segments)
                costs.append((rows * (1 + n * o.match**evidence), i, x))
            out[band] = min(costs, key=lambda c: c[:2])[2]
    return out


def _signatures(token: np.ndarray, ptr: np.ndarray, plan: dict[int, Layout], edges: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the set of each. A set is indexed in its own band, and in the next if a set there may link to it."""
    size = np.diff(ptr)
    own = np.searchsorted(edges, size, "right") - 1
    outs, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    largest = size * o.of // o.at
    reach = np.searchsorted(edges, largest, "right") - 1
    for band in np.unique(np.concatenate((own, reach))):
        if int(band) not in plan:
            continue
        x, salt = plan[int(band)], np.uint64(int(band) + 1) << np.uint64(32)
        rows = np.flatnonzero((size > 0) & ((own == band) | (reach == band)))
        n, m = size[rows], x.segments
        # the tokens of these sets by segment: their sums and numbers
        row = np.repeat(np.arange(len(rows)), n)
        t = token[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[rows], n)]
        segment = (mix(t ^ np.uint64(0x5BD1E995)) % np.uint64(m)).astype(np.int64)
        cell = row * m + segment
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], mix(t[order] ^ np.uint64(0x27D4EB2F165667C5))
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sums, held = np.zeros(len(rows) * m, np.uint64), np.zeros(len(rows) * m, np.int64)
        sums[cell[first]] = np.add.reduceat(value, first)
        held[cell[first]] = np.diff(np.concatenate((first, [len(cell)])))
        sums, held = sums.reshape(-1, m), held.reshape(-1, m)
        # a pair is found in the first groups of the set that needs fewer
        apart = _most_apart(n, np.minimum(largest[rows], edges[band + 1] - 1), o)
        slack = np.minimum(x.slack(n), x.room(apart))
        within = np.repeat(np.arange(x.groups) < x.needed(apart, slack)[:, None], x.width, axis=1)
        odd = ((held <= x.near) & within).sum(axis=1) > slack
        within |= odd[:, None]
        filled = (held > 0) & within
        tag = mix(np.arange(m, dtype=np.uint64) + salt)
        if x.near:
            r, i = np.nonzero(filled)
            outs.append(mix(sums[r, i] + tag[i]))
            of.append(rows[r])
            r, i = cell // m, cell % m
            use = np.flatnonzero((held[r, i] > 1) & within[r, i])
            outs.append(mix(sums[r[use], i[use]] - value[use] + tag[i[use]]))
            of.append(rows[r[use]])
        else:
            tagged, full = (sums + tag).reshape(-1, x.groups, x.width), filled.reshape(-1, x.groups, x.width)
            for subset in itertools.combinations(range(x.width), x.j):
                r, g = np.nonzero(full[:, :, subset].all(axis=2))
                sig = np.zeros(len(r), np.uint64)
                for i in subset:
                    sig = mix(sig * np.uint64(3) + mix(tagged[r, g, i]))
                outs.append(sig)
                of.append(rows[r])
        # tokens are in the order of their hashes
        r = np.flatnonzero(odd)
        take = np.minimum(apart[r] + 1, n[r])
        at = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take) + np.repeat(ptr[rows[r]], take)
        outs.append(mix(token[at] + (salt | np.uint64(1 << 63))))
        of.append(np.repeat(rows[r], take))
    return np.concatenate(outs), np.concatenate(of)


def _sketch(token: np.ndarray) -> bytes:
    """Tokens counted by hash in as many cells as the next power of two: cells of two sets differ by no more, in sum,
    than the sets do. Cells are cut at 255, which keeps that, and a sketch folds to half its length."""
    cells = 1 << max(0, int(len(token) - 1).bit_length())
    return np.minimum(np.bincount((mix(token ^ np.uint64(0x165667B19E3779F9)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _fold(sketch: np.ndarray, cells: int) -> np.ndarray:
    return np.minimum(sketch.reshape(-1, cells).sum(axis=0), 255)


def _most_apart(a: np.ndarray | int, b: np.ndarray | int, o: Options) -> np.ndarray | int:
    """How many tokens two linked sets of these sizes differ in at most."""
    return (a + b) * (o.of - o.at) // (o.of + o.at)


def _near(batches: Iterator[pa.RecordBatch], o: Options) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sketches (x, y) leave a link possible."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            cells = min(len(x), len(y))
            apart = int(np.abs(_fold(x, cells).astype(np.int64) - _fold(y, cells).astype(np.int64)).sum())
            keep.append(apart <= _most_apart(n, m, o))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    """The set itself: words, not hashes. bytes.lower and bytes.split know ASCII only."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else {tuple(w)} - {()}


def _verified(batches: Iterator[pa.RecordBatch], o: Options) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose texts (x, y) link; a pair's second set is often the next one's too."""
    last, y = None, set()
    for batch in batches:
        keep = []
        for b, left, right in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if b != last:
                last, y = b, shingles(right.as_py(), o.n)
            x = shingles(left.as_py(), o.n)
            both = len(x & y)
            keep.append(both > 0 and o.of * both >= o.at * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with columns of both sets."""
    left = sets.select(F.col("set_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = sets.select(F.col("set_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(left, "a").join(right, "b").select("a", "b", *[f"{x}_{c}" for c in columns for x in "ab"])


def _links(pairs: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """The pairs that link: first by sketches, a fraction of the sets' size, then exactly."""
    pairs = _with_sets(pairs, sets, "n", "sketch").mapInArrow(lambda it: _near(it, o), "a long, b long")
    return stage(_with_sets(pairs, sets, "text").mapInArrow(lambda it: _verified(it, o), "a long, b long"), "links")


def exact_ids(texts: list[str], n: int) -> list[np.ndarray]:
    """Each text's set as sorted numbers, equal for equal shingles of these texts: words are numbered, then pairs of
    numbers, so no hash decides."""
    number: dict[bytes, int] = {}
    words_of = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in texts]
    ids = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words_of]
    word = np.concatenate([*ids, np.zeros(0, np.int64)])
    ptr = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    gram, most = word, len(number) + 1
    for i in range(1, n):  # gram[j] numbers the i + 1 words from j on
        if len(gram) > 1:
            gram = np.unique(gram[:-1] * most + word[i:], return_inverse=True)[1].reshape(-1)
    short: dict[tuple[bytes, ...], int] = {}
    return [np.unique(gram[a : b - n + 1]) if b - a >= n else np.array([-1 - short.setdefault(tuple(ws), len(short))][: b - a]) for a, b, ws in zip(ptr[:-1], ptr[1:], words_of, strict=True)]


def _block_links(pdf: pd.DataFrame, o: Options) -> pd.DataFrame:
    """Links between different components of one block, verified on words: as many as join what can be joined, so fewer
    than sets. Sets are compared by counts in a few cells first."""
    pdf = pdf.drop_duplicates("set_id")
    ids, (sets, component) = exact_ids(pdf["text"].to_list(), o.n), (pdf[c].to_numpy() for c in ("set_id", "component"))
    n = np.array([len(x) for x in ids])
    table = np.stack([np.bincount(mix(x.astype(np.uint64)).astype(np.int64) & 255, minlength=256) for x in ids]).astype(np.int32)
    # by number; those of short texts are negative and lie at the end
    mark = np.zeros(max((int(x[-1]) for x in ids if len(x)), default=0) + 1 + len(ids), bool)
    label = np.unique(component, return_inverse=True)[1].reshape(-1)
    outside, done, out = np.flatnonzero(label != np.bincount(label).argmax()), np.zeros(len(ids), bool), []
    for i in outside.tolist():  # one end of a pair is outside the largest component
        done[i] = True
        near = np.flatnonzero((label != label[i]) & ~done)
        apart = np.abs(table[near] - table[i]).sum(axis=1)
        mark[ids[i]] = True
        for j in near[apart <= _most_apart(n[near], int(n[i]), o)].tolist():
            both = int(np.count_nonzero(mark[ids[j]])) if label[j] != label[i] else 0
            if both and o.of * both >= o.at * (int(n[i] + n[j]) - both):
                label[label == label[j]] = label[i]
                out.append((min(sets[i], sets[j]), max(sets[i], sets[j])))
        mark[ids[i]] = False
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _hopeful(pdf: pd.DataFrame, o: Options) -> pd.DataFrame:
    """The rows of one block whose set may link to one of another component, by sketches: others need no text.

    A quarter of the cells (64 at least) rules most pairs out, and all cells those that are left: sets that share much of
    their text, but too little, differ in several tokens of a coarse cell, which cancel out there.
    """
    pdf = pdf.drop_duplicates("set_id")
    sketch, n = [np.frombuffer(x, np.uint8) for x in pdf["sketch"]], pdf["n"].to_numpy()
    label, cells = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1].reshape(-1), np.array([len(x) for x in sketch])
    hope = np.zeros(len(pdf), bool)
    for c in np.unique(cells).tolist():
        # a larger set of a link has no more cells than this
        among = np.flatnonzero((cells >= c) & (cells * o.at <= 2 * c * o.of))
        fine = np.stack([_fold(sketch[i], c) for i in among]).astype(np.int16)
        table = np.stack([_fold(x, max(min(c, 64), c // 4)) for x in fine]).astype(np.int16)
        for k in np.flatnonzero(cells[among] == c).tolist():
            i = among[k]
            near = np.flatnonzero((label[among] != label[i]) & (n[among] * o.of >= n[i] * o.at) & (n[i] * o.of >= n[among] * o.at))
            near = near[((cells[among[near]] > c) | (near > k)) & ~(hope[i] & hope[among[near]])]
            for level in (table, fine):
                near = near[np.abs(level[near] - level[k]).sum(axis=1) <= _most_apart(n[among[near]], int(n[i]), o)]
            if len(near):
                hope[i] = hope[among[near]] = True
    return pdf.loc[hope, ["sig", "i", "j", "set_id", "component"]]


def _gathered(many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, set_id, component, n) with entries that overlap gathered into one, and the staged table it reads.

    Near copies share most of their entries, so comparing each entry ships every set many times. Entries that a chain of
    common sets joins are gathered where that costs less: the square of all their tokens against the sum of the squares
    of each entry's. A gathered entry has the name of its least set.
    """
    many = stage(many.select("sig", "set_id", "component", "n"), "many")
    lead = many.groupBy("sig").agg(F.min("set_id").alias("lead"))
    chain = split_join(many, lead, "sig").where("set_id != lead").select(F.col("set_id").alias("a"), F.col("lead").alias("b")).distinct()
    named = components(chain).select(F.col("node").alias("set_id"), F.col("component").alias("all"))
    named = many.join(named, "set_id", "left").withColumn("all", F.coalesce("all", "set_id"))
    apart = named.groupBy("all", "sig").agg(F.sum("n").cast("double").alias("w")).groupBy("all").agg(F.sum(F.col("w") * F.col("w")).alias("apart"))
    at_once = named.select("all", "set_id", "n").distinct().groupBy("all").agg(F.sum("n").cast("double").alias("w"))
    cheaper = at_once.join(apart, "all").select("all", (F.col("w") * F.col("w") <= F.col("apart")).alias("gather"))
    keyed = split_join(named, cheaper, "all").withColumn("sig", F.when(F.col("gather"), F.col("all")).otherwise(F.col("sig")))
    return keyed.select("sig", "set_id", "component", "n").distinct(), many


def set_components(rows: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(KEYS, n_shingles, set_id) of each of rows (KEYS, text) and (node, component) of the sets that link to others.

    Equal sets are one, told apart by two hashes. First each set is compared with the smallest of all its index entries,
    in `rounds` more with one of another component that leads one of its entries. Entries that still hold
    several components are then compared in full, across components only: as pairs if they hold `small` sets at most,
    else, gathered where they overlap, in blocks inside a task: of sets by sketches first, then of those that may
    link there by their texts. So groups of copies cost little more than their number,
    and no link between components is missed. Links are verified on the words of both texts.
    """
    keyed, edges = rows.select(*KEYS, "text"), bands(o)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            token, ptr, second = shingle_sets(batch.column(2), o.n)
            a, b = _set_hashes(token, ptr, second)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(ptr)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=[*KEYS, "n_shingles", "h1", "h2"])

    members = keyed.mapInArrow(describe, "__k1 long, __k2 long, n_shingles long, h1 long, h2 long")
    members = stage(members.groupBy(*members.columns).agg(F.count("*").alias("copies")).drop("copies"), "members")
    # first hashes of different sets: of n sets about n * n / 2**65, so none below billions and a few thousand at a trillion
    clash = members.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo != hi").select("h1")
    shared = np.array(sorted(r["h1"] for r in clash.collect()), np.int64).view(np.uint64)
    if len(shared):
        ids = pa.table({"h1": pa.array(shared.view(np.int64))})
        listed = F.broadcast(rows.sparkSession.createDataFrame(ids.to_pandas()).withColumn("both", F.lit(True)))

        def rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (3, 4))
                one = np.where(batch.column(5).is_valid().to_numpy(zero_copy_only=False), mix(a ^ mix(b)), a)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(one.view(np.int64))], names=[*KEYS, "n_shingles", "set_id"])

        members = members.join(listed, "h1", "left").select(*KEYS, "n_shingles", "h1", "h2", "both").mapInArrow(rehash, "__k1 long, __k2 long, n_shingles long, set_id long")
    else:
        members = members.select(*KEYS, "n_shingles", F.col("h1").alias("set_id"))
    # a row a band; log keeps the band's number near, the exact one is found from a size in it
    sizes = members.where("n_shingles > 0").groupBy(F.floor(F.log2("n_shingles") * 16).alias("x")).agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"), F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    for r in sizes:
        lo, hi = (int(np.searchsorted(edges, r[x], "right")) - 1 for x in ("lo", "hi"))
        for band in range(lo, min(hi, len(edges) - 2) + 2):
            counts[band] = counts.get(band, 0) + r["n"]
    plan = allocation(counts, o)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches):
            token, ptr, second = shingle_sets(batch.column(0), o.n)
            ids = _set_ids(token, ptr, second, shared)
            sig, of = _signatures(token, ptr, plan, edges, o)
            fresh = np.zeros(len(ids), bool)
            if len(seen) > 100_000:  # bounds memory; entries may repeat
                seen.clear()
            for i, x in enumerate(ids.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            use = fresh[of]
            yield pa.RecordBatch.from_arrays([pa.array(sig[use].view(np.int64)), pa.array(ids[of[use]])], names=["sig", "set_id"])

    entries = keyed.select("text").mapInArrow(index, "sig long, set_id long")
    # counted before the joins, which split hot entries; most signatures are of one row and go at once
    several = entries.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    found = stage(split_join(entries, several, "sig").distinct(), "found")
    leaders = found.groupBy("sig").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("last")).where("leader != last")
    entries = stage(split_join(found, leaders.drop("last"), "sig"), "entries")
    discard(found)

    candidates = entries.select("set_id").distinct()
    first = members.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct(*KEYS)).alias("first"))
    wanted = first.join(candidates, "set_id", "left_semi").select("set_id", *[F.col("first")[k].alias(k) for k in KEYS])

    def describe_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            token, ptr, _ = shingle_sets(batch.column(0), o.n)
            sketches = [_sketch(token[a:b]) for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(ptr)), batch.column(0), pa.array(sketches, pa.binary())], names=["set_id", "n", "text", "sketch"])

    sets = split_join(keyed, wanted, *KEYS).select("text", "set_id").mapInArrow(describe_sets, "set_id long, n long, text string, sketch binary")
    # rows that repeat have the same keys
    sets = stage(sets.dropDuplicates(["set_id"]), "sets")

    # one pair a set at a time, since pairs carry texts
    links = _links(entries.where("set_id != leader").groupBy(F.col("set_id").alias("a")).agg(F.min("leader").alias("b")), sets, o)
    labels = components(links)

    def labelled() -> DataFrame:
        known = entries.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
        return known.select("sig", "set_id", F.coalesce("component", "set_id").alias("component"))

    for i in range(o.rounds):
        lead = F.min_by(F.struct(F.col("set_id").alias("b"), F.col("component").alias("other")), F.xxhash64("sig", "set_id", F.lit(i)))
        leads = labelled().groupBy("sig").agg(lead.alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        asked = split_join(labelled(), leads.select("sig", "lead"), "sig").where("component != lead.other")
        found = _links(asked.groupBy(F.col("set_id").alias("a")).agg(F.min_by("lead.b", F.xxhash64("sig", F.lit(i))).alias("b")), sets, o)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)

    final = labelled()
    # entries with the same sets are one
    groups = final.groupBy("sig").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("set_id", F.lit(1)).cast("decimal(38,0)")).alias("h2"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    groups = groups.groupBy(F.col("n").alias("held"), "h", "h2").agg(F.min("sig").alias("sig"))
    open_sets = stage(split_join(final, groups.select("sig", "held"), "sig"), "open")
    few = open_sets.where(F.col("held") <= o.small).drop("held")
    pairs = few.alias("l").join(few.alias("r"), F.expr("l.sig = r.sig and l.component < r.component"))
    pairs = pairs.select(F.least("l.set_id", "r.set_id").alias("a"), F.greatest("l.set_id", "r.set_id").alias("b"))
    many, whole = _gathered(open_sets.where(F.col("held") > o.small).drop("held").join(sets.select("set_id", "n"), "set_id"))
    # an entry of more than `block` tokens is dealt to chunks by hash; each meets every other
    total = many.groupBy("sig").agg(F.ceil(F.sum("n") / o.block).alias("parts"))
    chunked = split_join(many, total, "sig").select("sig", "set_id", "component", F.pmod(F.xxhash64("set_id"), "parts").alias("chunk"))
    chunked = stage(chunked, "chunks")
    chunks = chunked.groupBy("sig", "chunk").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    blocks = chunks.alias("l").join(chunks.alias("r"), F.expr("l.sig = r.sig and l.chunk <= r.chunk and not (l.lo = l.hi and r.lo = r.hi and l.lo = r.lo)"))
    blocks = blocks.select(F.col("l.sig").alias("sig"), F.col("l.chunk").alias("i"), F.col("r.chunk").alias("j"))
    blocks = blocks.select("sig", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    drawn = blocks.join(chunked, ["sig", "chunk"]).join(sets.select("set_id", "n", "sketch"), "set_id").select("sig", "i", "j", "set_id", "component", "n", "sketch")
    hopeful = drawn.groupBy("sig", "i", "j").applyInPandas(lambda pdf: _hopeful(pdf, o), "sig long, i long, j long, set_id long, component long")
    hopeful = stage(hopeful, "hopeful")
    shipped = hopeful.join(sets.select("set_id", "text"), "set_id").select("sig", "i", "j", "set_id", "component", "text")
    blocked = shipped.groupBy("sig", "i", "j").applyInPandas(lambda pdf: _block_links(pdf, o), "a long, b long")
    more = _links(pairs.distinct(), sets, o).unionByName(stage(blocked, "links"))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    discard(entries, sets, open_sets, whole, chunked, hopeful)
    return members, labels


def _classes(rows: DataFrame, o: Options) -> DataFrame:
    """KEYS, n_shingles and __class of each different row: a class's name, or null for rows without words."""
    members, labels = set_components(rows, o)
    named = members.where("n_shingles > 0").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.select(*KEYS, "n_shingles", F.coalesce("component", "set_id").alias("__class"))
    return named.unionByName(members.where("n_shingles = 0").select(*KEYS, "n_shingles", F.lit(None).cast("long").alias("__class")))


def jaccard_components(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """docs with n_shingles and component_id, the smallest doc_id that links lead to, itself included.

    Null text and texts without words have the empty set, which links with nothing; of a class, null doc_ids do not
    name it unless all are null; repeated rows are one class; other columns pass, but those named as a new one are
    replaced; an empty table gives an empty one.
    """
    docs = docs.drop("n_shingles", "component_id")
    rows = docs.select("*", *row_keys())
    classes = stage(_classes(rows, o), "classes")
    ids = rows.select("doc_id", *KEYS).groupBy("doc_id", *KEYS).agg(F.count("*").alias("n"))
    smallest = ids.join(classes.where("__class is not null"), list(KEYS)).groupBy("__class").agg(F.min("doc_id").alias("__smallest"))
    known = split_join(classes, smallest, "__class", how="left").select(*KEYS, "n_shingles", "__smallest")
    joined = split_join(rows, known, *KEYS).withColumn("component_id", F.coalesce("__smallest", "doc_id"))
    return joined.select(*docs.columns, "n_shingles", "component_id")


def one_of_each(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """One row of each class: of the smallest doc_id, null ones last, then the smallest hashes of text and other columns.

    Rows that repeat are one class, so one of them stays; rows without words link with nothing else. Columns pass.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("*", *row_keys(), (F.xxhash64(*others) if others else F.lit(0).cast("long")).alias("__other"))
    key = [*KEYS, "__other"]
    ids = rows.select("doc_id", *key).groupBy("doc_id", *key).agg(F.count("*").alias("n"))
    # rows without words are told apart by doc_id and text
    alone = [F.when(F.col("__class").isNull(), F.col(k)).alias(f"{k}_alone") for k in KEYS]
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *key, "n"))
    chosen = ids.join(_classes(rows, o), list(KEYS)).groupBy("__class", *alone).agg(least.alias("x"))
    chosen = stage(chosen.select(*[F.col("x")[k].alias(k) for k in [*key, "n"]]), "chosen")
    one, several = (split_join(rows, chosen.where(x).drop("n"), *key) for x in ("n = 1", "n > 1"))
    return one.unionByName(several.dropDuplicates(key)).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 90 * (s.n + t.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT docs.doc_id AS doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(reach.y) AS component_id
FROM docs JOIN reach ON reach.x = docs.doc_id LEFT JOIN sizes ON sizes.doc_id = docs.doc_id GROUP BY docs.doc_id"""
