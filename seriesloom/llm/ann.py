"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first traversal, calibrated leaf visits."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


@dataclass(frozen=True)
class Options:
    """sample: vectors of smallest hash that fit the tree (at most); fan: children of a node; leaf: sample vectors in a
    leaf at most, and about as many in each part that a task splits a leaf into. recall: wanted of the calibration
    queries, of which there are `probes`, none of them among the fitted; slack: factor on the visits so found. cap:
    vectors and queries that one task compares."""

    sample: int = 20_000
    fan: int = 8
    leaf: int = 512
    recall: float = 0.95
    probes: int = 200
    slack: float = 1.1
    cap: int = 20_000
    seed: int = 11


class Tree:
    """Centres of all nodes, a row each; children of inner nodes; leaves are numbered in order."""

    def __init__(self, x: np.ndarray, o: Options):
        rng = np.random.default_rng(o.seed)
        self.children: dict[int, tuple[np.ndarray, list[int]]] = {}
        self.leaves = self.nodes = 0
        self.leaf_of: dict[int, int] = {}
        self.root = self._grow(x, o, rng)

    def _grow(self, x: np.ndarray, o: Options, rng: np.random.Generator) -> int:
        node = self.nodes
        self.nodes += 1
        if len(x) > o.leaf:
            centres = x[rng.choice(len(x), o.fan, replace=False)].astype(np.float64)
            for _ in range(8):
                near = _distances(x, centres).argmin(axis=1)
                used = np.unique(near)
                centres = np.stack([x[near == c].mean(axis=0) for c in used])
            near = _distances(x, centres).argmin(axis=1)
            used = np.unique(near)
            if len(used) > 1:
                self.children[node] = (centres[used], [self._grow(x[near == c], o, rng) for c in used])
                return node
        self.leaf_of[node] = self.leaves
        self.leaves += 1
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at each node."""
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
                continue
            centres, kids = self.children[node]
            near = _distances(x[rows], centres).argmin(axis=1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def visit(self, q: np.ndarray, leaves: int, sizes: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first leaves in best-bin-first order: the nearest branch not yet taken, of all nodes passed, comes next.

        With sizes it widens further until the leaves hold `need` in all.
        """
        heap, out, held = [(0.0, self.root)], [], 0
        while heap and (len(out) < leaves or held < need):
            _, node = heapq.heappop(heap)
            while node not in self.leaf_of:
                centres, kids = self.children[node]
                d = ((centres - q) ** 2).sum(axis=1)
                best = int(d.argmin())
                for i, kid in enumerate(kids):
                    if i != best:
                        heapq.heappush(heap, (float(d[i]), kid))
                node = kids[best]
            out.append(self.leaf_of[node])
            held += need if sizes is None else int(sizes[out[-1]])
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared, up to a term that is the same for all c; in pieces, to bound memory."""
    return np.concatenate([(c * c).sum(axis=1) - 2.0 * x[i : i + 8192] @ c.T for i in range(0, len(x), 8192)]) if len(x) else np.zeros((0, len(c)))


def valid_vectors(vectors: DataFrame, vector: str = "embedding", width: int | None = None) -> DataFrame:
    """(vec_id, v): finite, non-zero double vectors of length width, or the most frequent one (of equal ones the smaller)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = vectors.where("vec_id is not null").select("vec_id", v.alias("v")).where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    if width:
        return some.where(F.size("v") == width)
    top = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return some.where(F.size("v") == (top["n"] if top else 0))


def calibrate(tree: Tree, fitted: np.ndarray, probes: np.ndarray, k: int, o: Options) -> int:
    """Leaf visits, widened step by step until the wanted share of the probes' true neighbours among the fitted lies in
    visited leaves; all leaves without probes."""
    if not len(probes):
        return tree.leaves
    leaf, ranks = tree.assign(fitted), []
    for q in probes:
        near = np.argsort(((fitted - q) ** 2).sum(axis=1), kind="stable")[:k]
        order = {x: i for i, x in enumerate(tree.visit(q, tree.leaves))}
        ranks += [order[x] for x in leaf[near]]
    visits = 1
    while np.mean(np.array(ranks) < visits) < o.recall:
        visits = max(visits + 1, int(visits * 1.25))
    return min(tree.leaves, math.ceil(visits * o.slack))


def _parts(c: np.ndarray, o: Options) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Centres of parts of about o.leaf rows of c, the rows of each, and the distance of each part's farthest row."""
    m = -(-len(c) // o.leaf)
    centres = c[np.random.default_rng(o.seed).choice(len(c), m, replace=False)]
    for _ in range(3 if m > 1 else 1):
        near = _distances(c, centres).argmin(axis=1)
        centres = np.stack([c[near == i].mean(axis=0) for i in np.unique(near)])
    near = _distances(c, centres).argmin(axis=1)
    rows = [np.flatnonzero(near == i) for i in range(len(centres))]
    return centres, rows, np.array([np.sqrt(((c[r] - x) ** 2).sum(axis=1)).max() if len(r) else 0.0 for x, r in zip(centres, rows, strict=True)])


def rough_squares(c: np.ndarray, asked: np.ndarray, k: int, parts: tuple[np.ndarray, list[np.ndarray], np.ndarray]) -> np.ndarray:
    """Squared distances of each of asked to rows of c, infinite for those of parts passed over.

    Parts are taken nearest first; one is passed over if its ball lies beyond k + 1 rows already found, so these are
    the nearest of all of c.
    """
    centres, rows, radius = parts
    out = np.full((len(asked), len(c)), np.inf)
    own, size = (asked * asked).sum(axis=1), (c * c).sum(axis=1)
    to = np.sqrt(np.maximum(_distances(asked, centres) + own[:, None], 0.0))
    order, least = np.argsort(to - radius, axis=1), np.maximum(to - radius, 0.0)
    best, limit = np.full((len(asked), k + 1), np.inf), np.full(len(asked), np.inf)
    for step in range(len(centres)):
        part = order[:, step]
        open_ = np.flatnonzero(least[np.arange(len(asked)), part] ** 2 <= limit * (1 + 1e-9) + 1e-9)
        if not len(open_):
            break
        for p in np.unique(part[open_]):
            q, r = open_[part[open_] == p], rows[p]
            if len(r):
                d = np.maximum(size[r] - 2.0 * asked[q] @ c[r].T + own[q, None], 0.0)
                out[q[:, None], r] = d
                best[q] = np.partition(np.concatenate((best[q], d), axis=1), k, axis=1)[:, : k + 1]
                limit[q] = best[q].max(axis=1)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, o: Options = Options(), vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of `vectors` for each of `queries`, but itself.

    Both have vec_id and a vector; score is the Euclidean distance; other columns are ignored, whatever their names.
    Every vector is indexed; the sample only shapes the tree, whose size `sample` bounds. A query visits the calibrated
    number of leaves, and more until they hold k + 1 vectors, so a query in a sparse leaf finds k too. Inside a task a
    leaf is split into parts of about `leaf` vectors, so that work in it does not grow with the table where vectors have
    structure; this loses nothing. Equal vectors are one class, of which the k + 1 smallest ids suffice, and equal
    queries are asked once, so copies do not multiply. A leaf with many vectors or queries is cut into blocks. Vectors
    that are null, zero, not finite or of another length take no part; repeated ids are one; ties go to smaller ids.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, vector)
    classes = stage(_classes(rows, k), "classes")
    sample = classes.select("v").withColumn("h", F.xxhash64("v", F.lit(o.seed))).orderBy("h", "v").limit(o.sample + o.probes).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    x = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1)
    probes = x[max(len(x) - o.probes, len(x) * 9 // 10) :]
    x = x[: len(x) - len(probes)] if len(x) > len(probes) else x
    tree = Tree(x, o)
    visits = calibrate(tree, x, probes, k, o)
    held = spark.sparkContext.broadcast(tree)
    width = x.shape[1]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.assign(matrix(batch.column(0))))], names=["v", "ids", "leaf"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [held.value.visit(q, visits, sizes, k + 1) for q in (matrix(batch.column(0)) if batch.num_rows else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], names=["v", "q", "leaves"])

    indexed = stage(classes.select("v", "ids").mapInArrow(index, "v array<double>, ids array<long>, leaf long"), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)  # a number a leaf
    for r in indexed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    asked = valid_vectors(queries, vector, width)
    asked = stage(asked.select("vec_id", "v", F.xxhash64("v").alias("q")), "queries")
    distinct = asked.groupBy("q", "v").agg(F.lit(1).alias("one")).select("v", "q")
    routed = distinct.mapInArrow(route, "v array<double>, q long, leaves array<long>").select("v", "q", F.explode("leaves").alias("leaf"))
    routed = stage(routed, "routes")
    cuts = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / o.cap).alias("vs")).join(routed.groupBy("leaf").agg(F.ceil(F.count("*") / o.cap).alias("qs")), "leaf")
    vs = indexed.join(cuts, "leaf").withColumn("i", F.pmod(F.xxhash64("v"), F.col("vs"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)))
    qs = routed.join(cuts, "leaf").withColumn("j", F.pmod(F.col("q"), F.col("qs"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vs") - 1)))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            c, ids = np.stack(left["v"].to_list()), left["ids"].to_list()
            size, parts = (c * c).sum(axis=1), _parts(c, o)
            for at in range(0, len(right), 256):
                asked = np.stack(right["v"].iloc[at : at + 256].to_list())
                own = (asked * asked).sum(axis=1)
                rough = rough_squares(c, asked, k, parts)
                most = np.partition(rough, k, axis=1)[:, k] if len(c) > k + 1 else np.full(len(asked), np.inf)
                for q, v, d, bound, scale in zip(right["q"].iloc[at : at + 256], asked, rough, most, own, strict=True):
                    # all that rounding could bring among the k + 1 nearest, then by exact differences
                    near = np.flatnonzero(d <= bound + 1e-9 * (scale + size.max()))
                    exact = np.sqrt(((c[near] - v) ** 2).sum(axis=1))
                    cells = sorted((s, i) for x, s in zip(near.tolist(), exact.tolist(), strict=True) for i in ids[x])[: k + 1]
                    out += [(q, i, s) for s, i in cells]
        return pd.DataFrame({"q": pd.Series([r[0] for r in out], dtype="int64"), "vec_id": pd.Series([r[1] for r in out], dtype="int64"), "score": pd.Series([r[2] for r in out], dtype="float64")})

    found = vs.select("leaf", "i", "j", "v", "ids").groupBy("leaf", "i", "j").cogroup(qs.select("leaf", "i", "j", "v", "q").groupBy("leaf", "i", "j")).applyInPandas(nearest, "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).select("q", "vec_id", "score")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "q").distinct().join(found, "q").where("query_id != vec_id")
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids, least first: a top-k within each class, cut before the shuffle."""
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    return kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
