"""Quality resampling, substring dedup, Jaccard join, mixing and licenses against brute force."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import jaccard_join, licenses, mixing, quality, queries, substring_dedup
from seriesloom.llm.common import kth_largest, table
from tests.duck import duck, spark_rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_jaccard_join", "op10_licenses"])
def test_same_rows_as_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck(queries.oracle_sql()[name], SF)


# Quality


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), 0.5, -1e300, 1e-300, 7.0]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 57, 200, 399, 400, 1000):
        assert kth_largest(df, "x", k, fan=4) == sorted(values, reverse=True)[min(k, 400) - 1]
    assert kth_largest(df, "x", 0) is None


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    kept = quality.resample(docs, labels.where(seen)).select("doc_id", F.lit(1).alias("kept"))
    held = labels.where(~seen).join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share"))
    share = {r["quality"]: r["share"] for r in held.collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def test_ratios_and_draw_by_brute_force(spark):
    """Models counted by hand, and the k largest of weight and noise, which decides some rows and not all."""
    rng = random.Random(12)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if (i % 2 or rng.random() < 0.4) else bad) for _ in range(rng.choice([0, 1, 2, 6, 30])))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)], "doc_id long, quality int")
    o = quality.Options(buckets=1 << 12, smoothing=50.0)
    rows_ = quality.flagged(docs, labels, o)
    fits = {r["doc_id"] for r in rows_.where("fits").collect()}
    holds = {r["doc_id"] for r in rows_.where("holds").collect()}
    assert fits | holds == {i for i in range(0, 400, 3) if i % 2} and not fits & holds
    bucket = {}
    for d, text in rows:
        got, _, grams = quality.features(pa.array([text]), o.buckets)
        bucket[d] = got.tolist()
        n = len(text.split())
        assert len(got) == grams[0] == max(0, 2 * n - 1) and sum(b < o.buckets for b in bucket[d]) == n
    raw = collections.Counter(b for d, _ in rows for b in bucket[d])
    target = collections.Counter(b for d in fits for b in bucket[d])
    ratio = {}
    for part in (range(o.buckets), range(o.buckets, 2 * o.buckets)):
        all_raw, all_target = (sum(c[b] for b in part) for c in (raw, target))
        for b in part:
            if raw[b]:
                p = raw[b] / all_raw
                ratio[b] = math.log((target[b] + o.smoothing * p) / (all_target + o.smoothing) / p)
    means = [sum(ratio[b] for b in bucket[d]) / len(bucket[d]) for d in holds if bucket[d]]
    level = float(np.percentile(means, 100 * (1 - o.keep)))
    weight = {d: sum(ratio[b] - level for b in bucket[d]) for d, _ in rows}
    everyone = quality.score(docs, quality.log_ratios(rows_, o), level, o).collect()
    assert {r["doc_id"]: r["log_weight"] for r in everyone} == pytest.approx(weight)
    k = sum(w >= 0 for w in weight.values())
    drawn = sorted(everyone, key=lambda r: -r["perturbed"])[:k]
    kept = {r["doc_id"] for r in quality.resample(docs, labels, o).collect()}
    assert kept == {r["doc_id"] for r in drawn}
    assert 0 < len(kept - {d for d, w in weight.items() if w >= 0}) < 0.3 * k
    assert quality.resample(docs, labels, quality.Options(buckets=1 << 12, sample=25)).count() == 25


def test_noise_draws_in_proportion(spark):
    """The first of three by noise alone: shares follow the weights."""
    df = spark.createDataFrame([(i, " ".join(["word"] * (i % 3))) for i in range(6000)], "doc_id long, text string")
    ratio = np.array([math.log(2.0), 0.0])  # of words and of pairs
    rows = quality.score(df, ratio, 0.0, quality.Options(buckets=1)).collect()
    noisy = {r["doc_id"]: r["perturbed"] for r in rows}
    first = collections.Counter(max(range(i, i + 3), key=noisy.get) % 3 for i in range(0, 6000, 3))
    assert [first[i] / 2000 for i in range(3)] == pytest.approx([1 / 7, 2 / 7, 4 / 7], abs=0.04)


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, None), (6, 0, 1), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    first = quality.resample(edge, labels)
    assert first.columns[:2] == ["doc_id", "text"] and first.columns[-3:] == ["n_grams", "log_weight", "perturbed"]
    again = quality.resample(edge.repartition(2), labels)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert quality.resample(edge, labels.limit(0)).count() == edge.count()
    assert quality.resample(empty, labels).count() == 0


# Substring dedup


def removed_by_hand(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((doc, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, k, seed", [(5, 2, 1), (8, 3, 2), (35, 12, 3)])
def test_substring_brute_force(spark, window, k, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edit"
            parts += p + [f"u{rng.random()}" for _ in range(rng.randint(0, window))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(100, "x " * (3 * window)), (101, "x y " * window), (102, None), (103, ""), (104, "x " * window), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(df, window, k).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == removed_by_hand(rows, window)


def thue_morse(n=4096):
    """Two words, or sequences of words, whose sums of powers agree modulo 2**64 for any base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return bits, [1 - b for b in bits]


def test_no_structure_of_words_fools_the_hashes(spark):
    a, b = ("".join("ab"[x] for x in bits) for bits in thue_morse())
    same = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{same} {a}"), (2, f"{same} {b}")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = jaccard_join.jaccard_components(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_links_are_verified_on_words():
    """Whatever hashes proposed: only the words of both texts decide."""
    names, texts = ["a", "b", "x", "y"], [["a b c d", "A b c", None, "e f"], ["a b c e", "a b C", "", "E F"]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([6, 7, 8, 9]), *map(pa.array, texts)], names=names)
    assert [b.to_pydict() for b in jaccard_join._verified(iter([batch]), jaccard_join.Options())] == [{"a": [2, 4], "b": [7, 9]}]


def test_repeated_rows_cost_their_number(spark):
    """No pairs of copies are made: the rows of every stage grow in proportion."""
    text = " ".join(f"w{i}" for i in range(120))
    for n in (200, 400):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
        runs = substring_dedup.matched_runs(df.withColumn("__k1", F.col("doc_id")).withColumn("__k2", F.col("doc_id")))
        assert runs.agg(F.sum(F.size("runs"))).first()[0] <= n * (120 - 34)
        assert substring_dedup.remove_repeats(df).where("n_removed = 120").count() == n


def test_parse():
    start, count = substring_dedup.parse(np.array([7, 0, 3, 20, 2]), np.array([2, 3, 1, 1, 5]))
    assert start.tolist() == [0, 20] and count.tolist() == [9, 1]
    assert [x.tolist() for x in substring_dedup.parse(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[], []]


def test_factors(spark):
    shared = [f"s{i}" for i in range(30)]
    rows = [(1, " ".join(["a1", *shared, "a2"])), (2, " ".join(["b1", "b2", *shared[:20], "edit", *shared[21:]])), (3, "nothing here " * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substring_dedup.factors(df, 8, 3).collect()))
    assert got == [(1, 1, 20), (1, 22, 9), (2, 2, 20), (2, 23, 9)]


def test_substring_edges(spark, edge, empty):
    out = substring_dedup.remove_repeats(edge, 4, 2)
    assert set(out.columns) == set(edge.columns) | {"n_removed"} and out.count() == edge.count()
    gone = {r["doc_id"]: r["n_removed"] for r in out.collect()}
    assert gone[1] == 4 and gone[7] == 4 and gone[2] == 0 and gone[None] == 4
    assert substring_dedup.remove_repeats(empty).count() == 0


# Jaccard


def components_by_hand(rows, n, at, of):
    sets = {}
    for doc, text in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and of * both >= at * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), root(d)) for d in ids)


@pytest.mark.parametrize("at, small, block, seed", [(90, 64, 10**6, 1), (90, 3, 100, 2), (80, 3, 60, 3), (60, 64, 10**6, 4)])
def test_jaccard_brute_force(spark, at, small, block, seed):
    rng = random.Random(seed)
    rows = [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, "one")]
    for base in range(12):
        size = rng.choice([3, 8, 12, 20, 40, 70, 150])
        words = [f"{rng.randint(0, 40)}" for _ in range(size)]
        for copy in range(rng.choice([1, 5, 14])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, size // 25))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
            rows.append((base * 20 + copy, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(df, jaccard_join.Options(at=at, small=small, block=block))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == components_by_hand(rows, 3, at, 100)


@pytest.mark.parametrize("n, at, match", [(5, 80, 0.3), (5, 80, 0.0), (3, 60, 0.3), (3, 90, 0.3), (3, 60, 0.9)])
def test_jaccard_prefixes_of_any_size(spark, n, at, match):
    """Each document and its prefixes just above and below the threshold; with match=0 single segments, with 0.9 longer evidence."""
    rows = []
    for base, size in enumerate([6, 7, 9, 11, 14, 18, 23, 31, 44, 60, 95, 140, 260, 500]):
        words = [f"b{base}w{i}" for i in range(size + n - 1)]
        least = -(-size * at // 100)
        rows += [(base * 10, " ".join(words)), (base * 10 + 1, " ".join(words[: least + n - 1])), (base * 10 + 2, " ".join(words[: max(1, least * at // 100 - 1 + n - 1)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(df, jaccard_join.Options(n=n, at=at, match=match))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == components_by_hand(rows, n, at, 100)


def test_jaccard_edges(spark, edge, empty):
    out = jaccard_join.jaccard_components(edge)
    assert out.count() == edge.count() and set(out.columns) == set(edge.columns) | {"n_shingles"}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got[7] == (2, 1) and got[2] == (0, 2) and got[4] == (0, 4)
    assert jaccard_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("size", [9, 10, 12, 20])
def test_unrelated_sets_share_no_entry(size):
    """Random sets: no signature of an empty segment or of what a single token leaves."""
    rng, o = np.random.default_rng(size), jaccard_join.Options()
    n = 20_000
    token = np.sort(rng.integers(0, 2**64, (n, size), dtype=np.uint64), axis=1).reshape(-1)
    edges = jaccard_join.bands(o)
    band = int(np.searchsorted(edges, size, "right")) - 1
    for match in (0.0, 0.3, 0.999):
        x = jaccard_join.Options(match=match)
        plan = jaccard_join.allocation({band: n, band + 1: n}, x)
        sig, of = jaccard_join._signatures(token, np.arange(n + 1) * size, plan, edges, x)
        if len(sig):
            assert np.unique(np.unique(np.stack((sig, of.astype(np.uint64))), axis=1)[0], return_counts=True)[1].max() <= 3


@pytest.mark.parametrize("at", [60, 80, 90])
@pytest.mark.parametrize("layout", [(1, 1, False), (3, 2, False), (4, 2, False), (1, 1, True)])
def test_every_linked_pair_shares_a_signature(at, layout):
    """All layouts, sets with very uneven segments too: without Spark, over many random pairs at the threshold."""
    rng, o = np.random.default_rng(at), jaccard_join.Options(at=at)
    edges = jaccard_join.bands(o)
    for size in [*range(2, 40), 60, 100, 333]:
        for _ in range(12):
            pool = rng.integers(0, 2**64, 2 * size, dtype=np.uint64)
            gone = int(rng.integers(0, size * (100 - at) // 100 + 1))
            more = int(rng.integers(0, max(0, (size - gone) * 100 // at - size) + 1))
            sets = [np.unique(pool[:size]), np.unique(np.concatenate((pool[gone:size], pool[size : size + more])))]
            both = len(np.intersect1d(*sets))
            if not both or 100 * both < at * (len(sets[0]) + len(sets[1]) - both):
                continue
            top = int(np.searchsorted(edges, max(map(len, sets)), "right")) - 1
            plan = {}
            for band in range(max(0, top - 1), top + 2):
                most = int(edges[band + 1]) - 1
                h = int(jaccard_join._most_apart(most, most, o))
                if h:
                    plan[band] = jaccard_join._layout(h, most, *layout)
            sig, of = jaccard_join._signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), plan, edges, o)
            if len(np.setxor1d(*sets)):
                assert set(sig[of == 0]) & set(sig[of == 1]), (size, gone, more)


def test_numbers_are_exact():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("aAbBcd") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", " \n", "a b", "A  b", "b a"]
    for n in (1, 2, 3, 5):
        ids, sets = jaccard_join.exact_ids(texts, n), [jaccard_join.shingles(t, n) for t in texts]
        for x, s in zip(ids, sets, strict=True):
            for y, t in zip(ids, sets, strict=True):
                assert len(x) == len(s) and len(np.intersect1d(x, y)) == len(s & t)


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate((rng.choice(a, len(a) // 2), rng.integers(0, 2**63, rng.integers(1, 90), dtype=np.uint64))))
        x, y = (np.frombuffer(jaccard_join._sketch(s), np.uint8) for s in (a, b))
        cells = min(len(x), len(y))
        apart = np.abs(jaccard_join._fold(x, cells).astype(int) - jaccard_join._fold(y, cells).astype(int)).sum()
        assert apart <= len(np.setxor1d(a, b))


# Mixing


def weights(tokens, alpha):
    raised = [(t / sum(tokens)) ** alpha for t in tokens]
    return [x / sum(raised) for x in raised]


def test_sources_are_summed_in_spark(spark):
    tokens = [1000, 300, 40, 5, 5, 0]
    df = spark.createDataFrame([(t,) for t in tokens], "source_tokens long")
    for o in (mixing.Options(), mixing.Options(entropy=0.9), mixing.Options(repetition=3.0, budget=2000), mixing.Options(entropy=0.7, repetition=None)):
        assert mixing.exponent(mixing.spark_totals(df), o) == pytest.approx(mixing.exponent(tokens, o), abs=1e-9)
    assert mixing.exponent(mixing.spark_totals(df.limit(0))) == 1.0


def test_large_plans_are_joined(spark, edge):
    small, large = (mixing.mix_sources(edge, mixing.Options(sent=n)) for n in (10**6, 0))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_exponent_meets_its_targets():
    tokens = [1000, 300, 40, 5]
    share = lambda a: weights(tokens, a)
    a = mixing.exponent(tokens, mixing.Options(repetition=2.0))
    w = share(a)
    b = max(t / x for t, x in zip(tokens, w, strict=True))
    assert max(b * x / t for t, x in zip(tokens, w, strict=True)) == pytest.approx(2.0)
    a = mixing.exponent(tokens, mixing.Options(entropy=0.8, repetition=None))
    assert -sum(x * math.log(x) for x in share(a)) / math.log(4) == pytest.approx(0.8)
    assert mixing.exponent(tokens, mixing.Options(repetition=None)) == 0.0 and mixing.exponent([], mixing.Options()) == 1.0
    assert mixing.exponent([7], mixing.Options()) == 0.0


def test_mixing_quota(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i < 700 else f"s{i % 5}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    o = mixing.Options(repetition=1.8, blocks=64)
    drawn = mixing.mix_sources(df, o).persist()
    words = {d: len(t.split()) for d, t, _ in rows}
    tokens = collections.Counter()
    for d, _, s in rows:
        tokens[s] += words[d]
    got, passes = collections.Counter(), collections.defaultdict(list)
    for r in drawn.collect():
        got[r["source"]] += words[r["doc_id"]]
        passes[r["doc_id"]].append(r["mix_pass"])
    sources = sorted(tokens)
    w = weights([tokens[s] for s in sources], mixing.exponent([tokens[s] for s in sources], o))
    budget = max(tokens[s] / x for s, x in zip(sources, w, strict=True))
    for s, x in zip(sources, w, strict=True):
        assert budget * x - 1e-6 <= got[s] <= budget * x + tokens[s] / 5
    assert len(passes) == 1000 and all(sorted(p) == list(range(len(p))) for p in passes.values())
    half = mixing.mix_sources(df, mixing.Options(repetition=None, budget=sum(tokens.values()) // 2, blocks=64))
    assert half.count() < 1000


def test_mixing_edges(spark, edge, empty):
    out = mixing.mix_sources(edge)
    assert out.select("text").distinct().count() == edge.select("text").distinct().count()
    assert set(out.columns) == set(edge.columns) | {"mix_order"}
    assert mixing.mix_sources(empty).count() == 0


# Licenses


def test_license_inheritance(spark):
    rows = [
        (1, "a", "LICENSE", "Released under the MIT License."),
        (2, "a/b/c", "x.py", "no notice here"),
        (3, "a/b", "COPYING.txt", "Licensed under the\nApache License,\nVersion 2.0."),
        (4, "a/d", "y.py", "code\n# Licensed under the Apache License, Version 2.0.\nmore"),
        (5, "z", "z.py", None),
        (6, "ab", "q", "the license plate of the car under the bridge"),
        (7, None, None, "text"),
        (1, "a", "LICENSE", "Released under the MIT License."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, name string, text string")
    got = sorted((r["doc_id"], r["license"], r["basis"]) for r in licenses.scan(df).collect())
    assert got == [(1, "MIT", "own"), (1, "MIT", "own"), (2, "Apache-2.0", "inherited"), (3, "Apache-2.0", "own"), (4, "Apache-2.0", "own"), (5, None, "none"), (6, None, "none"), (7, None, "none")]


def test_license_edges(spark, edge, empty):
    assert licenses.scan(licenses.document_files(edge)).count() == edge.count()
    assert licenses.scan(licenses.document_files(empty)).count() == 0


def test_license_texts(spark):
    """Texts other than the templates: wrapped, commented, with holders, abridged, and the whole of a common licence."""
    mit = """{title}Copyright (c) 2023 Some One and Others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
{rest}"""
    rest = """
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
    header = "#!/usr/bin/env python\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\"); you may\n# not use this file except in compliance with the License.\nimport os\nprint(os)\n"
    texts = [
        ("LICENSE", mit.format(title="MIT License\n\n", rest=rest), "MIT"),
        ("LICENSE.txt", mit.format(title="MIT License\n\n", rest=""), "MIT"),
        ("COPYING", mit.format(title="", rest=""), "MIT"),
        ("a.py", header, "Apache-2.0"),
        ("b.c", "/* SPDX-License-Identifier: BSD-3-Clause */\nint main() {}", "BSD-3-Clause"),
        ("c.c", "// Copyright 2020 X Inc. All rights reserved.\nint x;", "Proprietary"),
        ("d.txt", "the mit of old and a license to drive, permission of any person\n" * 3, None),
        ("e.go", "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\npackage main", "GPL-3.0"),
        ("LICENSE.md", "Copyright (c) 2015, A. Nother\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n", None),
    ]
    df = spark.createDataFrame([(i, str(i), name, text) for i, (name, text, _) in enumerate(texts)], "doc_id long, path string, name string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(8)] == [x for _, _, x in texts[:8]]
    assert got[8] == "Proprietary"  # an opening alone is not a licence text; its notice is matched


def test_license_hot_directory(spark):
    rows = [(i, "hot/dir", f"{i}.txt", "words only") for i in range(500)] + [(500, "hot", "LICENSE", "Released under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, name string, text string")).groupBy("license", "basis").count().collect()
    assert sorted(map(tuple, got)) == [("MIT", "inherited", 500), ("MIT", "own", 1)]


def test_blocks_hold_back_texts_of_sets_too_far_apart():
    """Sets of 512 tokens that share 430 (0.72) need no text at 0.8; sets that share 456 (0.803) do. Fifty of each."""
    import pandas as pd

    from seriesloom.llm.jaccard_join import Options, _hopeful, _sketch

    draw, o = np.random.default_rng(3), Options(n=5, at=80)
    for common, hopeful in ((430, 0), (456, 100)):
        sets = []
        for _ in range(50):
            both = draw.integers(0, 2**64, common, np.uint64)
            sets += [np.concatenate((both, draw.integers(0, 2**64, 512 - common, np.uint64))) for _ in range(2)]
        rows = [(1, 0, 0, i, i, len(x), _sketch(x)) for i, x in enumerate(sets)]
        pdf = pd.DataFrame(rows, columns=["sig", "i", "j", "set_id", "component", "n", "sketch"])
        assert len(_hopeful(pdf, o)) == hopeful
        pdf["component"] //= 2  # nothing is left to join
        assert not len(_hopeful(pdf, o))
