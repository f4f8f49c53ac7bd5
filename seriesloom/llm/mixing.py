"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stage


@dataclass(frozen=True)
class Options:
    """entropy: target for the normalised entropy of the weights (0 to 1), or None; repetition: most passes over a source, or None.

    With both, the flatter exponent that meets both. budget: tokens to draw, or None for the least that passes every
    source once at the weights found. blocks: of each source, permuted anew in each pass.
    """

    entropy: float | None = None
    repetition: float | None = 1.5
    budget: int | None = None
    blocks: int = 1024
    sent: int = 200_000
    seed: int = 29


def n_words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Totals:
    """Of the sources with tokens: how many, the least and most tokens of one, and for exponents a the sums of t**a and
    of t**a * log(t), t as a share of the most."""

    n: int
    least: int
    most: int
    sums: Callable[[list[float]], list[tuple[float, float]]]


def totals_of(tokens: list[int]) -> Totals:
    some = [t for t in tokens if t > 0]
    most = max(some, default=1)

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        logs = [math.log(t / most) for t in some]
        return [(sum(math.exp(a * x) for x in logs), sum(math.exp(a * x) * x for x in logs)) for a in alphas]

    return Totals(len(some), min(some, default=1), most, sums)


def spark_totals(by_source: DataFrame) -> Totals:
    """Of a table (source_tokens), a row a source; the sums are aggregated in Spark, only they reach the driver."""
    some = by_source.where("source_tokens > 0")
    n, least, most = some.agg(F.count("*"), F.min("source_tokens"), F.max("source_tokens")).first()
    x = F.log(F.col("source_tokens") / F.lit(float(most or 1)))

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        r = some.agg(*[c for i, a in enumerate(alphas) for c in (F.sum(F.exp(a * x)).alias(f"s{i}"), F.sum(F.exp(a * x) * x).alias(f"l{i}"))]).first()
        return [(r[f"s{i}"] or 0.0, r[f"l{i}"] or 0.0) for i in range(len(alphas))]

    return Totals(n, least or 1, most or 1, sums)


def _bisect(meets: Callable[[list[float]], list[bool]], rounds: int = 12, fan: int = 31) -> float:
    """The smallest exponent in [0, 1] that meets a condition which holds from some exponent on; 1 if none does.

    Bisection with `fan` exponents tried at once, so that a round is one job.
    """
    low, high = 0.0, 1.0
    if meets([0.0])[0]:
        return 0.0
    for _ in range(rounds):
        tried = [low + (high - low) * (i + 1) / (fan + 1) for i in range(fan)]
        first = next((i for i, ok in enumerate(meets(tried)) if ok), fan)
        low, high = (low, *tried, high)[first], (*tried, high)[first]
    return high


def exponent(tokens: list[int] | Totals, o: Options = Options()) -> float:
    """Exponent 1 keeps the sources' shares, 0 makes them equal. Entropy falls and repetition falls with it."""
    t = tokens if isinstance(tokens, Totals) else totals_of(tokens)
    if not t.n:
        return 1.0
    spread = math.log(t.most / t.least)

    def few_passes(alphas: list[float]) -> list[bool]:
        # of the smallest source; without a budget the largest is passed once
        if o.budget is None:
            passes = [math.exp((1 - a) * spread) for a in alphas]
        else:
            passes = [o.budget / t.most / s * math.exp((1 - a) * spread) for a, (s, _) in zip(alphas, t.sums(alphas), strict=True)]
        return [x <= o.repetition + 1e-12 for x in passes]

    def mixed(alphas: list[float]) -> list[bool]:
        flat = t.sums([1 - a for a in alphas])
        return [(math.log(s) - (1 - a) * x / s) / math.log(max(2, t.n)) >= o.entropy for a, (s, x) in zip(alphas, flat, strict=True)]

    alpha = 0.0 if o.repetition is None else _bisect(few_passes)
    if o.entropy is not None:
        # the largest exponent of enough entropy, but not below what the repetition limit allows
        alpha = max(alpha, 1 - _bisect(mixed))
    return alpha


def plan(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """One row for each (source, block): its tokens, and passes: how often each of its documents is drawn.

    A source's quota is budget * weight tokens. Each pass takes the source's blocks in an order that a hash of pass and
    block gives; the last, partial pass stops at the block with which the quota is reached or passed.
    """
    blocks = stage(docs.groupBy("source", _block(o).alias("block")).agg(F.sum(n_words()).alias("tokens"), F.count("*").alias("n_docs")), "blocks")
    by_source = stage(blocks.groupBy("source").agg(F.sum("tokens").alias("source_tokens")), "sources")
    totals = spark_totals(by_source)
    alpha = exponent(totals, o)
    # shares of the largest source; its quota without a budget is its tokens, so it is passed once
    raised = totals.sums([alpha])[0][0] or 1.0
    budget = o.budget if o.budget is not None else totals.most * raised
    weight = F.when(F.col("source_tokens") > 0, F.exp(alpha * F.log(F.col("source_tokens") / F.lit(float(totals.most)))) / raised).otherwise(0.0)
    quota = by_source.withColumn("weight", weight).withColumn("quota", F.col("weight") * float(budget))
    # whole passes, then what is left of the quota; a source of no tokens is passed once
    done = F.when(F.col("source_tokens") > 0, F.floor(F.col("quota") / F.greatest(F.col("source_tokens"), F.lit(1)) + 1e-9)).otherwise(1)
    quota = quota.withColumn("whole", done).withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("source_tokens"), F.lit(0.0)))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "whole", F.lit(o.seed)), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = blocks.join(quota.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    extra = (before < F.col("rest") - 0.5) & (F.col("tokens") > 0)
    return joined.withColumn("passes", (F.col("whole") + extra.cast("int")).cast("int"))


def _block(o: Options) -> F.Column:
    return F.pmod(F.xxhash64(row_key(), F.lit(o.seed)), F.lit(o.blocks)).cast("int")


def mix_sources(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """docs with mix_pass, from 0, and mix_order, the place of its block in that pass: each row as often as planned.

    A null source is one of its own; null text has no tokens; repeated rows are drawn alike; an empty table gives an
    empty one; columns named as a new one are replaced. The plan has sources * blocks rows at most; a small one is sent
    to every task, a larger one joined by (source, block), which splits a hot source.
    """
    docs = docs.drop("mix_pass", "mix_order")
    chosen = plan(docs, o).where("passes > 0").select(F.col("source").alias("__source"), F.col("block").alias("__of"), F.col("passes").alias("__passes"))
    chosen = stage(chosen, "plan")
    if chosen.count() <= o.sent:
        chosen = F.broadcast(chosen)
    keyed = docs.withColumn("__block", _block(o))
    joined = keyed.join(chosen, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__of")))
    drawn = joined.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("__passes") - 1)))
    drawn = drawn.withColumn("mix_order", F.xxhash64("source", "__block", F.col("mix_pass").cast("long"), F.lit(o.seed)))
    return drawn.drop("__source", "__block", "__of", "__passes")
