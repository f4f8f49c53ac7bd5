"""Where keys go: hash shards, key ranges, and a hash ring. Spark moves the data; these give the keys to move it by."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = 2**32


def key_hash(key: Column) -> Column:
    """The first four bytes of the key's MD5 as an unsigned number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def shard_key() -> Column:
    """metric|a=x|b=y, labels by name."""
    parts = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("|", F.concat(F.array("metric"), parts))


def shard_by_hash(h: Column, n: int = 256) -> Column:
    return F.concat(F.lit("shard_"), F.lpad((h % n).cast("string"), 4, "0"))


def shard_by_range(h: Column, n: int) -> Column:
    return F.concat(F.lit("shard_"), F.lpad((F.floor(h / (SPACE // n)) % n).cast("string"), 4, "0"))


def shards_in(low: int, high: int, n: int) -> list[int]:
    """Range shards that overlap [low, high]."""
    size = SPACE // n
    return [i for i in range(n) if i * size <= high and low < (i + 1) * size]


def round_robin(df: DataFrame, n: int, order: str) -> DataFrame:
    """shard = place in order modulo n, by ranks within ranges and the sizes of the ranges before: no sort in one task."""
    parts = df.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    sizes = parts.groupBy("__part").agg(F.count("*").alias("size"))
    before = sizes.select("__part", F.coalesce(F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return parts.join(F.broadcast(before), "__part").withColumn("shard", ((place + F.col("before")) % n).cast("int")).drop("__part", "before")


def ring(nodes: list[str], points: int = 150) -> list[tuple[int, str]]:
    """The ring's places in order: each node at the hashes of node:0, node:1, ..."""
    return sorted((int(hashlib.md5(f"{n}:{i}".encode()).hexdigest()[:8], 16), n) for n in nodes for i in range(points))


def _constant(values: list, kind: str) -> Column:
    """An array as a constant: one expression, however many values."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _search(h: Column, places: list[tuple[int, str]], then: Callable[[Column], Column], inclusive: bool = False) -> Column:
    """then(i) for i, the first place after h (at it too, if inclusive) around the end, place 0 for a null h.

    A binary search, so a key takes as many steps as the number of places has bits; h is worked out once, not at each step.
    """
    at, steps = _constant([p for p, _ in places], "bigint"), [1 << i for i in reversed(range(len(places).bit_length()))]

    def passed(x: Column) -> Column:
        # beyond the end is null, and the step is not taken
        over = lambda p: p < x if inclusive else p <= x
        return F.aggregate(_constant(steps, "int"), F.lit(0), lambda low, s: F.when(over(F.get(at, low + s - F.lit(1))), low + s).otherwise(low))

    return F.get(F.transform(F.array(h), lambda x: then(passed(x) % len(places))), F.lit(0))


def owner(h: Column, places: list[tuple[int, str]], inclusive: bool = False) -> Column:
    """The node at the first place after h (at it too, if inclusive), around the end; of a null h, at the first place."""
    return _search(h, places, lambda i: F.get(_constant([x for _, x in places], "string"), i), inclusive)


def successors(places: list[tuple[int, str]], n: int) -> list[list[str]]:
    """Of each place, the first n distinct nodes from it on, around the end."""
    lists: list[list[str]] = [[]] * len(places)
    after: list[str] = []
    for i in [*reversed(range(len(places)))] * 2:  # the first time round knows nothing of the start
        node = places[i][1]
        after = lists[i] = [node, *(x for x in after if x != node)][:n]
    return lists


def owners(h: Column, places: list[tuple[int, str]], n: int) -> Column:
    """The first n distinct nodes from h on; of a null h, from the first place on."""
    return _search(h, places, lambda i: F.get(_constant(successors(places, n), "array<string>"), i))


def replica_positions(df: DataFrame, h: Column, places: list[tuple[int, str]], n: int, spacing: int = 1000) -> DataFrame:
    """Row i of n: the owner of h + i * spacing around the space; nodes may repeat."""
    out = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("node", owner((h + F.col("replica") * spacing) % SPACE, places))


def balance(keys: DataFrame, node: str = "node") -> DataFrame:
    return keys.groupBy(node).agg(F.count("*").alias("n"))
