"""Label and name predicates as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matcher(label: str, op: str, value: str, labels: str = "labels") -> Column:
    """= and =~ need the label; a missing label passes != but not !~. Patterns are anchored at the start only."""
    got = F.col(labels)[label]
    if op == "=":
        return F.coalesce(got == value, F.lit(False))
    if op == "!=":
        return F.coalesce(got != value, F.lit(True))
    re.compile(value)  # a bad pattern fails here
    found = got.rlike(f"^(?:{value})")
    if op == "=~":
        return F.coalesce(found, F.lit(False))
    if op == "!~":
        return got.isNotNull() & ~found
    raise ValueError(f"unknown matcher {op}")


def all_of(*matchers: tuple[str, str, str]) -> Column:
    return reduce(lambda a, b: a & b, [matcher(*m) for m in matchers], F.lit(True))


def selector(wanted: dict[str, str], labels: str = "labels") -> Column:
    """Every label present; '' and * take any value."""
    terms = [F.map_contains_key(labels, k) if v in ("", "*") else F.coalesce(F.col(labels)[k] == v, F.lit(False)) for k, v in wanted.items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def metric_is(name: str) -> Column:
    return F.col("metric") == name


def metric_starts(name: str) -> Column:
    return F.col("series_key").startswith(name)


def metric_with_label(base: str, label: str, value: str) -> Column:
    """The name:label=value form: a prefix of the name and one label."""
    return metric_starts(base) & matcher(label, "=", value)


def keep_labels(*names: str) -> Column:
    return F.map_filter("labels", lambda k, _: k.isin(*names))


def drop_labels(*names: str) -> Column:
    return F.map_filter("labels", lambda k, _: ~k.isin(*names))
