"""Element-wise functions of a value column, with IEEE results instead of NULL or errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _nan() -> Column:
    return F.lit(float("nan"))


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def round_even(x: Column, digits: int = 0) -> Column:
    """To tens for digits above 0; halves go to the even neighbour."""
    return F.bround(x / 10.0**digits) * 10.0**digits


def sqrt(x: Column) -> Column:
    return F.when(F.isnan(x), _nan()).when(x > 0, F.sqrt(x)).otherwise(0.0)


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(_nan())


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).otherwise(_nan())


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).otherwise(_nan())


def clamp_max(x: Column, most: float = 0.0) -> Column:
    return F.when(x > most, most).otherwise(x)


def clamp_min(x: Column, least: float = 0.0) -> Column:
    return F.when(x < least, least).otherwise(x)


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).when(F.isnan(a) | (a == 0), _nan()).otherwise(F.when(a > 0, INF).otherwise(-INF))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_mod(a, b)).otherwise(_nan())


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": F.pow}
COMPARISON = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
