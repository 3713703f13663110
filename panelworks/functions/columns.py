"""Small column helpers."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def no(flag: Column) -> Column:
    """A flag that is false where it is unknown."""
    return F.coalesce(flag, F.lit(False))


def lookup(values: dict, key: Column) -> Column:
    """The value of a key, null for an unknown one."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def printed(xs: Column, digits: int) -> Column:
    """Doubles of an array as C's printf writes them: halves by the exact binary value, where Java goes by the shortest decimal."""

    def write(xs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [None if v is None else f"{v:.{digits}f}" for v in x] for x in xs.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(write, "array<string>")(xs.cast("array<double>"))


def per(*keys: str, by: list[str] | None = None):
    """A window over ``keys`` in the order ``by``, each row with those before it."""
    window = W.partitionBy(*keys)
    return window.orderBy(*by) if by else window


BY_INDEX = ["month_index", "row_id"]
BY_MONTH = ["reporting_month", "row_id"]
