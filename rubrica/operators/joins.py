"""Joins with a declared cardinality, and comparisons of key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A side of a join has a key more than once that it may have once."""


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner", cardinality: str = "1:1", *, shown: int = 5) -> DataFrame:
    """left joined to right, after a check that the sides named 1 have each key once.

    cardinality: '1:1', 'm:1' (right once), '1:m' (left once) or 'm:m' (no check). A check is one
    aggregation of the keys, which the join's own exchange of them cannot be shared with; it ends at
    the first repeated keys that are found.
    """
    on = [on] if isinstance(on, str) else list(on)
    sides = {"1:1": (left, right), "m:1": (right,), "1:m": (left,), "m:m": ()}[cardinality]
    for side in sides:
        if bad := repeated_keys(side, on).limit(shown).collect():
            raise CardinalityError(f"{how} join on {on} is not {cardinality}: " + ", ".join(str(tuple(r[k] for k in on)) for r in bad))
    return left.join(right, on, how)


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side alone has, with `side`; empty if the sets are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def selected(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def remaining(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def align(runs: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """key, value_1, value_2, ... of runs with the same keys: one shuffle, whatever their number."""
    tall = None
    for n, run in enumerate(runs, 1):
        part = run.select(key, F.lit(n).alias("run"), F.col(value).alias("v"))
        tall = part if tall is None else tall.unionByName(part)
    wide = tall.groupBy(key).agg(*[F.max(F.when(F.col("run") == n, F.col("v"))).alias(f"{value}_{n}") for n in range(1, len(runs) + 1)], F.count(F.lit(1)).alias("__n"))
    return wide.where(F.col("__n") == len(runs)).drop("__n")
