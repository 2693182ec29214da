"""Exact duplicates of records: one canonical row a group, and the lineage of all others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digest(keys: Sequence[str]) -> tuple:
    """128 bits that equal key values share (null equals null): what groups when the values themselves
    need not travel."""
    parts = [*[F.col(k).isNull() for k in keys], *[F.col(k) for k in keys]]
    return F.xxhash64(*parts).alias("__a"), F.xxhash64(F.lit(7), *parts).alias("__b")


#: Ids that one row of canonical() lists at most; the lineage table has those of larger groups.
MOST_IDS = 100_000


def canonical(df: DataFrame, keys: Sequence[str], id_col: str, order: str | None = None, *, most_ids: int = MOST_IDS) -> DataFrame:
    """A row per group of equal keys (null equals null): the first by `order` (the id, if none given).

    Adds canonical_id, source_ids (all ids in that order) and duplicate_group_size. Groups are summed
    by a digest of their keys; ids are gathered for groups of two to `most_ids` rows alone, so that no
    row grows with a very large group: its source_ids is null, and `lineage` lists them.
    """
    order = order or id_col
    rows = df.withColumns(dict(zip(("__a", "__b"), _digest(keys), strict=True)))
    groups = rows.groupBy("__a", "__b").agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("__first"), F.count(F.lit(1)).alias("duplicate_group_size"))
    several = groups.where(F.col("duplicate_group_size").between(2, most_ids)).select("__a", "__b")
    entry = F.struct(F.col(order).alias("o"), F.col(id_col).alias("i"))
    ids = rows.select("__a", "__b", entry.alias("e")).join(several, ["__a", "__b"], "left_semi").groupBy("__a", "__b").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x.i).alias("__ids"))
    made = groups.join(ids, ["__a", "__b"], "left")
    listed = F.when(F.col("duplicate_group_size") == 1, F.array(f"__first.{id_col}")).otherwise(F.col("__ids"))
    return made.select(F.col(f"__first.{id_col}").alias("canonical_id"), listed.alias("source_ids"), "duplicate_group_size", *[F.col(f"__first.{c}").alias(c) for c in df.columns if c != id_col])


def lineage(df: DataFrame, keys: Sequence[str], id_col: str, order: str | None = None) -> DataFrame:
    """(source_id, canonical_id, is_duplicate) for every row.

    Groups are summed first and joined back by a digest of their keys, so that texts don't travel
    and a very large group is a skewed join and not a window in one task.
    """
    order = order or id_col
    rows = df.select(F.col(id_col).alias("source_id"), F.col(order).alias("__order"), *_digest(keys))
    groups = rows.groupBy("__a", "__b").agg(F.min_by("source_id", "__order").alias("canonical_id"))
    return rows.join(groups, ["__a", "__b"]).select("source_id", "canonical_id", (F.col("source_id") != F.col("canonical_id")).alias("is_duplicate"))


def stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: raw, canonical, removed, duplicate_groups."""
    sizes = df.select(*_digest(keys)).groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return sizes.agg(
        F.coalesce(F.sum("n"), zero).alias("raw"), F.count(F.lit(1)).alias("canonical"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("removed"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
