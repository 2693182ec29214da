"""A label cache that is addressed by content: what is known is joined, the rest is left to do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: Sequence[str] | str, order: str) -> DataFrame:
    """The last record of each key in an append-only log. One aggregation; no group is sorted."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in others]).select(log.columns)


def probe(items: DataFrame, cache: DataFrame, keys: Sequence[str], expected: Mapping[str, object], valid: Column | None = None) -> DataFrame:
    """items with the cache's columns and `cache_state`: hit, stale or miss.

    A record is a hit if its keys (id and content hash, say) agree, every column in `expected` has
    that value and `valid` holds; a record of the same id that fails any of it is stale.
    """
    good = F.lit(True)
    for c, v in expected.items():
        good = good & F.col(c).eqNullSafe(F.lit(v))
    known = cache.withColumn("__good", F.coalesce(good & (valid if valid is not None else F.lit(True)), F.lit(False)))
    first, others = keys[0], [c for c in known.columns if c not in keys]
    known = known.select(*[F.col(k).alias(f"__{k}") for k in keys], *others)
    joined = items.join(known, items[first] == known[f"__{first}"], "left")
    same = F.col("__good")
    for k in keys[1:]:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    state = F.when(F.col(f"__{first}").isNull(), "miss").when(F.coalesce(same, F.lit(False)), "hit").otherwise("stale")
    return joined.withColumn("cache_state", state).drop("__good", *[f"__{k}" for k in keys])


def require_all_cached(probed: DataFrame) -> DataFrame:
    """Offline runs fail closed: every item has to be a hit."""
    if n := probed.where("cache_state <> 'hit'").count():
        raise ValueError(f"offline run: {n} items have no valid label")
    return probed


def state_counts(probed: DataFrame) -> DataFrame:
    return probed.groupBy("cache_state").agg(F.count(F.lit(1)).alias("n"))


def request_ids(items: DataFrame, fingerprint: str, id_col: str, order: str, size: int = 8) -> DataFrame:
    """items with batch and request_id: a keyed hash of the batch's ids in order.

    Batches are cut within ranges of the order, so the numbering needs no single sorted task: rows
    fall into slices by hash of the order's high part.
    """
    from pyspark.sql import Window

    sliced = items.withColumn("__slice", F.floor(F.col(order) / (size * 512)))
    w = Window.partitionBy("__slice").orderBy(order)
    numbered = sliced.withColumn("batch", F.concat_ws("-", "__slice", F.floor((F.row_number().over(w) - 1) / size)))
    ids = numbered.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(id_col).cast("string").alias("i")))).alias("ids"))
    named = ids.select("batch", F.sha2(F.concat_ws("\n", F.lit(fingerprint), F.transform("ids", lambda x: x.i)), 256).alias("request_id"))
    return numbered.drop("__slice").join(named, "batch")
