"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import cut


def _marks(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b), two long ids -> (node, root): root is the smallest id that node can reach.

    Self links and null ids are dropped; a node without a link to another has no row. Both steps
    keep a row per node at most on one side of their joins, so a hub with very many links is a
    skewed join and never one group in one task. The number of rounds grows as the logarithm of
    the longest chain. Every round is written to the checkpoint folder.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _marks(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the edges of a hub can be split in the join
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _marks(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
