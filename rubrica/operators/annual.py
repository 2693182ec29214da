"""Yearly shares of scores with Wilson bounds, and their changes between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions.scoring import crosses, wilson


def summary(scored: DataFrame, year: str = "year", score: str = "score") -> DataFrame:
    """Per year: n_ads, n_score_ge_2, the shares of scores >= 2, >= 1 and = 3, and bounds of the first.

    One aggregation. Rows without a score aren't in any share; n_unlabelled says how many those are.
    """
    s = F.col(score)
    share = lambda c: F.avg(c.cast("double"))
    made = scored.groupBy(F.col(year).cast("int").alias("year")).agg(
        F.count(s).alias("n_ads"), F.count_if(s >= 2).alias("n_score_ge_2"), share(s >= 2).alias("share_score_ge_2"),
        share(s >= 1).alias("share_score_ge_1"), share(s == 3).alias("share_score_eq_3"), F.count_if(s.isNull()).alias("n_unlabelled"))
    low, high = wilson("n_score_ge_2", "n_ads")
    return made.select("year", "n_ads", "n_score_ge_2", "share_score_ge_2", low.alias("wilson_low"), high.alias("wilson_high"), "share_score_ge_1", "share_score_eq_3", "n_unlabelled")


def chart_data(annual: DataFrame) -> DataFrame:
    """What a chart with error bars needs: the share and how far it reaches down and up."""
    return annual.select("year", F.col("share_score_ge_2").alias("share"), (F.col("share_score_ge_2") - F.col("wilson_low")).alias("down"), (F.col("wilson_high") - F.col("share_score_ge_2")).alias("up"), F.col("n_ads").alias("n"))


def item_changes(items: DataFrame, old: str, new: str, id_col: str) -> DataFrame:
    """(id, from_score, to_score, delta, score_changed, crossed_main_threshold) per item."""
    a, b = F.col(old), F.col(new)
    return items.select(id_col, a.alias("from_score"), b.alias("to_score"), (b - a).alias("delta_score"), (a != b).alias("score_changed"), crosses(a, b).alias("crossed_main_threshold"))


SHARES = ("share_score_ge_2", "share_score_ge_1", "share_score_eq_3")


def annual_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per year of both: from_*, to_* and delta_* of the shares."""
    a = old.select("year", *[F.col(c).alias(f"from_{c}") for c in SHARES])
    b = new.select("year", *[F.col(c).alias(f"to_{c}") for c in SHARES])
    return a.join(b, "year").withColumns({f"delta_{c}": F.col(f"to_{c}") - F.col(f"from_{c}") for c in SHARES})


def change_summary(changes: DataFrame, annual: DataFrame) -> DataFrame:
    """One row: n_items, changed, crossed, max_abs_annual_delta."""
    items = changes.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("score_changed").alias("changed"), F.count_if("crossed_main_threshold").alias("crossed"))
    return items.crossJoin(F.broadcast(annual.agg(F.max(F.abs("delta_share_score_ge_2")).alias("max_abs_annual_delta"))))
