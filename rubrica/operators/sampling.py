"""Samples for audit and review. Random order is the order of a keyed hash, so it repeats anywhere.

Every selection ranks only within a score; ranks that can pass a quota are cut before the shuffle by
Spark's group limit, so a score with very many rows costs its quota and not itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.functions.text import review_id

#: Rows of each score in the two review samples, and candidates that the first reserves.
DEVELOPMENT = {0: 15, 1: 20, 2: 24, 3: 1}
RESERVE = {0: 1, 1: 1, 2: 4, 3: 1}
HOLDOUT = {0: 18, 1: 20, 2: 21, 3: 1}


class QuotaError(ValueError):
    """There are fewer rows than a quota asks for, or more than a sample may hold."""


def hashed(*parts: Column | str | int) -> Column:
    columns = [F.lit(str(p)) if isinstance(p, int) else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *columns), 256)


def _quota(quotas: Mapping[int, int], score: str = "score") -> Column:
    """The quota of a row's score; null for a score without one."""
    return F.get(F.array(*[F.lit(quotas.get(k)).cast("int") for k in range(max(quotas) + 1)]), F.col(score).cast("int"))


def _first(df: DataFrame, n: Column, *order: Column, most: int) -> DataFrame:
    """The first n rows of each score in an order; `most` bounds n and lets the plan cut early."""
    w = Window.partitionBy("score").orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).where(F.col("__r") <= n).drop("__r")


def targeted(df: DataFrame, id_col: str, *, low: Column, conflict: Column, strict: Column) -> DataFrame:
    """(id, score, reasons): rows with at least one reason to be audited, reasons sorted."""
    named = (("low_confidence", low), ("rule_model_threshold_conflict", conflict), ("strict_score3", strict))
    reasons = F.array_compact(F.array(*[F.when(c, n) for n, c in named]))
    return df.select(id_col, "score", reasons.alias("reasons")).where(F.size("reasons") > 0)


def round_robin(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """(id, score) of `size` rows, one of each score in turn, each score in random order.

    The first `size` of every score are enough; the merge of the few that are left is a top-k.
    """
    w = Window.partitionBy("score").orderBy(hashed(seed, F.col("score"), F.col(id_col)), id_col)
    ranked = df.select(id_col, "score").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= max(size, 0))
    return ranked.orderBy("turn", "score").limit(max(size, 0)).select(id_col, "score")


def audit_sample(df: DataFrame, id_col: str, size: int, seed: int, *, low: Column, conflict: Column, strict: Column) -> DataFrame:
    """(id, score, selection_reason): all targeted rows, filled up in turn to `size`."""
    hit = targeted(df, id_col, low=low, conflict=conflict, strict=strict)
    if (n := hit.limit(size + 1).count()) > size:
        raise QuotaError(f"over {size} rows are targeted")
    fill = round_robin(df.join(hit.select(id_col), id_col, "left_anti"), id_col, size - n, seed)
    both = hit.unionByName(fill.withColumn("reasons", F.array(F.lit("stratified_fill"))))
    return both.select(id_col, "score", F.array_join(F.array_sort("reasons"), "|").alias("selection_reason"))


def reason_counts(sample: DataFrame) -> DataFrame:
    """One row: sampled, targeted, and how many rows each reason has."""
    reasons = F.split("selection_reason", r"\|")
    named = ("low_confidence", "rule_model_threshold_conflict", "strict_score3", "stratified_fill")
    return sample.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("selection_reason") != "stratified_fill").alias("targeted"), *[F.count_if(F.array_contains(reasons, n)).alias(n) for n in named])


def development(df: DataFrame, id_col: str, seed: int, quotas: Mapping[int, int] = DEVELOPMENT, reserve: Mapping[int, int] = RESERVE) -> DataFrame:
    """Rows of df: per score some candidates first, then by falling risk; ties by a keyed hash.

    df has score, risk_points and the flag candidate.
    """
    order = (F.desc("risk_points"), hashed(seed, "development", F.col(id_col)), F.col(id_col))
    top = max(quotas.values())
    first = _first(df.where("candidate"), F.least(_quota(reserve), _quota(quotas)), *order, most=top)
    rest = df.join(first.select(id_col), id_col, "left_anti")
    held = first.groupBy("score").agg(F.count(F.lit(1)).alias("__held"))
    rest = _first(rest, F.lit(top), *order, most=top).join(F.broadcast(held), "score", "left")
    rest = _first(rest, _quota(quotas) - F.coalesce("__held", F.lit(0)), *order, most=top).drop("__held")
    return first.unionByName(rest)


def holdout(df: DataFrame, excluded: DataFrame, id_col: str, seed: int, quotas: Mapping[int, int] = HOLDOUT) -> DataFrame:
    """Rows of df outside `excluded`: per score up to half candidates, then others, then what is left."""
    pool = df.join(excluded.select(id_col), id_col, "left_anti")
    order = lambda k: (hashed(seed, k, F.col("score"), F.col(id_col)), F.col(id_col))
    top, quota = max(quotas.values()), _quota(quotas)
    first = _first(pool.where("candidate"), F.greatest(F.lit(1), F.floor(quota / 2).cast("int")), *order(1), most=top)
    first = first.where(_quota(quotas) > 0)
    held = F.broadcast(first.groupBy("score").agg(F.count(F.lit(1)).alias("__held")))
    need = quota - F.coalesce("__held", F.lit(0))
    second = _first(_first(pool.where(~F.col("candidate")), F.lit(top), *order(2), most=top).join(held, "score", "left"), need, *order(2), most=top).drop("__held")
    chosen = first.unionByName(second)
    held = F.broadcast(chosen.groupBy("score").agg(F.count(F.lit(1)).alias("__held")))
    left = _first(pool.join(chosen.select(id_col), id_col, "left_anti"), F.lit(top), *order(3), most=top).join(held, "score", "left")
    return chosen.unionByName(_first(left, need, *order(3), most=top).drop("__held"))


def require_quotas(sample: DataFrame, quotas: Mapping[int, int], name: str) -> DataFrame:
    got = {r["score"]: r["n"] for r in sample.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    if short := {k: got.get(k, 0) for k, v in quotas.items() if got.get(k, 0) != v}:
        raise QuotaError(f"{name} quotas are not filled: {short} of {dict(quotas)}")
    return sample


def review_splits(df: DataFrame, id_col: str, seed: int, *, version: str, strict: bool = True) -> DataFrame:
    """Both samples with split and review_id; they share no row."""
    dev = development(df, id_col, seed)
    held = holdout(df, dev, id_col, seed)
    if strict:
        require_quotas(dev, DEVELOPMENT, "development")
        require_quotas(held, HOLDOUT, "holdout")
    both = dev.withColumn("split", F.lit("development")).unionByName(held.withColumn("split", F.lit("holdout")))
    return both.withColumn("review_id", review_id(version, seed, "split", id_col))


INPUTS = ("human_score", "technology_role", "strict_ai", "human_confidence", "human_evidence", "human_note")


def blind(sample: DataFrame, shown: list[str], seed: int) -> DataFrame:
    """review_id, the texts to be judged and blank inputs, with a random position; nothing else."""
    place = hashed(seed, "order", F.col("review_id")).alias("position")
    return sample.select("review_id", *shown, *[F.lit("").alias(c) for c in INPUTS], place).orderBy("position").drop("position")


def blind_leaks(sheet: DataFrame, forbidden: set[str], rows: int) -> list[str]:
    """What is wrong with a blind sheet: hidden columns, a wrong row count, inputs that aren't blank."""
    found = [f"column {c}" for c in sheet.columns if c in forbidden]
    filled = F.lit(False)
    for c in INPUTS:
        filled = filled | (F.coalesce(F.trim(c), F.lit("")) != "")
    n, bad = sheet.agg(F.count(F.lit(1)), F.count_if(filled)).first()
    return found + ([f"{n} rows instead of {rows}"] if n != rows else []) + ([f"{bad} rows with inputs"] if bad else [])
