"""The second reading of a sample: disagreements are adjudicated, and adjudications take effect."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.operators.agreement import agreement
from rubrica.operators.sampling import audit_sample
from rubrica.sources.settle import settled

LABEL_COLUMNS = ("score", "evidence", "reason", "confidence", "label_status")


def comparison(sample: DataFrame, audit: DataFrame, id_col: str) -> DataFrame:
    """sample (primary_*) beside the blind audit (audit_*), with `disagrees`."""
    return sample.join(audit, id_col).withColumn("disagrees", F.col("primary_score") != F.col("audit_score"))


def adjudication_context(compared: DataFrame, id_col: str) -> DataFrame:
    """(id, context): for each disagreement both readings as one JSON text."""
    side = lambda name: F.struct(F.col(f"{name}_score").alias("score"), F.filter(F.split(F.coalesce(f"{name}_evidence", F.lit("")), r"\|"), lambda x: x != "").alias("evidence"), F.col(f"{name}_reason").alias("reason"), F.col(f"{name}_confidence").alias("confidence"))
    return compared.where("disagrees").select(id_col, F.to_json(F.struct(side("primary").alias("primary"), side("audit").alias("audit"))).alias("context"))


def apply_adjudications(labels: DataFrame, adjudicated: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """labels with `columns` of adjudicated rows in place of their own, all of them or none.

    primary_score keeps the score of before.
    """
    new = adjudicated.select(id_col, F.struct(*columns).alias("__new"))
    joined = labels.join(new, id_col, "left").withColumn("primary_score", F.col("score"))
    taken = {c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(taken).drop("__new")


def reliability(labels: DataFrame, id_col: str, seed: int, size: int, audit: Callable[[DataFrame], DataFrame], adjudicate: Callable[[DataFrame], DataFrame], *, low: Column, conflict: Column, strict: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels with adjudications applied, the compared sample, metrics of one row). The callables may
    run jobs on what they get, so the sample is drawn once for each of them.

    audit labels the ids of the sample without seeing the first labels; adjudicate gets (id, context)
    of the disagreements alone. Both give LABEL_COLUMNS.
    """
    sample = settled(audit_sample(labels, id_col, size, seed, low=low, conflict=conflict, strict=strict))
    named = lambda df, name: df.select(id_col, *[F.col(c).alias(f"{name}_{c}") for c in LABEL_COLUMNS if c != "label_status"])
    first = sample.select(id_col, "selection_reason").join(named(labels, "primary"), id_col)
    compared = settled(comparison(first, named(audit(sample.select(id_col)), "audit"), id_col))
    decided = adjudicate(adjudication_context(compared, id_col))
    return apply_adjudications(labels, decided, id_col, LABEL_COLUMNS), compared, agreement(compared, "primary_score", "audit_score")
