"""Agreement of two or more raters on an ordinal scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.operators.joins import align


def cells(df: DataFrame, a: str, b: str, categories: int = 4) -> DataFrame:
    """(a, b, n) for every pair of categories, with zeros: the only pass over the ratings."""
    grid = df.sparkSession.range(categories * categories).select((F.col("id") / categories).cast("int").alias("a"), (F.col("id") % categories).cast("int").alias("b"))
    counts = df.groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(F.broadcast(counts.where(F.col("a").between(0, categories - 1) & F.col("b").between(0, categories - 1))), ["a", "b"], "left").na.fill(0, ["n"])


def confusion(df: DataFrame, reference: str, model: str, categories: int = 4) -> DataFrame:
    """One row per reference category, with a column model_k for each model category."""
    made = cells(df, reference, model, categories)
    return made.groupBy(F.col("a").alias("reference")).agg(*[F.sum(F.when(F.col("b") == k, F.col("n")).otherwise(0)).alias(f"model_{k}") for k in range(categories)])


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, kappa): quadratic weights, from moments alone.

    The observed disagreement is the mean of (a - b)^2; the expected one follows from the margins'
    means and squares: E(a^2) + E(b^2) - 2 E(a) E(b). Without expected disagreement kappa is 1, and
    null without rows.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = df.agg(F.count(F.lit(1)).alias("n"), F.sum((x - y) * (x - y)).alias("d"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x + y * y).alias("s"))
    expected = F.col("s") - 2 * F.col("x") * F.col("y") / F.nullif("n", F.lit(0))
    return m.select("n", F.when(expected == 0, 1.0).otherwise(1 - F.col("d") / F.nullif(expected, F.lit(0.0))).alias("kappa"))


def agreement(df: DataFrame, a: str, b: str, threshold: int = 2) -> DataFrame:
    """One row: n, disagreements, exact, within_one, binary (same side of the threshold), kappa."""
    x, y = F.col(a), F.col(b)
    share = lambda c: F.avg(c.cast("double"))
    rates = df.agg(
        F.count_if(x != y).alias("disagreements"), share(x == y).alias("exact_agreement"), share(F.abs(x - y) <= 1).alias("within_one_agreement"),
        share((x >= threshold) == (y >= threshold)).alias("binary_agreement"))
    return weighted_kappa(df, a, b).crossJoin(F.broadcast(rates)).select("n", "disagreements", "exact_agreement", "within_one_agreement", "binary_agreement", F.col("kappa").alias("weighted_kappa"))


def per_class(df: DataFrame, reference: str, model: str, categories: int = 4) -> DataFrame:
    """(category, support, predicted, hits, precision, recall, f1); null where a denominator is 0."""
    made = cells(df, reference, model, categories)
    each = F.explode(F.array(F.struct(F.col("a").alias("category"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p")), F.struct(F.col("b").alias("category"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"))))
    hit = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    tall = made.select(each.alias("e"), hit.alias("h")).select("e.*", F.when(F.col("e.s") > 0, F.col("h")).otherwise(0).alias("h"))
    sums = tall.groupBy("category").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    precision, recall = F.try_divide("hits", "predicted"), F.try_divide("hits", "support")
    rated = sums.withColumns({"precision": precision, "recall": recall})
    return rated.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def stability(runs: Sequence[DataFrame], key: str, value: str, threshold: int = 2, gate: float = 0.95) -> DataFrame:
    """One row: n, exact_stability, threshold_stability, passed, over items that all runs have."""
    wide = align(runs, key, value)
    values = F.array(*[F.col(f"{value}_{i}") for i in range(1, len(runs) + 1)])
    same = lambda a: (F.size(F.array_distinct(a)) == 1).cast("double")
    made = wide.agg(F.count(F.lit(1)).alias("n"), F.avg(same(values)).alias("exact_stability"), F.avg(same(F.transform(values, lambda v: v >= threshold))).alias("threshold_stability"))
    return made.withColumn("passed", (F.col("exact_stability") >= gate) & (F.col("threshold_stability") >= gate))


def token_totals(df: DataFrame, request: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """One row: requests, input_tokens, output_tokens; a request's rows repeat its tokens, which count once."""
    once = df.groupBy(request).agg(F.max(tokens_in).alias("i"), F.max(tokens_out).alias("o"))
    zero = F.lit(0).cast("bigint")
    return once.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("i"), zero).alias("input_tokens"), F.coalesce(F.sum("o"), zero).alias("output_tokens"))


#: The least figures for a release.
GATES = {"exact_agreement": 0.85, "binary_agreement": 0.95, "weighted_kappa": 0.85}


def release_gates(metrics: DataFrame, gates=GATES, *, schema_valid: str | None = None) -> DataFrame:
    """metrics with a column per gate and `released`, which needs them all (and a true schema_valid, if named)."""
    made = metrics.withColumns({f"{k}_passed": F.coalesce(F.col(k) >= v, F.lit(False)) for k, v in gates.items()})
    passed = F.coalesce(F.col(schema_valid), F.lit(False)) if schema_valid else F.lit(True)
    for k in gates:
        passed = passed & F.col(f"{k}_passed")
    return made.withColumn("released", passed)


def strict_class(df: DataFrame, reference: str, model: str, top: int = 3) -> DataFrame:
    """One row: support, precision, recall and f1 of the top class against all others."""
    return per_class(df.select((F.col(reference) == top).cast("int").alias("r"), (F.col(model) == top).cast("int").alias("m")), "r", "m", 2).where("category = 1").drop("category")
