"""Declarative data-quality rules: each gives a name and a number of violations, and one error tells all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.scoring import BOUNDARIES, CONFIDENCES, ROLES, TECHNICAL_TITLE, derive_score
from rubrica.functions.text import one_of, title_line

LONGEST_REASON, MOST_EVIDENCE = 240, 5


class QualityError(ValueError):
    """Some rules have violations; the message names each."""


def require_columns(df: DataFrame, columns: Sequence[str], label: str, *, exact: bool = False) -> DataFrame:
    """df, if it has these columns (exact: these alone and in this order). No job is run."""
    missing = [c for c in columns if c not in df.columns]
    if missing or exact and list(columns) != df.columns:
        raise QualityError(f"{label}: columns {missing or df.columns} are {'missing' if missing else 'not ' + str(list(columns))}")
    return df


def row_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check, violations): how many rows each condition (which says what is wrong) holds for; one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)])).alias("c")).select("c.*")


def unique_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("v")).select(F.lit(name).alias("check"), F.col("v").alias("violations"))


def row_count(df: DataFrame, expected: int, name: str) -> DataFrame:
    return df.agg(F.abs(F.count(F.lit(1)) - F.lit(expected)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def same_values(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, tolerance: float = 1e-12) -> DataFrame:
    """Violations: keys of one side alone, and keys whose values differ by more than the tolerance."""
    a, b = left.select(*keys, F.struct(*values).alias("a")), right.select(*keys, F.struct(*values).alias("b"))
    differ = F.lit(False)
    for v in values:
        x, y = F.col(f"a.{v}"), F.col(f"b.{v}")
        differ = differ | ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
    wrong = F.col("a").isNull() | F.col("b").isNull() | differ
    return a.join(b, list(keys), "full").agg(F.count_if(wrong).alias("violations")).select(F.lit(name).alias("check"), "violations")


def disjoint(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    return left.select(key).intersect(right.select(key)).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def union(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """One error that names every rule with violations; the table has a row per rule."""
    if bad := checks.where("violations > 0").orderBy("check").collect():
        raise QualityError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def label_rules(source: str | None = None, title_prefix: str = "") -> dict[str, Column]:
    """What can be wrong with a label (score, technology_role, strict_ai, boundary_pair, confidence,
    reason, evidence array), and with its evidence against the source text, if one is named."""
    score, evidence = F.col("score"), F.col("evidence")
    rules = {
        "score_range": ~F.coalesce(score.between(0, 3), F.lit(False)),
        "role_domain": ~one_of("technology_role", ROLES),
        "boundary_domain": ~one_of("boundary_pair", BOUNDARIES),
        "confidence_domain": ~one_of("confidence", CONFIDENCES),
        "reason_length": ~F.coalesce(F.length("reason").between(2, LONGEST_REASON), F.lit(False)),
        "evidence_count": F.size(evidence) > MOST_EVIDENCE,
        "evidence_blank": F.exists(evidence, lambda x: F.trim(x) == ""),
        "score_mapping": ~F.coalesce(derive_score("technology_role", "strict_ai") == score, F.lit(False)),
        "positive_without_evidence": (score > 0) & (F.size(evidence) == 0),
    }
    if source:
        text = F.col(source)
        title = title_line(text, title_prefix)
        rules["evidence_outside_source"] = F.exists(evidence, lambda x: ~F.contains(text, x))
        rules["generic_title_alone"] = (score > 0) & (F.size(evidence) == 1) & (F.get(evidence, F.lit(0)) == title) & ~title.rlike(f"(?i){TECHNICAL_TITLE}")
    return rules


def calibrated_confidence() -> Column:
    """A positive score on less than two pieces of evidence is not of high confidence."""
    thin = (F.col("score") > 0) & (F.size("evidence") < 2) & (F.col("confidence") == "high")
    return F.when(thin, "medium").otherwise(F.col("confidence"))


#: Fixed value: what a key of a model service looks like.
SECRET = r"sk-[A-Za-z0-9]{20,}"


def blank_counts(df: DataFrame) -> DataFrame:
    """(check, violations): blank or null values of each column."""
    return row_rules(df, {f"blank_{c}": F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in df.columns})


def provenance(rules: DataFrame, columns: Sequence[str] = ("reviewer", "reviewed_at", "review_basis")) -> DataFrame:
    """Rules that don't say who reviewed them, when and on what ground."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return row_rules(rules, {"rule_provenance": missing})


def complete_mapping(ids: DataFrame, mapping: DataFrame, key: str, name: str) -> DataFrame:
    """Violations: ids without a mapping, mappings without an id, and keys that are mapped twice."""
    once = mapping.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    wrong = F.col("here").isNull() | F.col("n").isNull() | (F.col("n") > 1)
    joined = ids.select(key).distinct().withColumn("here", F.lit(1)).join(once, key, "full")
    return joined.agg(F.count_if(wrong).alias("violations")).select(F.lit(name).alias("check"), "violations")


def one_value(df: DataFrame, column: str, name: str) -> DataFrame:
    """Violations: how many values a column has beyond one (runs that must share a fingerprint)."""
    return df.agg(F.greatest(F.count_distinct(column) - 1, F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def required_files(listing: DataFrame, names: Sequence[str]) -> DataFrame:
    """Violations: files of these names that a listing (path) lacks, a row for each name."""
    wanted = listing.sparkSession.createDataFrame([(n,) for n in names], "name string")
    there = listing.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name")).distinct().withColumn("there", F.lit(1))
    return wanted.join(there, "name", "left").select(F.concat(F.lit("file_"), "name").alias("check"), F.when(F.col("there").isNull(), 1).otherwise(0).cast("bigint").alias("violations"))
