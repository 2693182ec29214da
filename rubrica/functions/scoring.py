"""Ordinal scores, their errors, intervals and costs, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dictionary's patterns by score; the highest score with a hit wins.
TIERS: Mapping[int, str] = {
    3: r"人工智能|机器学习|深度学习|神经网络|自然语言|\bnlp\b|计算机视觉|图像识别|大模型|\bllm\b|生成式ai",
    2: r"软件开发|程序开发|系统架构|java|c\+\+|python|\bsql\b|大数据工程|数据工程|数据平台|数据科学|数据挖掘|嵌入式|fpga|云平台|网络安全|运维工程|自动化|机器人|物联网",
    1: r"数字化|信息化|数据分析|数据统计|erp|mes|sap|数据库|系统维护|系统录入|办公软件",
}
#: Titles that can carry a positive score by themselves.
TECHNICAL_TITLE = "AI|人工智能|机器学习|深度学习|算法|软件|数据|系统|网络|信息|自动化|电控|嵌入式|芯片|FPGA|运维|开发|编程|计算机视觉|NLP|LLM"
ROLES = ("none", "auxiliary", "core")
BOUNDARIES = ("none", "0_vs_1", "1_vs_2", "2_vs_3")
CONFIDENCES = ("high", "medium", "low")
MAIN_THRESHOLD = 2


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dictionary_hits(text: Column | str, tiers: Mapping[int, str] = TIERS, most: int = 5) -> Column:
    """struct(score, hits): the highest tier with a hit and its distinct hits in order of appearance."""
    lowered = F.lower(_col(text))
    found = F.lit(None).cast("struct<score:int,hits:array<string>>")
    for score in sorted(tiers):
        hits = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?U){tiers[score]}"), F.lit(0)))
        found = F.when(F.size(hits) > 0, F.struct(F.lit(score).alias("score"), F.slice(hits, 1, most).alias("hits"))).otherwise(found)
    return F.coalesce(found, F.struct(F.lit(0).alias("score"), F.array().cast("array<string>").alias("hits")))


def derive_score(role: Column | str, strict: Column | str) -> Column:
    """0 none, 1 auxiliary, 2 core, 3 strict core; null for any other combination."""
    role, strict = _col(role), F.coalesce(_col(strict), F.lit(False))
    return F.when(role == "core", F.when(strict, 3).otherwise(2)).when(~strict & (role == "none"), 0).when(~strict & (role == "auxiliary"), 1)


def crosses(a: Column | str, b: Column | str, threshold: int = MAIN_THRESHOLD) -> Column:
    return (_col(a) >= threshold) != (_col(b) >= threshold)


def error_type(reference: Column | str, model: Column | str) -> Column:
    """The first that applies: a match, an error about a threshold, an error on one side of it."""
    r, m = _col(reference), _col(model)
    return (
        F.when(r == m, "match")
        .when((r < 2) & (m >= 2), "threshold_false_positive").when((r >= 2) & (m < 2), "threshold_false_negative")
        .when((r < 3) & (m == 3), "strict_ai_false_positive").when((r == 3) & (m < 3), "strict_ai_false_negative")
        .when(m > r, "within_threshold_over").otherwise("within_threshold_under"))


def wilson(hits: Column | str, total: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval, within 0 and 1; NaN where total is not positive."""
    k, n = _col(hits).cast("double"), F.when(_col(total) > 0, _col(total).cast("double"))
    p, nan = k / n, F.lit(float("nan"))
    base = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(nan), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(nan)


def token_cost(tokens_in: Column | str, tokens_out: Column | str, price_in: float = 3.0, price_out: float = 6.0) -> Column:
    """Prices are for a million tokens."""
    return F.round(_col(tokens_in) * price_in / 1e6 + _col(tokens_out) * price_out / 1e6, 6)


def risk_points(weights: Sequence[tuple[str, int]]) -> Column:
    """Sum of the weights of the flags that hold; null flags don't."""
    total = F.lit(0)
    for flag, points in weights:
        total = total + F.coalesce(F.col(flag).cast("int"), F.lit(0)) * points
    return total


#: How much each flag adds to the risk of a wrong score.
RISK = (
    ("audit_disagreement", 8), ("crossed_main_threshold", 7), ("rule_model_threshold_conflict", 6), ("low_confidence", 5),
    ("score_changed", 3), ("ai_algorithm_candidate", 2), ("middle_score", 1),
)
