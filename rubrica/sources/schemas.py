"""Schemas of the engine's tables. Nothing is inferred: text stays text until it is cast."""

from __future__ import annotations

from pyspark.sql import types as T

AD_FIELDS = ("公司名称", "关联公司名称", "岗位", "岗位描述", "岗位标签", "待遇", "学历", "所在城市", "发布时间")
TAG_FIELDS = ("岗位标签",)
FIRM_FIELDS = ("股票代码", "证券简称", "公司全称", "证监会行业")


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _struct(text: str) -> T.StructType:
    """'a string, b int' as a schema; needs no session."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


ADS_RAW = text_schema("id", *AD_FIELDS)
FIRMS = text_schema(*FIRM_FIELDS)
ALIAS_RULES = text_schema("pattern", "stock_code", "match_method", "match_note", "reviewer", "reviewed_at", "review_basis")
#: A label as it is kept; older versions lack some of the columns, which are then null.
LABEL_CACHE = _struct(
    "canonical_id string, technology_role string, strict_ai boolean, score int, boundary_pair string, evidence string, reason string, "
    "confidence string, model_score int, request_id string, model string, prompt_version string, schema_version string, prompt_fingerprint string, "
    "stage string, thinking boolean, content_hash string, label_status string, input_tokens bigint, output_tokens bigint")
#: What a model answers.
RESPONSE = T.ArrayType(_struct(
    "canonical_id string, technology_role string, strict_ai boolean, score int, boundary_pair string, evidence array<string>, reason string, confidence string"))
RESPONSE_KEYS = tuple(f.name for f in RESPONSE.elementType.fields)
ANNUAL = _struct("year int, n_ads bigint, n_score_ge_2 bigint, share_score_ge_2 double, wilson_low double, wilson_high double, share_score_ge_1 double, share_score_eq_3 double")
