"""Dates in mixed formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd")


def parse_date(x: Column | str, formats: Sequence[str] = FORMATS) -> Column:
    """A timestamp by the first format that fits, null if none does."""
    x = F.trim(F.col(x) if isinstance(x, str) else x)
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])


def iso_date(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def require_dates(df: DataFrame, raw: str, id_col: str, formats: Sequence[str] = FORMATS, shown: int = 5) -> DataFrame:
    """df, if every value of `raw` is a date; else an error that names some rows."""
    bad = df.where(parse_date(raw, formats).isNull()).select(id_col, raw).limit(shown).collect()
    if bad:
        raise ValueError("dates that cannot be parsed: " + ", ".join(f"{r[0]}={r[1]!r}" for r in bad))
    return df
