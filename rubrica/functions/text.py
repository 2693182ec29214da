"""Text normalisation and scalar functions, as Column expressions.

Regular expressions name their characters where Java, RE2 and Python differ about a class.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marker that scraped fields hold between tags, and what a company name ignores.
MARKER = r"<\$&\d+&\$>"
NAME_NOISE = r"[\s\-—_·•,，.。()（）/\\]+"
TICKER = r"^\d{6}\.(?:SZ|SH|BJ)$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfkc(x: Column | str) -> Column:
    """Unicode NFKC. Spark has no such function, so this crosses into Python; ASCII texts stay out of it."""
    x = _col(x)

    @F.pandas_udf(T.StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    ascii_only = F.length(x) == F.octet_length(x)
    return F.coalesce(normal(F.when(~ascii_only, x)), x)


def strip_markers(x: Column | str, *, tag_field: bool = False) -> Column:
    return F.regexp_replace(_col(x), MARKER, "; " if tag_field else " ")


def collapse_tags(x: Column | str) -> Column:
    """Runs of semicolons with spaces become '; ', and none is left at the ends."""
    return F.trim(F.regexp_replace(_col(x), r"(?U)(?:\s*;\s*)+", "; "), F.lit(" ;"))


def collapse_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(x), r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def clean_text(x: Column | str, *, tag_field: bool = False, unicode: bool = True) -> Column:
    """NFKC, markers out, white space collapsed; tag fields keep '; ' between tags. Null becomes ''."""
    x = F.coalesce(_col(x), F.lit(""))
    x = strip_markers(nfkc(x) if unicode else x, tag_field=tag_field)
    x = collapse_space(x)
    return collapse_tags(x) if tag_field else x


def company_key(x: Column | str, *, unicode: bool = True) -> Column:
    """The form under which company names are compared. Null becomes ''."""
    x = F.coalesce(_col(x), F.lit(""))
    return F.regexp_replace(F.lower(nfkc(x) if unicode else x), "(?U)" + NAME_NOISE, "")


def is_ticker(x: Column | str) -> Column:
    return _col(x).rlike(TICKER)


def labelled_text(fields: Mapping[str, Column | str]) -> Column:
    """'label：value' lines in the order given; null values are empty."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}："), F.coalesce(_col(c), F.lit(""))) for label, c in fields.items()])


def content_hash(text: Column | str, fingerprint: str | Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint, _col(text)), 256)


def review_id(version: str, seed: int, split: Column | str, item: Column | str) -> Column:
    """A blind id: the split's first letter and ten hex digits of a keyed hash."""
    split, item = _col(split), _col(item).cast("string")
    digest = F.sha2(F.concat_ws("|", F.lit(version), F.lit(str(seed)), split, item), 256)
    return F.concat(F.upper(F.substr(split, F.lit(1), F.lit(1))), F.lit("-"), F.upper(F.substr(digest, F.lit(1), F.lit(10))))


def is_true(x: Column | str) -> Column:
    """Lenient: true only for the word."""
    return F.coalesce(F.lower(F.trim(_col(x))) == "true", F.lit(False))


def strict_bool(x: Column | str) -> Column:
    """true, false, or null for anything else, so that checks can find it."""
    x = F.lower(F.trim(_col(x)))
    return F.when(x == "true", True).when(x == "false", False)


def matches(x: Column | str, pattern: str) -> Column:
    return F.coalesce(_col(x).rlike(f"(?i){pattern}"), F.lit(False))


def bigrams(x: Column | str) -> Column:
    """The set of pairs of neighbouring characters."""
    x = _col(x)
    return F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(2)))))


def shared_bigrams(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(bigrams(a), bigrams(b)))


def title_line(x: Column | str, prefix: str = "") -> Column:
    """The first line without a label before it."""
    line = F.substring_index(_col(x), "\n", 1)
    return F.trim(F.when(F.startswith(line, F.lit(prefix)), F.substr(line, F.lit(len(prefix) + 1))).otherwise(line) if prefix else line)


def join_list(x: Column | str) -> Column:
    return F.array_join(F.filter(_col(x), lambda v: v.isNotNull() & (v != "")), "|")


def split_list(x: Column | str) -> Column:
    return F.filter(F.split(_col(x), r"\|"), lambda v: v != "")


def to_long(x: Column | str) -> Column:
    """Whole numbers; what is none counts as 0."""
    return F.coalesce(_col(x).try_cast("bigint"), F.lit(0).cast("bigint"))


def one_of(x: Column | str, allowed: Sequence[str]) -> Column:
    return F.coalesce(_col(x).isin(*allowed), F.lit(False))


def version_label(version: str) -> str:
    """'2.1.0' -> 'v2_1', '2.0.0' -> 'v2', '10.0' -> 'v10': trailing zero parts go, digits stay."""
    parts = version.split(".")
    while len(parts) > 1 and set(parts[-1]) == {"0"}:
        parts.pop()
    return "v" + "_".join(parts)
