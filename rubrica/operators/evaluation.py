"""Predictions against a human reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.scoring import derive_score, error_type
from rubrica.functions.spans import exact_span, with_recovered
from rubrica.functions.text import strict_bool
from rubrica.operators.joins import checked_join, key_differences


def require_same_ids(reference: DataFrame, predictions: DataFrame, id_col: str) -> None:
    if bad := key_differences(reference, predictions, [id_col]).limit(5).collect():
        raise ValueError(f"reference and predictions differ in ids: {[(r['side'], r[0]) for r in bad]}")


def judged(reference: DataFrame, predictions: DataFrame, id_col: str) -> DataFrame:
    """(id, human_score, score, error_type, signed_error, schema_valid), one to one."""
    require_same_ids(reference, predictions, id_col)
    both = checked_join(reference.select(id_col, "human_score"), predictions.select(id_col, "score", "technology_role", "strict_ai"), id_col)
    valid = F.coalesce(derive_score("technology_role", strict_bool(F.col("strict_ai").cast("string"))) == F.col("score"), F.lit(False))
    return both.select(id_col, "human_score", "score", error_type("human_score", "score").alias("error_type"), (F.col("score") - F.col("human_score")).alias("signed_error"), valid.alias("schema_valid"))


def error_counts(judgements: DataFrame) -> DataFrame:
    return judgements.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def review_errors(sheet: DataFrame, title: str, description: str, tags: str) -> DataFrame:
    """(review_id, errors) of rows with errors: all of a row's errors, not just its first."""
    score = F.try_to_number("human_score", F.lit("9"))
    strict = strict_bool("strict_ai")
    inside = F.lit(False)
    for c in (title, description, tags):
        inside = inside | exact_span("human_evidence", c).isNotNull()
    rules: list[tuple[str, Column]] = [
        ("score", score.isNull() | ~score.between(0, 3)),
        ("role", ~F.coalesce(F.col("technology_role").isin("none", "auxiliary", "core"), F.lit(False))),
        ("strict", strict.isNull()),
        ("mapping", ~F.coalesce(derive_score("technology_role", strict) == score, F.lit(False))),
        ("confidence", ~F.coalesce(F.col("human_confidence").isin("high", "medium", "low"), F.lit(False))),
        ("evidence", (score > 0) & ~F.coalesce(inside, F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in rules]))
    return sheet.select("review_id", F.array_join(found, "|").alias("errors")).where("errors <> ''")


def normalised_review(sheet: DataFrame, title: str, description: str, tags: str) -> DataFrame:
    """Evidence that is no stretch of the text gives way to one that is; the prose moves to the note.

    A score of 0 has no evidence. A note that is there already stays. Where nothing can be
    recovered the evidence is null, for a check to find.
    """
    said, note = F.trim(F.coalesce("human_evidence", F.lit(""))), F.coalesce("human_note", F.lit(""))
    zero = F.trim("human_score") == "0"
    exact = F.lit(False)
    for c in (title, description, tags):
        exact = exact | F.coalesce(exact_span(said, c).isNotNull(), F.lit(False))
    kept = F.when(zero, "").when(exact, said)
    moved = F.when((zero | ~exact) & (said != "") & (F.trim(note) == ""), said).otherwise(note)
    marked = sheet.withColumns({"__kept": kept, "__note": moved, "__prose": F.when(~zero & ~exact, said)})
    found = with_recovered(marked, "__found", "__prose", title, description, tags)
    return found.withColumns({"human_evidence": F.coalesce("__kept", "__found"), "human_note": F.col("__note"), "strict_ai": F.lower(F.trim("strict_ai"))}).drop("__kept", "__note", "__prose", "__found")
