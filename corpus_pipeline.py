"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Stages read and return the columns of `documents`; the last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm import line_dedup, packing, quality, secrets, simhash
from rubrica.llm.common import cut, read_documents
from rubrica.llm.queries import TOKENIZER

#: A document is rejected if its score for good quality is below this.
LEAST_SCORE = 0.5
#: Five-word shingles of a Jaccard similarity of 0.8 or more, which is verified. Candidates: 256 bits
#: of the distinct shingles, of which 80 may differ (such texts differ in 39 +- 6; 4 of 5 shingles, the
#: worst case, in 48 +- 6, and beyond 80 in one case of 1.8 million), and one of eight minima in common
#: (which such texts lack in three cases of a million).
NEAR = {"width": 5, "words": 4, "radius": 80, "anchors": 8, "least": 0.8}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose whole text the classifier scores below LEAST_SCORE.

    Every row is judged by its text alone, null as an empty one; ids may repeat or be null. An empty
    table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.with_score(docs, model, name="__score").where(F.col("__score") >= LEAST_SCORE)
    return kept.select([F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text. Texts of which nothing is left stay, empty: the
    next stage takes them for copies of each other. Null texts stay null; rows that share an id are one
    document, null ids too."""
    kept = line_dedup.without_repeated_lines(docs, threshold=2, least_chars=10)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select([F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Texts without a word (null, empty, blank, or emptied by the stage before) are one group. Rows that
    share an id are one document and stay or go together; rows without an id stay. An empty table stays
    empty.
    """
    groups = simhash.near_duplicates(docs, **NEAR)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret that is found; n_chars follows the text. All rows stay, whatever their ids;
    null texts stay null."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("bigint")).select([F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence, with its token ids (little-endian, 32 bits each).

    Null and empty texts have the end id alone; rows that repeat an id are packed each, and a null id
    stays null. An empty table gives an empty result.
    """
    made = packing.pieces(docs, TOKENIZER, end_id=2).withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(made, packing.groups_for(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The quality model, fingerprints and token ids are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written to the shared folder and read again."""
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
