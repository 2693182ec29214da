"""What the operators of this subpackage share: reading tables, cutting lineage, stable ids."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table; read through Spark, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the shared folder of spark.checkpoint.dir; a local one only where none is set and all runs
    in one process (tests). On a cluster without a shared folder it is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rubrica-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, reread from the shared checkpoint folder: later steps neither recompute them
    nor lose them with an executor."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: Column | str) -> Column:
    """True for the third of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3 == 1, F.lit(False))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does the same wherever the text is all ASCII."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))
