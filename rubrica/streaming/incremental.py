"""Labels for a growing table: each micro-batch labels what the log lacks and appends it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rubrica.operators.labeling import provisional


def label_stream(spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, *, id_col: str, text_col: str, fingerprint: str, label: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Reads new Parquet files below `source`, labels rows whose id and content are not in the log, and
    appends to it. A batch that is run again finds its own records and adds nothing."""
    label = label or (lambda df: provisional(df, id_col, F.col(text_col), fingerprint))

    def batch(df: DataFrame, epoch: int) -> None:
        made = label(df.dropDuplicates([id_col, text_col]))
        try:
            known = spark.read.parquet(log).select(id_col, "content_hash")
            made = made.join(known, [id_col, "content_hash"], "left_anti")
        except Exception as e:  # the first batch finds no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        made.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(log)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
