"""Scans: CSV, JSON lines, documents and file listings, all through Spark's readers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.operators.checks import require_columns
from rubrica.sources.workbook import read_workbook


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, columns: Sequence[str] | None = None, quoted_lines: bool = True) -> DataFrame:
    """A CSV file with a header, a byte-order mark or none. Blank text is ''.

    quoted_lines: quoted values may hold line ends. Then a file is one task's work; without them
    large files are split.
    """
    reader = spark.read.schema(schema).option("header", True).option("multiLine", quoted_lines).option("escape", '"').option("enforceSchema", False)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    df = reader.csv(path).na.fill("", texts)
    return df.select(*columns) if columns else df


def read_exact_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same, refused unless the file's header has these columns in this order."""
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).limit(0)
    require_columns(head, [f.name for f in schema.fields], path, exact=True)
    return read_csv(spark, path, schema)


def distinct_values(spark: SparkSession, path: str, schema: T.StructType, column: str) -> DataFrame:
    return read_csv(spark, path, schema, columns=[column]).distinct()


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with this schema; lines that are no such record are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of an append-only log of JSON lines, with `__order`: later records sort higher.

    The order is that of the files' times and names, then that within a file.
    """
    found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    meta = F.col("_metadata")
    order = F.struct(meta["file_modification_time"].alias("t"), meta["file_path"].alias("f"), meta["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("n"))
    return found.select("*", order.alias("__order"))


def read_json_document(spark: SparkSession, path: str) -> dict:
    """One small JSON document, on the driver, from any store."""
    return json.loads(_whole(spark, path))


def read_yaml_document(spark: SparkSession, path: str) -> dict:
    import yaml

    return yaml.safe_load(_whole(spark, path))


def _whole(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]).decode("utf-8-sig")


def list_files(spark: SparkSession, path: str, *, without: str | None = None, most: int = 1 << 26) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder but those whose path matches `without`.

    Files of over `most` bytes are too large for a row; they are hashed as streams, one by one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.where(~F.col("path").rlike(without)) if without else files
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    large = []
    for r in found.where(F.col("length") > most).select("path", "length").collect():
        at = jvm.org.apache.hadoop.fs.Path(r.path)
        stream = at.getFileSystem(conf).open(at)
        try:
            large.append((r.path, r.length, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    small = found.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return small.unionAll(spark.createDataFrame(large, "path string, bytes bigint, sha256 string"))


def read_sheet(spark: SparkSession, path: str, schema: T.StructType, sheet: str | None = None) -> DataFrame:
    """A review sheet, all text, from a workbook or from CSV; its columns have to be those of the schema."""
    if path.endswith(".xlsx"):
        return require_columns(read_workbook(spark, path, sheet), schema.names, path).select(schema.names)
    return read_csv(spark, path, schema)
