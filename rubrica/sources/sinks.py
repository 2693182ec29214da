"""Sinks: tables are Parquet inside and CSV or JSON at the edge; a run's outputs appear together or not at all.

Everything goes through Spark or Hadoop's file systems, so targets can be in any store.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.operators.cache import latest
from rubrica.sources.store import Store

BOM = "\ufeff".encode()


def flat(df: DataFrame) -> DataFrame:
    """Arrays of text as '|'-joined text, which CSV can hold."""
    return df.withColumns({f.name: F.concat_ws("|", f.name) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)})


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers."""
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with a byte-order mark and a header; rows keep the order of a sorted table.

    The parts are written by the executors and joined as streams, so the driver holds no rows.
    """
    store, parts, made = Store(df.sparkSession), f"{path}.parts", flat(df)
    made.write.mode("overwrite").option("header", False).option("escape", '"').csv(parts)
    head = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in made.columns)
    store.join(BOM + head.encode() + b"\n", [f"{parts}/{n}" for n in store.files(parts) if n.startswith("part-")], path)
    store.delete(parts)


def write_parquet(df: DataFrame, path: str, *, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """The first row (of a table of one row) as one JSON document."""
    row = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    write_document(df.sparkSession, json.loads(row["j"]) if row else {}, path)


def write_document(spark: SparkSession, value: object, path: str) -> None:
    Store(spark).write(path, (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode())


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def compact_log(spark: SparkSession, path: str, target: str, schema: T.StructType, key: str, order: str) -> None:
    """The last record of each key, by the number in the key where it is one, in a folder that then takes
    the target's place."""
    staged = f"{target}.staged"
    kept = latest(spark.read.schema(schema).json(path), key, order)
    kept.orderBy(F.col(key).try_cast("bigint"), key).write.mode("overwrite").json(staged)
    swap(spark, staged, target)


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """staged takes target's place by two renames; the old one is removed last, and comes back if the
    second rename fails."""
    store, old = Store(spark), f"{target}.old"
    if store.exists(target):
        store.delete(old)
        store.rename(target, old)
    try:
        store.rename(staged, target)
    except Exception:
        if store.exists(old) and not store.exists(target):
            store.rename(old, target)
        raise
    store.delete(old)


class Outputs:
    """A folder of outputs that appears whole: `with Outputs(spark, target) as folder:` writes into a
    staging folder, which is swapped in if the block ends well and removed if it does not."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target, self.staged = spark, str(target), f"{target}.staging"

    def __enter__(self) -> str:
        store = Store(self.spark)
        store.delete(self.staged)
        store.make_folder(self.staged)
        return self.staged

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            swap(self.spark, self.staged, self.target)
        else:
            Store(self.spark).delete(self.staged)


def snapshot_once(spark: SparkSession, outputs: str, baselines: str, version: str) -> bool:
    """Keeps a copy of the outputs of a version, unless there is one; True if it was made."""
    store, target = Store(spark), f"{baselines}/{version}"
    if store.exists(target) or not store.exists(outputs):
        return False
    store.copy(outputs, f"{target}.staged")
    store.rename(f"{target}.staged", target)
    return True


def archive(spark: SparkSession, folder: str, target: str, *, without: Iterable[str] = (".git", "__pycache__", ".env", "private")) -> list[str]:
    """A ZIP of a folder without parts of these names; the names in it."""
    store, skip = Store(spark), set(without)
    names = [n for n in store.files(folder) if not skip & set(n.split("/")) and not n.endswith(".crc") and f"{folder}/{n}" != target]
    store.zip(folder, names, target)
    return names


def report(title: str, sections: dict[str, DataFrame | str], most_rows: int = 200) -> str:
    """Markdown of small tables (at most `most_rows` rows of each are shown) and paragraphs."""
    out = [f"# {title}", ""]
    for name, part in sections.items():
        out += [f"## {name}", ""]
        if isinstance(part, str):
            out += [part, ""]
            continue
        rows = part.limit(most_rows).collect()
        out += ["| " + " | ".join(part.columns) + " |", "|" + "-|" * len(part.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "/") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
