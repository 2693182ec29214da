"""Line dedup with DataFrame functions only: hash normalised lines, count their documents, drop, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import cut, lower_ascii

#: What is stripped from both ends of a line, as a trim set: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def stripped(line: Column) -> Column:
    """line without blanks at its ends. A trim from the right walks the whole line, so it is spared
    where the last character is none of them."""
    line = F.ltrim(line, F.lit(BLANKS))
    ends = F.lit(False)
    for blank in BLANKS:
        ends = ends | F.endswith(line, F.lit(blank))
    return F.when(ends, F.rtrim(line, F.lit(BLANKS))).otherwise(line)


def _hash(key: Column) -> Column:
    """128 bits of two differently seeded XXH64, so that equal hashes mean equal lines at any size."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def _flagged(docs: DataFrame, threshold: int, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, whole: struct of all columns of docs, gone: sorted numbers of the lines to drop, null
    if none, stay: a flag for each line)."""
    id_, text = F.col(f"whole.`{id_col}`"), F.coalesce(F.col(f"whole.`{text_col}`"), F.lit(""))
    # 128 bits of id and text name a row: rows that repeat both get equal flags
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    rows = rows.select("whole", F.xxhash64(id_, text).alias("r1"), F.xxhash64(F.lit(7), id_, text).alias("r2"))
    keys = F.transform(F.split(lower_ascii(text), "\n"), stripped)
    keys = F.transform(keys, lambda k: F.when(F.length(k) >= least_chars, _hash(k)))
    # hashed once, for both uses below
    hashed = rows.select(id_.alias("id"), "r1", "r2", keys.alias("keys")).where(F.exists("keys", lambda k: k.isNotNull()))
    hashed = cut(hashed.select("id", "r1", "r2", F.col("keys.a").alias("a"), F.col("keys.b").alias("b")))
    lines = hashed.select("id", "r1", "r2", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "k")).where("k.a is not null").select("id", "r1", "r2", "pos", "k.a", "k.b")
    nulls = F.max(F.col("id").isNull()).alias("nulls")
    if threshold > 2:  # repeats of an id are one document, so pairs of key and id are made distinct before they count
        owners = lines.groupBy("a", "b", "id").agg(F.lit(1).alias("one"))
        owners = owners.groupBy("a", "b").agg(F.count("one").alias("n"), F.min("id").alias("owner")).where(F.col("n") >= threshold)
    else:  # a key has two documents or more exactly if its least and greatest ids differ, or a null id comes to another
        owners = lines.groupBy("a", "b").agg(F.min("id").alias("owner"), F.max("id").alias("other"), nulls).where("owner < other or (nulls and owner is not null)")
    # written, so that both sides of the join are plain exchanges, of which a very common line can be split
    owners = cut(owners.select("a", "b", "owner"))
    drops = lines.join(owners, ["a", "b"]).where("id is null or id <> owner")
    drops = drops.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    joined = rows.join(drops, ["r1", "r2"], "left").select("whole", "gone", id_.alias("id"), text.alias("text"))
    split = F.split("text", "\n")
    # the flags of the lines, by one walk over the sorted positions: gaps become runs of true
    flags = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda i: F.concat(
            F.array_repeat(F.lit(True), F.coalesce(F.get("gone", i), F.size(split)) - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1),
            F.when(i < F.size("gone"), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))))
    return joined.withColumn("stay", flags)


def _kept() -> Column:
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: F.get("stay", i)), "\n")
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)


def drop_repeated_lines(docs: DataFrame, *, threshold: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) for every row of docs.

    A text splits at \\n; null and empty texts are one empty line. A line's key is the line without
    blanks at its ends, A-Z lower-cased. Keys of `least_chars` or more code points in `threshold` or
    more documents lose all their lines but those of the smallest id; the other lines stay in order.
    Ids may be of any type that has an order. Rows that share an id count as one document for the
    keys and keep a row each. Null ids are one document, greater than any other. Only the two named
    columns are read, so others of any name do no harm. An empty table gives an empty result.

    Lines travel as hashes; the whole texts are dealt out once, beside the numbers of the lines that
    go. A line that very many documents hold is summed before the shuffle and then is a skewed join,
    which adaptive execution splits.
    """
    judged = _flagged(docs.select(id_col, text_col), threshold, least_chars, id_col, text_col)
    gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint")
    return judged.select(F.col("id").alias(id_col), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), gone.alias("n_dropped"), _kept().alias("kept_text"))


def without_repeated_lines(docs: DataFrame, *, threshold: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines dropped that `drop_repeated_lines` drops; all rows and columns stay, of any
    names, null texts null."""
    judged = _flagged(docs, threshold, least_chars, id_col, text_col).withColumn("kept", _kept())
    text = F.when(F.col(f"whole.`{text_col}`").isNotNull(), F.col("kept"))
    return judged.select(*[(text if c == text_col else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])
