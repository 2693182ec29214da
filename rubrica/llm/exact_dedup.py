"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so, each chunk gets an identifier that is verified against
a dictionary of all distinct chunks, and texts are then compared as ordered identifier lists. Long
texts cross the network once, as chunks, and repeated chunks are merged before they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import cut, lower_ascii

#: A chunk has 160 to 2048 code points and ends after the first sentence end or line end in that
#: range; without one, or at the end of the text, it takes what there is up to 2048.
CHUNK = r"(?s).{160,2047}?[.!?\n]|.{1,2048}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


#: Identifiers to try in turn; the next is taken only if two unlike chunks share one of the last.
IDENTIFIERS = (
    lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b")),
    lambda c: F.struct(F.sha2(c, 256).alias("a"), F.length(c).alias("b")),
)


def unverified(docs: DataFrame, text: Column, identify) -> DataFrame:
    """Identifiers that stand for more than one chunk: none, if they are to be used."""
    pieces = docs.select(F.explode(chunks(text)).alias("chunk")).select(identify(F.col("chunk")).alias("i"), "chunk")
    distinct = pieces.select("i.a", "i.b", "chunk").groupBy("a", "b", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("a", "b").agg(F.count("one").alias("n")).where("n > 1")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the
    greatest id stays; rows that repeat that id are one document and are all marked kept. A null id
    is less than any other, and where all ids of a group are null each row is kept with a null
    keep_id. Only the two named columns are read. An empty table gives an empty result.

    One short job verifies the identifiers first (see `unverified`).
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    identify = next((f for f in IDENTIFIERS if unverified(docs, text, f).isEmpty()), None)
    if identify is None:
        raise ValueError("two unlike chunks share a SHA-256")
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__norm"))
    # both written: texts are cut into chunks once here, and a very large group can be split in the join
    recipes = cut(rows.select("__id", F.sha2("__norm", 256).alias("text_sha256"), F.transform(chunks(F.col("__norm")), identify).alias("recipe")))
    groups = recipes.groupBy("recipe").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = recipes.join(cut(groups), "recipe", "left")
    return found.select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
