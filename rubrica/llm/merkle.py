"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves, with DataFrame functions only.

A paragraph is a line; its leaves are its clauses. A section ends with a paragraph whose own hash
says so, so an edit moves no section border but those beside it. The hash of a node covers its
children in order; equal roots mean equal texts, and where roots differ, only branches with unlike
hashes have to be entered to find the edit.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A leaf ends with a clause of 16 to 48 code points, or with the last word that ends within 48.
LEAF = r"[^\n]{16,48}?[.!?;,|]+ ?|[^\n]{1,48}(?: |$)|[^\n]{1,48}"
#: One paragraph in so many ends a section.
SECTION = 4


def tree(text: Column) -> Column:
    """struct(root, sections array<struct<hash, paragraphs array<struct<hash, leaves>>>>) of one text."""
    leaves = F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x)))
    paragraphs = F.transform(leaves, lambda x: F.struct(F.xxhash64(x).alias("hash"), x.alias("leaves")))

    def sections(ps: Column) -> Column:
        count = F.size(ps)
        ends = F.filter(F.sequence(F.lit(1), count), lambda i: (F.pmod(F.get(ps, i - 1)["hash"], F.lit(SECTION)) == 0) | (i == count))
        return _let(ends, lambda e: F.transform(e, lambda end, j: _let(
            F.slice(ps, F.coalesce(F.get(e, j - 1), F.lit(0)) + 1, end - F.coalesce(F.get(e, j - 1), F.lit(0))),
            lambda own: F.struct(F.xxhash64(F.transform(own, lambda x: x["hash"])).alias("hash"), own.alias("paragraphs")))))

    return _let(paragraphs, lambda ps: _let(sections(ps), lambda s: F.struct(F.xxhash64(F.transform(s, lambda x: x["hash"])).alias("root"), s.alias("sections"))))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex(h: Column, digits: int) -> Column:
    return F.right(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit(digits))


def as_text(node: Column) -> Column:
    """The tree as one string: root|section:paragraph=leaf.leaf,paragraph=...;section:..."""
    def paragraph(p: Column) -> Column:
        return F.concat(_hex(p["hash"], 16), F.lit("="), F.array_join(F.transform(p["leaves"], lambda x: _hex(x, 8)), "."))

    def section(s: Column) -> Column:
        return F.concat(_hex(s["hash"], 16), F.lit(":"), F.array_join(F.transform(s["paragraphs"], paragraph), ","))

    return F.concat(_hex(node["root"], 16), F.lit("|"), F.array_join(F.transform(node["sections"], section), ";"))


def _unlike(a: Column, b: Column) -> Column:
    """The paragraphs of a in sections that b lacks, of which b's unlike sections have no equal."""
    hashes = lambda nodes: F.transform(nodes, lambda n: n["hash"])
    entered = lambda x, y: _let(F.array_except(hashes(x), hashes(y)), lambda new: F.flatten(F.transform(F.filter(x, lambda s: F.array_contains(new, s["hash"])), lambda s: s["paragraphs"])))
    own, other = entered(a["sections"], b["sections"]), entered(b["sections"], a["sections"])
    return _let(own, lambda x: _let(F.array_except(hashes(x), hashes(other)), lambda new: F.filter(x, lambda p: F.array_contains(new, p["hash"]))))


def _shown(node_leaves: Column) -> Column:
    """Leaves as the fingerprint shows them: 32 bits of each, once."""
    return F.array_distinct(F.transform(F.flatten(F.transform(node_leaves, lambda p: p["leaves"])), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))))


def _leaf_count(node: Column) -> Column:
    return F.aggregate(node["sections"], F.lit(0), lambda n, s: F.aggregate(s["paragraphs"], n, lambda m, p: m + F.size(p["leaves"])))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are: 1 for equal roots, 0 if no leaf is common.

    Only branches whose hashes differ are entered: sections, in these paragraphs, in these leaves,
    which are compared as sets of the 32 bits that the fingerprint shows. Everything below an equal
    node is common. The share is that of common leaves in both trees.
    """
    def of(x: Column, y: Column) -> Column:
        lost_x, lost_y = (F.aggregate(v, F.lit(0), lambda n, p: n + F.size(p["leaves"])) for v in (x, y))
        below = _leaf_count(a) - lost_x + _leaf_count(b) - lost_y  # leaves under equal nodes
        return _let(_shown(x), lambda u: _let(_shown(y), lambda v: (below + 2.0 * F.size(F.array_intersect(u, v))) / F.greatest(below + F.size(u) + F.size(v), F.lit(1))))

    return F.when(a["root"] == b["root"], 1.0).otherwise(_let(_unlike(a, b), lambda x: _let(_unlike(b, a), lambda y: of(x, y))))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of b that are new against a; unlike branches alone are entered."""
    hashes = lambda nodes: F.transform(nodes, lambda n: n["hash"])
    flat = F.flatten(F.transform(b["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))
    found = _let(hashes(_unlike(b, a)), lambda new: F.filter(F.transform(flat, lambda h, i: F.when(F.array_contains(new, h), i)), lambda i: i.isNotNull()))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(found)


#: Buckets of with_next at most; their borders are what the driver holds.
MOST_BUCKETS = 100_000


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_in_bucket: int = 1024, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """(id, text, next_text): each row and the text of the row with the next smaller id.

    After the smallest comes the greatest; rows of one id follow each other by their texts' hashes;
    null ids count as the smallest. Ids are whole numbers; others are refused. Rows are cut into
    buckets of about equal counts by id and hash, so that an id that very many rows share is cut too;
    a bucket is sorted by itself, and the first row of the bucket below is copied to its end: texts
    are dealt out once. The driver gets some 20 keys per bucket, by which the borders are chosen, and
    every row counts whatever the borders are.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} has to be a whole number")
    rank = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.bitwise_not(rank).alias("k"))
    rows = rows.withColumn("h", F.xxhash64("__text"))  # ascending (k, h): falling ids
    keys = rows.select("k", "h")
    if not (count := keys.count()):
        return rows.select(F.col("__id").alias(id_col), F.col("__text").alias("text"), F.col("__text").alias("next_text"))
    buckets = max(1, min(most_buckets, count // rows_in_bucket))
    cuts: list[tuple[int, int]] = []
    if buckets > 1:
        share = min(1.0, 20.0 * buckets / count)
        some = sorted((r["k"], r["h"]) for r in keys.where(F.pmod(F.xxhash64(F.lit(5), "k", "h"), F.lit(1 << 30)) < int(share * (1 << 30))).collect())
        cuts = sorted({some[i * len(some) // buckets] for i in range(1, buckets)}) if some else []
    # two steps of about the square root of the cuts each
    width = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    key, kind = F.struct("k", "h"), "struct<k:bigint,h:bigint>"
    named = lambda cs: [{"k": k, "h": h} for k, h in cs]
    below = lambda values: F.size(F.filter(values, lambda c: c <= key))
    if parts:
        heads = F.from_json(F.lit(json.dumps(named([p[-1] for p in parts]))), f"array<{kind}>")
        inner = F.get(F.from_json(F.lit(json.dumps([named(p) for p in parts])), f"array<array<{kind}>>"), below(heads))
        bucket = below(heads) * width + F.coalesce(below(inner), F.lit(0))
    else:
        bucket = F.lit(0)
    firsts = keys.groupBy(bucket.alias("b")).agg(F.min(key).alias("first")).orderBy("b").collect()  # a row per bucket
    before = [(tuple(r["first"]), firsts[i - 1]["b"]) for i, r in enumerate(firsts)]
    border = docs.sparkSession.createDataFrame([(k, h, b) for (k, h), b in before], "k bigint, h bigint, before int")
    placed = rows.withColumn("b", bucket).join(F.broadcast(border), ["k", "h"], "left")
    own, copy = F.struct(F.col("b").alias("b"), F.lit(0).alias("late")), F.struct(F.col("before").alias("b"), F.lit(1).alias("late"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("before").isNotNull(), F.array(own, copy)).otherwise(F.array(own))))
    w = Window.partitionBy("at.b").orderBy("at.late", "k", "h")
    led = placed.withColumn("__next", F.lead("__text").over(w)).where("at.late = 0")
    return led.select(F.col("__id").alias(id_col), F.col("__text").alias("text"), F.col("__next").alias("next_text"))


def half_replaced(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by as many from the start of other."""
    k = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - k), F.substr(other, F.lit(1), k))


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, next_text, tree, edited_tree, next_tree) for every row of docs.

    Null texts count as empty; an empty text is one paragraph without leaves. Only the two named
    columns are read. An empty table gives an empty result.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    rows = rows.withColumn("edited", half_replaced(F.col("text"), F.col("next_text")))
    return rows.withColumns({"tree": tree(F.col("text")), "edited_tree": tree(F.col("edited")), "next_tree": tree(F.col("next_text"))})
