"""Names to a master list, precision first: exact keys, then reviewed rules; likeness only proposes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules and masters of up to so many rows are broadcast; larger masters are joined by shuffle.
MOST_BROADCAST = 20_000
EXACT, ALIAS = "exact_normalized", "reviewed_name_alias"
NO_MATCH = "no exact name and no reviewed rule"
EXACT_NOTE, RULE_NOTE = "equal after normalisation", "by a reviewed rule"
#: What became of rows that a person had to look at.
ACCEPTED, REJECTED = "accepted_reviewed_rule", "rejected_auto_match"


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcast if a look at it finds at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def kept(df: DataFrame) -> DataFrame:
    """df, cached in a partition a core. Adaptive execution leaves the partitions of a cached plan as they
    are, and each would write a file for each partition of the next shuffle, however few rows it has."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism).persist()


def master_collisions(master: DataFrame, key: Column, code_col: str) -> DataFrame:
    """(name_key, n, codes) of normalised names that stand for more than one code; empty keys don't count."""
    keyed = master.select(key.alias("name_key"), F.col(code_col).alias("code")).where("name_key <> ''")
    found = keyed.groupBy("name_key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.col("code").cast("string"))).alias("codes"))
    return found.where("n > 1")


def exact_tier(items: DataFrame, id_col: str, names: Sequence[Column], master: DataFrame, master_key: Column, code_col: str) -> DataFrame:
    """(id, code, rank): the code of the first of an item's names that the master knows exactly."""
    index = small(master.select(master_key.alias("name_key"), F.col(code_col).alias("code")).where("name_key <> ''"))
    asked = items.select(F.col(id_col), F.posexplode(F.array(*names)).alias("rank", "name_key"))
    hits = asked.join(index, "name_key").groupBy(id_col).agg(F.min_by("code", "rank").alias("code"), F.min("rank").alias("rank"))
    return hits


def rule_hits(items: DataFrame, id_col: str, raw_names: Sequence[str], rules: DataFrame) -> DataFrame:
    """(id, pattern, code, method, and note if the rules have one) wherever a rule's pattern is found in
    one of the raw names.

    The rules are a reviewed list of at most MOST_BROADCAST rows, which is checked; a pattern is no
    equality, so each distinct name is held against each of them.
    """
    if rules.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        raise ValueError(f"over {MOST_BROADCAST} rules; a reviewed list is shorter")
    names = items.select(F.col(id_col), F.explode(F.array_distinct(F.array(*raw_names))).alias("name")).where("name is not null and name <> ''")
    found = names.select("name").distinct().join(F.broadcast(rules), F.expr("regexp_like(name, pattern)"))
    return names.join(found, "name").select(id_col, "pattern", "code", "method", *[c for c in ("note",) if c in rules.columns]).distinct()


def rule_conflicts(hits: DataFrame, id_col: str) -> DataFrame:
    """(id, codes) of items whose rules name more than one code: these must stop a run."""
    found = hits.groupBy(id_col).agg(F.array_sort(F.collect_set(F.col("code").cast("string"))).alias("codes"))
    return found.where(F.size("codes") > 1)


def rule_tier(hits: DataFrame, id_col: str) -> DataFrame:
    """(id, code, method, note): of an item's rules the longest pattern, then the least."""
    note = F.coalesce("note", F.lit("")) if "note" in hits.columns else F.lit("")
    best = hits.groupBy(id_col).agg(F.min_by(F.struct("code", "method", note.alias("note")), F.struct(-F.length("pattern"), F.col("pattern"))).alias("b"))
    method = F.when(F.coalesce(F.trim("b.method"), F.lit("")) == "", ALIAS).otherwise(F.col("b.method"))
    return best.select(id_col, F.col("b.code").alias("code"), method.alias("method"), F.col("b.note").alias("note"))


def match(items: DataFrame, id_col: str, raw_names: Sequence[str], master: DataFrame, rules: DataFrame, *, key, master_name: str, code_col: str, strict: bool = True, attributes: Sequence[str] = ()) -> DataFrame:
    """(id, code, master name, match_status, match_method, match_confidence, unmatched_reason) per item;
    with attributes also match_note and these columns of the master, blank for what is not matched.

    strict: collisions in the master, items whose rules disagree and rules of unknown codes raise an
    error instead of a guess. Exact matches and the hits of the rules are then computed once, for the
    checks and the result.
    """
    if strict and (bad := master_collisions(master, key(F.col(master_name)), code_col).select("name_key").limit(5).collect()):
        raise ValueError(f"normalised master names collide: {[r['name_key'] for r in bad]}")
    exact = exact_tier(items, id_col, [key(F.col(n)) for n in raw_names], master, key(F.col(master_name)), code_col)
    if strict:
        exact = kept(exact)
    rest = items.join(exact, id_col, "left_anti")
    hits = rule_hits(rest, id_col, raw_names, rules)
    if strict:
        hits = kept(hits)
        if bad := rule_conflicts(hits, id_col).limit(5).collect():
            raise ValueError(f"rules disagree: {[(r[0], r['codes']) for r in bad]}")
        if bad := hits.select("code").distinct().join(master.select(F.col(code_col).alias("code")), "code", "left_anti").limit(5).collect():
            raise ValueError(f"rules name unknown codes: {[r['code'] for r in bad]}")
    by_rule = rule_tier(hits, id_col).select(id_col, "code", F.col("method").alias("match_method"), F.when(F.col("note") == "", RULE_NOTE).otherwise(F.col("note")).alias("match_note"))
    found = exact.select(id_col, "code", F.lit(EXACT).alias("match_method"), F.lit(EXACT_NOTE).alias("match_note")).unionByName(by_rule)
    named = found.join(small(master.select(F.col(code_col).alias("code"), F.col(master_name).alias("matched_name"), *attributes)), "code", "left")
    joined = items.select(id_col).join(named, id_col, "left")
    known = F.col("code").isNotNull()
    more = [F.coalesce(c, F.lit("")).alias(c) for c in ("match_note", *attributes)] if attributes else []
    return joined.select(
        id_col, "code", F.coalesce("matched_name", F.lit("")).alias("matched_name"), F.when(known, "matched").otherwise("unmatched").alias("match_status"),
        F.coalesce("match_method", F.lit("")).alias("match_method"), F.when(known, "high").otherwise("low").alias("match_confidence"),
        F.when(known, "").otherwise(NO_MATCH).alias("unmatched_reason"), *more)


def review_ledger(matches: DataFrame, candidates: DataFrame, id_col: str) -> DataFrame:
    """What a person has to look at: all but exact matches, with the best candidate and a decision."""
    top = candidates.where("candidate_rank = 1").select(id_col, "candidate_code", "similarity")
    decision = F.when(F.col("match_status") == "matched", ACCEPTED).otherwise(REJECTED)
    return matches.where(F.col("match_method") != EXACT).join(top, id_col, "left").withColumn("review_decision", decision)


def top_candidates(scored: DataFrame, id_col: str, *, k: int = 3, score: str = "similarity", code: str = "code") -> DataFrame:
    """(id, candidate_rank, candidate_code, similarity): best score per code, then the k best; ties by code."""
    best = scored.groupBy(id_col, code).agg(F.max(score).alias("similarity"))
    w = Window.partitionBy(id_col).orderBy(F.desc("similarity"), code)
    ranked = best.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= k)
    return ranked.select(id_col, "candidate_rank", F.col(code).alias("candidate_code"), "similarity")
