import json

import pytest
from pyspark.sql import functions as F
from rubrica.functions import text
from rubrica.operators import agreement, annual, audit, cache, checks, dedup, evaluation, joins, labeling, matching, sampling, similarity


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_rows_keep_the_first_and_the_lineage(spark):
    df = spark.createDataFrame([("10", "a", None), ("9", "a", None), ("3", "a", "x"), ("1", "b", "y")], "id string, k string, v string").withColumn("o", F.col("id").cast("int"))
    got = dedup.canonical(df, ["k", "v"], "id", "o").select("canonical_id", "source_ids", "duplicate_group_size", "k", "v")
    assert {r.canonical_id: (r.source_ids, r.duplicate_group_size) for r in got.collect()} == {"9": (["9", "10"], 2), "3": (["3"], 1), "1": (["1"], 1)}
    assert rows(dedup.lineage(df, ["k", "v"], "id", "o")) == [("1", "1", False), ("10", "9", True), ("3", "3", False), ("9", "9", False)]
    assert rows(dedup.stats(df, ["k", "v"])) == [(4, 3, 1, 1)]
    assert rows(dedup.stats(df.limit(0), ["k", "v"])) == [(0, 0, 0, 0)]


def test_deduplicating_twice_changes_nothing(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id int, k int")
    once = dedup.canonical(df, ["k"], "id")
    again = dedup.canonical(once.select(F.col("canonical_id").alias("id"), "k"), ["k"], "id")
    assert rows(once.select("canonical_id", "k")) == rows(again.select("canonical_id", "k"))


def test_joins_refuse_a_broken_cardinality(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(joins.CardinalityError, match="1:1"):
        joins.checked_join(a, b, "k")
    assert joins.checked_join(a, b, "k", cardinality="1:m").count() == 2
    assert rows(joins.key_differences(a, b, ["k"])) == [(2, "left")]


MASTER = [("000001.SZ", "平安银行股份有限公司"), ("601318.SH", "中国平安保险(集团)股份有限公司"), ("600036.SH", "招商银行股份有限公司"), ("000002.SZ", "万科企业股份有限公司")]
RULES = [("^中国平安(?:人寿|财产)保险股份有限公司", "601318.SH", "reviewed_parent_rule"), ("^招商银行股份有限公司.+分行$", "600036.SH", "reviewed_parent_rule"), ("万科物业", "000002.SZ", ""), ("上海万科物业", "000002.SZ", "longer")]


def match(spark, names, rules=RULES, master=MASTER):
    items = spark.createDataFrame([(str(i), n, "") for i, n in enumerate(names)], "id string, a string, b string")
    m = spark.createDataFrame(master, "code string, name string")
    r = spark.createDataFrame(rules, "pattern string, code string, method string")
    return {x.id: x for x in matching.match(items, "id", ["a", "b"], m, r, key=text.company_key, master_name="name", code_col="code").collect()}


def test_tiers(spark):
    got = match(spark, ["招商银行股份有限公司", "招商银行股份有限公司厦门分行", "上海万科物业服务有限公司", "中关村科技租赁股份有限公司", "中国平安人寿保险股份有限公司上海分公司"])
    assert [(got[str(i)].code, got[str(i)].match_method) for i in range(5)] == [("600036.SH", "exact_normalized"), ("600036.SH", "reviewed_parent_rule"), ("000002.SZ", "longer"), (None, ""), ("601318.SH", "reviewed_parent_rule")]
    assert (got["3"].match_status, got["3"].match_confidence) == ("unmatched", "low")


def test_matching_fails_closed(spark):
    with pytest.raises(ValueError, match="disagree"):
        match(spark, ["万科物业"], [("万科", "000002.SZ", ""), ("物业", "600036.SH", "")])
    with pytest.raises(ValueError, match="unknown codes"):
        match(spark, ["万科物业"], [("万科", "9", "")])
    with pytest.raises(ValueError, match="collide"):
        match(spark, ["x"], master=[*MASTER, ("1", "招商银行(股份)有限公司")])


def test_likeness_only_proposes(spark):
    items = spark.createDataFrame([("1", "招商银行股份公司"), ("2", "zzz"), ("3", None)], "id string, a string")
    got = matching.top_candidates(similarity.candidates(items, "id", ["a"], spark.createDataFrame(MASTER, "code string, name string"), "name", "code"), "id")
    first = {r.id: r for r in got.where("candidate_rank = 1").collect()}
    assert first["1"].candidate_code == "600036.SH" and first["1"].similarity > 80
    assert set(first) == {"1", "2"} and got.groupBy("id").count().where("count > 3").isEmpty()
    assert similarity.ratio("abcd", "abcd") == 100 and similarity.ratio("ab", "xy") == 0 and similarity.common_length("abcde", "xaced") == 3


def test_bounds_lose_no_candidate():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde银行股份") for _ in range(rng.randrange(1, 7)))
    name = lambda: " ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 4, 9])))
    rows = [(f"{i:03}", name()) for i in range(150)] + [("x1", ""), ("x2", "ab ab ab"), ("x3", "  a  b ")]
    held = similarity.Master(rows)
    for asked in [name() for _ in range(60)] + ["ba", "zzz", "a b a b", rows[5][1]]:
        for measure in (similarity.weighted_ratio, similarity.edit_ratio):
            want = sorted((-round(measure(asked, m), 2), c) for c, m in rows)[:3]
            assert held.best(asked, 3, measure) == [(-s, c) for s, c in want], (asked, measure)


def test_trees_find_what_plain_scoring_finds(monkeypatch):
    import random

    rng = random.Random(4)
    for shared, rows_, opened in ((4, 4096, 1 << 19), (10**6, 7, 3)):
        monkeypatch.setattr(similarity, "SHARED", shared)
        monkeypatch.setattr(similarity, "ROWS", rows_)
        monkeypatch.setattr(similarity, "OPENED", opened)
        for letters in ("ab", "0123456789", "银行股份abc"):
            word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
            name = lambda: rng.choice(["", "No.0"]) + " ".join(word() for _ in range(rng.choice([1, 1, 1, 2])))
            master = [(str(i), name()) for i in range(120)] + [("e", ""), ("l", "ab" * 50)]
            master += [(str(1000 + i), master[0][1]) for i in range(4)]
            names = list({name() for _ in range(40)} | {"zzz", "a" * 64, "b" * 65, "0a" * 40, master[0][1]})
            for measure in (similarity.weighted_ratio, similarity.edit_ratio):
                want = [(n, c, -s) for n in names for s, c in sorted((-round(measure(n, m), 2), c) for c, m in master)[:3]]
                assert similarity.best_of_all(names, master, 3, measure) == want


def test_names_with_numbers_are_scored_against_few_masters(spark):
    """Two long lists of serial names: each name against the whole master, in far fewer steps than pairs."""
    import time

    items = spark.range(4000).selectExpr("id", "concat('Customer#', lpad(cast(id * 211 as string), 9, '0')) as a")
    master = spark.range(20000).selectExpr("cast(id as string) as code", "concat('Supplier#', lpad(cast(id as string), 9, '0')) as name")
    start = time.monotonic()
    got = similarity.candidates(items, "id", ["a"], master, "name", "code").collect()
    assert time.monotonic() - start < 60 and len(got) == 12000  # minutes when each pair was looked at
    names = {f"Supplier#{i:09}": str(i) for i in range(20000)}
    for i in (0, 1234, 3999):
        asked = f"Customer#{i * 211:09}"
        want = sorted((-round(similarity.weighted_ratio(asked, m), 2), c) for m, c in names.items())[:3]
        assert sorted((-r.similarity, r.code) for r in got if r.id == i) == want


def test_blocks_of_a_master_make_no_difference(spark):
    items = spark.createDataFrame([("1", "alpha beta"), ("2", "gamma"), ("3", "alpha gamma ray")], "id string, a string")
    master = spark.createDataFrame([(f"{i:02}", n) for i, n in enumerate(["alpha", "beta alpha", "gamma rays", "delta", None, "gam", "alphabet", "x"])], "code string, name string")
    got = [rows(matching.top_candidates(similarity.candidates(items, "id", ["a"], master, "name", "code", block=b), "id")) for b in (2, 4096)]
    assert got[0] == got[1] and len(got[0]) == 9
    assert similarity.candidates(items, "id", ["a"], master.limit(0), "name", "code").count() == 0


def test_each_pair_of_blocks_is_a_task_of_its_own(spark, tmp_path, monkeypatch):
    """Blocks are few bytes that take long; adaptive execution must not join their partitions."""
    monkeypatch.setattr(similarity, "LEAST", 8)
    seen = str(tmp_path)

    def measure(a, b):
        import os

        from pyspark import TaskContext

        os.makedirs(f"{seen}/{TaskContext.get().partitionId()}", exist_ok=True)
        return similarity.ratio(a, b)

    items = spark.range(200).selectExpr("id", "concat('a', id) as a")
    master = spark.range(60).selectExpr("cast(id as string) as code", "concat('b', id) as name")
    got = similarity.candidates(items, "id", ["a"], master, "name", "code", measure=measure, block=30).collect()
    assert len(got) == 600 and len(list(tmp_path.iterdir())) == 2 * 25  # blocks of the master, blocks of names


def test_cached_tables_have_a_partition_a_core(spark):
    made = matching.kept(spark.range(1000).repartition(64))
    assert made.count() == 1000 and made.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    made.unpersist()


def test_yearly_shares(spark):
    df = spark.createDataFrame([(2024, 0), (2024, 2), (2025, 1), (2025, 3), (2025, None)], "year int, score int")
    got = {r.year: r for r in annual.summary(df).collect()}
    assert got[2024].share_score_ge_2 == 0.5 and got[2025].share_score_ge_1 == 1 and got[2025].share_score_eq_3 == 0.5
    assert (got[2025].n_ads, got[2025].n_unlabelled) == (2, 1)


def kappa(spark, pairs):
    return agreement.weighted_kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()["kappa"]


def test_kappa(spark):
    assert kappa(spark, [(0, 0), (3, 3)]) == 1 and kappa(spark, [(1, 1), (1, 1)]) == 1 and kappa(spark, []) is None
    pairs = [(i % 4, (i * 7 + i // 3) % 4) for i in range(60)]
    assert abs(kappa(spark, pairs) - kappa(spark, pairs[::-1])) < 1e-12
    n = len(pairs)
    o = sum((a - b) ** 2 for a, b in pairs)
    e = sum((a - d) ** 2 for a, _ in pairs for _, d in pairs) / n
    assert abs(kappa(spark, pairs) - (1 - o / e)) < 1e-12


def test_per_class_has_nulls_on_empty_denominators(spark):
    got = {r.category: r for r in agreement.per_class(spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "a int, b int"), "a", "b").collect()}
    assert (got[0].precision, got[0].recall) == (1.0, 0.5) and got[1].precision == 0 and got[1].recall is None and got[3].f1 is None


def frame(spark, n=400):
    df = spark.range(n).select(F.col("id").cast("string").alias("i"), (F.col("id") % 4).cast("int").alias("score"), (F.col("id") % 3 == 0).alias("candidate"), (F.col("id") * 7 % 11).cast("int").alias("risk_points"))
    return df.where("score <> 3 or int(i) % 16 = 3")


def test_splits_fill_their_quotas_and_are_disjoint(spark):
    got = sampling.review_splits(frame(spark), "i", 7, version="v1")
    counts = {(r.split, r.score): r["count"] for r in got.groupBy("split", "score").count().collect()}
    assert counts == {("development", k): v for k, v in sampling.DEVELOPMENT.items()} | {("holdout", k): v for k, v in sampling.HOLDOUT.items()}
    assert got.select("i").distinct().count() == got.select("review_id").distinct().count() == 120
    sheet = sampling.blind(got.where("split = 'holdout'"), ["i"], 7)
    assert sampling.blind_leaks(sheet, {"score", "i"}, 60) == ["column i"]
    with pytest.raises(sampling.QuotaError):
        sampling.review_splits(frame(spark, 30), "i", 7, version="v1")


def test_audit_sample(spark):
    df = spark.createDataFrame([(1, 1, "low", 1), (2, 2, "high", 0), (3, 3, "high", 3), (4, 0, "high", 0)], "i int, score int, confidence string, rule_score int")
    args = {"low": F.col("confidence") == "low", "conflict": (F.col("rule_score") >= 2) != (F.col("score") >= 2), "strict": F.col("score") == 3}
    got = {r.i: r.selection_reason for r in sampling.audit_sample(df, "i", 3, 1, **args).collect()}
    assert got == {1: "low_confidence", 2: "rule_model_threshold_conflict", 3: "strict_score3"}
    assert {r.i: r.selection_reason for r in sampling.audit_sample(df, "i", 4, 1, **args).collect()}[4] == "stratified_fill"
    with pytest.raises(sampling.QuotaError):
        sampling.audit_sample(df, "i", 2, 1, **args)


def test_cache(spark):
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "k string, seq int, v string")
    assert rows(cache.latest(log, "k", "seq")) == [("a", 2, "new"), ("b", 1, "x")]
    items = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "id string, h string")
    kept = spark.createDataFrame([("a", "h1", "v2", 1), ("b", "zz", "v2", 1)], "id string, h string, version string, score int")
    probed = cache.probe(items, kept, ["id", "h"], {"version": "v2"})
    assert {r.id: r.cache_state for r in probed.collect()} == {"a": "hit", "b": "stale", "c": "miss"}
    with pytest.raises(ValueError, match="2 items"):
        cache.require_all_cached(probed)


def test_adjudications_replace_all_columns_or_none(spark):
    labels = spark.createDataFrame([("1", 2, "x"), ("2", 1, "y")], "id string, score int, reason string")
    got = audit.apply_adjudications(labels, spark.createDataFrame([("1", 3, None)], "id string, score int, reason string"), "id", ["score", "reason"])
    assert rows(got.select("id", "score", F.coalesce("reason", F.lit("-")), "primary_score")) == [("1", 3, "-", 2), ("2", 1, "y", 1)]


def test_checks_name_every_failure(spark):
    df = spark.createDataFrame([(1, 0), (1, 9)], "k int, s int")
    found = checks.union([checks.unique_key(df, ["k"], "unique"), checks.row_rules(df, {"range": ~F.col("s").between(0, 3)}), checks.row_count(df, 2, "rows")])
    with pytest.raises(checks.QualityError, match="range: 1; unique: 1"):
        checks.require(found)
    with pytest.raises(checks.QualityError):
        checks.require_columns(df, ["s", "k"], "t", exact=True)


def label(**k):
    return {"canonical_id": "1", "technology_role": "core", "strict_ai": False, "score": 2, "boundary_pair": "none", "evidence": ["软件开发", "数据库"], "reason": "because", "confidence": "high"} | k


SOURCE = {"1": "岗位：工程师\n描述：负责软件开发、数据库\n标签："}


def payload(*items):
    return json.dumps({"items": list(items)}, ensure_ascii=False)


@pytest.mark.parametrize("bad", [{"canonical_id": "2"}, {"evidence": ["改写"]}, {"score": 3}, {"extra": 1}, {"evidence": ["工程师"]}, {"confidence": "sure"}, {"reason": "x"}, {"evidence": []}])
def test_broken_labels_are_refused(bad):
    with pytest.raises(labeling.Invalid):
        labeling.validate(payload(label(**bad)), SOURCE)


def test_labels_are_repaired():
    got = labeling.validate(payload(label(evidence=["软件开发,数据库"])), SOURCE)[0]
    assert got["evidence"] == ["软件开发、数据库"] and got["confidence"] == "medium"
    assert len(labeling.validate(payload(label(evidence=["软件开发"] * 7)), SOURCE)[0]["evidence"]) == 5


def test_fingerprints_hold_all_that_shapes_an_answer():
    base = {"rubric": {"a": 1, "b": [2, {"c": "软件"}]}, "stage": "primary", "model": "m", "versions": {"p": "1", "s": "2"}, "thinking": False}
    make = lambda **k: labeling.prompt_fingerprint(**{**base, **k})
    assert len(make()) == 64 and make() == make(rubric={"b": [2, {"c": "软件"}], "a": 1})  # the order of keys says nothing
    others = [make(rubric={"a": 2}), make(stage="audit"), make(model="n"), make(versions={"p": "1", "s": "3"}), make(thinking=True)]
    assert len({make(), *others}) == 6
    assert labeling.request_id("fp", ["1", "2"]) != labeling.request_id("fp", ["1"]) != labeling.request_id("fq", ["1"])


def test_retries_split_and_give_up():
    asked, waits = [], []

    def call(text):
        asked.append(text)
        if len(asked) == 1:
            raise labeling.Refused(503)
        return payload(label()), 10, 5

    assert labeling.ask(call, lambda b: str(b), [("1", SOURCE["1"])], wait=waits.append)[0]["input_tokens"] == 10
    assert waits == [1.0]
    with pytest.raises(labeling.Refused):
        labeling.ask(lambda _: (_ for _ in ()).throw(labeling.Refused(401)), str, [("1", "x")], wait=waits.append)
    with pytest.raises(labeling.Invalid):
        labeling.ask(lambda _: ("{}", 1, 1), str, [("1", "x"), ("2", "y")], wait=waits.append)


def test_misses_are_labelled_in_tasks(spark):
    def client():
        def call(text):
            items = json.loads(text.split("\n\n")[-1])
            made = [{"canonical_id": i["canonical_id"], "technology_role": "core", "strict_ai": False, "score": 2, "boundary_pair": "none", "evidence": [i["text"][:20]], "reason": "because", "confidence": "high"} for i in items]
            return json.dumps({"items": made}), 100, 20

        return call

    df = spark.createDataFrame([(str(i), f"software development number {i} and more") for i in range(20)], "id string, t string")
    got = labeling.Labeller(client, batch=3, parallel=2).label(df, "id", "t")
    assert got.count() == 20 and got.select("confidence").distinct().collect()[0][0] == "medium"


def test_review_rows(spark):
    cols = "review_id string, title string, body string, tags string, human_score string, technology_role string, strict_ai string, human_confidence string, human_evidence string, human_note string"
    df = spark.createDataFrame([
        ("ok", "t", "负责软件开发", "", "2", "core", "false", "high", "软件开发", ""), ("zero", "t", "销售", "", "0", "none", "False", "high", "不涉及技术", ""),
        ("prose", "t", "负责软件开发", "", "2", "core", "false", "high", "理由：“负责软件开发”为核心", ""), ("bad", "t", "b", "", "5", "core", "maybe", "sure", "b", "")], cols)
    got = {r.review_id: r for r in evaluation.normalised_review(df, "title", "body", "tags").collect()}
    assert (got["zero"].human_evidence, got["zero"].human_note) == ("", "不涉及技术")
    assert got["prose"].human_evidence == "负责软件开发" and got["prose"].human_note.startswith("理由")
    errors = {r.review_id: r.errors for r in evaluation.review_errors(df, "title", "body", "tags").collect()}
    assert "score" in errors["bad"] and "strict" in errors["bad"] and "confidence" in errors["bad"] and "ok" not in errors


def test_evidence_of_long_lines_takes_time_in_proportion_to_them(spark):
    """Recovery looks for the explanation's pairs in a line; it doesn't make all pairs of the line."""
    import time

    from rubrica.functions import spans

    low = lambda n, c: (c * n)[:n]
    said = "#not in the text#"
    texts = ["qq xx, " + low(90_000, "the next in it "), "zz\n" + low(300_000, "vw") + "\nnot in the Text\nnot in", low(400_000, "the next in it ")]
    df = spark.createDataFrame([(i, said if i < 2 else None, x) for i, x in enumerate(texts)], "id int, said string, body string")
    start = time.monotonic()
    got = {r.id: r.e for r in spans.with_recovered(df, "e", "said", F.lit("a title"), "body", F.lit(None).cast("string")).select("id", "e").collect()}
    assert time.monotonic() - start < 20  # minutes when pairs were made by place in the line
    assert got == {0: "the next in it " * 16, 1: "not in the Text", 2: None}


def test_predictions_need_the_same_ids(spark):
    ref = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "id string, human_score int")
    pred = spark.createDataFrame([("1", 2, "core", "false"), ("2", 1, "auxiliary", "false"), ("3", 3, "core", "true")], "id string, score int, technology_role string, strict_ai string")
    got = evaluation.judged(ref, pred, "id")
    assert {r.id: r.error_type for r in got.collect()} == {"1": "threshold_false_positive", "2": "threshold_false_negative", "3": "match"}
    assert got.where("schema_valid").count() == 3
    with pytest.raises(ValueError, match="differ in ids"):
        evaluation.judged(ref, pred.where("id <> '3'"), "id")


def test_file_listing_holds_every_file(spark):
    import hashlib
    from pathlib import Path

    from rubrica.plans.queries import file_listing
    from rubrica.sources.files import list_files

    want = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path("/root/testdata/sf0.001").rglob("*.parquet")}
    assert {tuple(r) for r in file_listing(spark, "/root/testdata/sf0.001").collect()} == want
    streamed = list_files(spark, "/root/testdata/sf0.001", most=10_000).collect()
    assert {(r.path.rsplit("/", 1)[1], r.bytes, r.sha256) for r in streamed} == want
