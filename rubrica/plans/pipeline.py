"""The whole run: clean, match, label from the log, audit, compare versions, summarise, check, publish, verify."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions import dates, scoring, text
from rubrica.operators import agreement, annual, audit, cache, checks, dedup, evaluation, labeling, matching, sampling, similarity
from rubrica.sources import files, schemas, sinks
from rubrica.sources.settle import settled
from rubrica.sources.store import Store
from rubrica.sources.workbook import write_workbook

PROVISIONAL = "provisional_no_api"
#: Stages of labelling, and the status of the labels that they make.
STATUS = {"primary": "primary", "audit": "audit", "adjudication": "adjudicated"}
#: Tables of a run that are published as Parquet, and those of them that are CSV files too.
TABLES = ("ads", "duplicates", "firms", "matches", "candidates", "match_review", "labels", "annual")
AT_THE_EDGE = ("matches", "labels", "annual", "match_review")
SHARES = ("share_score_ge_2", "wilson_low", "wilson_high", "share_score_ge_1", "share_score_eq_3")
MANIFEST = ("canonical_id", "technology_role", "strict_ai", "score", "model_score", "boundary_pair", "content_hash", "model", "prompt_version", "schema_version", "prompt_fingerprint", "stage", "thinking", "label_status", "request_id", "input_tokens", "output_tokens")


def clean_ads(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(canonical ads, lineage, statistics) of raw ads."""
    cleaned = raw.select(F.trim("id").alias("id"), *[text.clean_text(c, tag_field=c in schemas.TAG_FIELDS).alias(c) for c in schemas.AD_FIELDS])
    dates.require_dates(cleaned, "发布时间", "id")
    keyed = cleaned.withColumn("__order", F.col("id").cast("bigint"))
    when = dates.parse_date("发布时间")
    ads = dedup.canonical(keyed, schemas.AD_FIELDS, "id", "__order").drop("__order").withColumns({"published_date": dates.iso_date(when), "year": F.year(when)})
    return ads, dedup.lineage(keyed, schemas.AD_FIELDS, "id", "__order"), dedup.stats(cleaned, schemas.AD_FIELDS)


def clean_firms(raw: DataFrame) -> DataFrame:
    return raw.where(text.is_ticker(F.trim("股票代码"))).select(*[text.clean_text(c).alias(c) for c in schemas.FIRM_FIELDS])


def ad_text() -> Column:
    return text.labelled_text({"岗位": "岗位", "描述": "岗位描述", "标签": "岗位标签"})


def cached_labels(items: DataFrame, log: DataFrame | None, versions: labeling.Versions, stage: str) -> tuple[DataFrame, DataFrame]:
    """(labels, misses) of items(canonical_id, text, and of an adjudication context) by a log of records.

    Of each id only the last record counts. It is a hit if all nine of canonical_id, content_hash,
    model, prompt_version, schema_version, prompt_fingerprint, stage, thinking and label_status are
    those of now, its model_score is its score, and it breaks no rule for labels, its evidence against
    the text included. Labels have a row per id, evidence as '|'-joined text.
    """
    whole = F.concat_ws("\n", "text", F.col("context")) if "context" in items.columns else F.col("text")
    asked = items.withColumn("content_hash", text.content_hash(whole, versions.prompt_fingerprint))
    if log is None:
        return asked.limit(0).select("canonical_id"), asked
    others = [c for c in schemas.LABEL_CACHE.names if c not in ("canonical_id", "content_hash")]
    kept = cache.latest(log.select("canonical_id", "content_hash", *others, "__order"), "canonical_id", "__order").drop("__order")
    kept = kept.withColumns({"__joined": F.col("evidence"), "evidence": text.split_list(F.coalesce("evidence", F.lit("")))})
    source = asked.select(F.col("canonical_id").alias("__id"), F.col("text").alias("__text"))
    kept = kept.join(source, F.col("canonical_id") == F.col("__id")).drop("__id")
    broken = F.lit(False)
    for rule in checks.label_rules("__text", "岗位：").values():
        broken = broken | F.coalesce(rule, F.lit(True))
    probed = cache.probe(asked, kept, ["canonical_id", "content_hash"], versions.expected(stage, STATUS[stage]), ~broken & (F.col("model_score") == F.col("score")))
    hits = probed.where("cache_state = 'hit'")
    sure = checks.calibrated_confidence()
    labels = hits.withColumn("confidence", sure).withColumn("evidence", F.col("__joined")).select("canonical_id", "content_hash", *others)
    return labels, probed.where("cache_state <> 'hit'").select(asked.columns)


@dataclass(frozen=True)
class Labels:
    """Where labels come from: a folder of logs (one per stage), their versions, and, online, a labeller.

    Offline a missing or stale label is an error, raised before anything is written.
    """

    logs: str
    versions: labeling.Versions
    labeller: labeling.Labeller | None = None

    def log(self, stage: str) -> str:
        return f"{self.logs}/{stage}.jsonl"

    def of(self, items: DataFrame, stage: str) -> DataFrame:
        spark, path = items.sparkSession, self.log(stage)
        read = lambda: files.read_log(spark, path, schemas.LABEL_CACHE) if Store(spark).exists(path) else None
        items = settled(items)
        labels, misses = map(settled, cached_labels(items, read(), self.versions, stage))
        count = misses.count()
        if not count:
            return labels if "score" in labels.columns else _no_labels(items)
        if self.labeller is None:
            raise ValueError(f"offline run: {count} items have no valid {stage} label")
        how = labeling.Labeller(self.labeller.client, self.labeller.rubric, stage, self.labeller.batch, self.labeller.parallel, self.labeller.wait)
        how.fill(misses, path, self.versions, label_status=STATUS[stage])
        labels, misses = map(settled, cached_labels(items, read(), self.versions, stage))
        if count := misses.count():
            raise ValueError(f"{count} {stage} labels are invalid after labelling")
        return labels

    def compact(self, spark: SparkSession, stage: str) -> None:
        """The log with one record per id, in the order of ids."""
        log = files.read_log(spark, self.log(stage), schemas.LABEL_CACHE)
        kept = cache.latest(log, "canonical_id", "__order").drop("__order")
        kept.orderBy(F.col("canonical_id").try_cast("bigint"), "canonical_id").write.mode("overwrite").json(f"{self.log(stage)}.staged")
        sinks.swap(spark, f"{self.log(stage)}.staged", self.log(stage))


def _no_labels(items: DataFrame) -> DataFrame:
    return items.sparkSession.createDataFrame([], schemas.LABEL_CACHE)


@dataclass
class Run:
    ads: DataFrame
    duplicates: DataFrame
    stats: DataFrame
    firms: DataFrame
    matches: DataFrame
    candidates: DataFrame
    match_review: DataFrame
    labels: DataFrame
    annual: DataFrame
    checks: DataFrame
    rules: DataFrame
    sample: DataFrame | None = None
    reliability: DataFrame | None = None
    changes: dict[str, DataFrame] = field(default_factory=dict)


def audit_targets(items: DataFrame) -> dict[str, Column]:
    """What makes a label worth a second reading; items have score, confidence and rule_score."""
    return {"low": F.col("confidence") == "low", "conflict": scoring.crosses("rule_score", "score"), "strict": F.col("score") == 3}


def audited(ads: DataFrame, labels: DataFrame, source: Labels, seed: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels after adjudication, the compared sample, its metrics): the second reading of a sample."""
    texts = ads.select("canonical_id", ad_text().alias("text"))
    framed = labels.join(texts.select("canonical_id", scoring.dictionary_hits("text")["score"].alias("rule_score")), "canonical_id")
    second = lambda ids: source.of(texts.join(ids, "canonical_id", "left_semi"), "audit")
    third = lambda asked: source.of(texts.join(asked, "canonical_id"), "adjudication")
    framed = settled(framed)
    made, compared, _ = audit.reliability(framed, "canonical_id", seed, size, second, third, **audit_targets(framed))
    made, compared = settled(made), settled(compared)
    decided = made.select("canonical_id", F.when(F.col("label_status") == STATUS["adjudication"], F.col("score")).alias("adjudicated_score"), F.when(F.col("label_status") == STATUS["adjudication"], F.col("reason")).alias("adjudication_reason"))
    return made.drop("rule_score"), settled(compared.join(decided, "canonical_id", "left")), agreement.agreement(compared, "primary_score", "audit_score")


def version_changes(before: DataFrame, labels: DataFrame, ads: DataFrame) -> dict[str, DataFrame]:
    """Items, years and a summary of what changed from an earlier version's labels(canonical_id, score)."""
    both = before.select("canonical_id", F.col("score").alias("a")).join(labels.select("canonical_id", F.col("score").alias("b")), "canonical_id")
    years = ads.select("canonical_id", "year").join(both, "canonical_id")
    items, yearly = annual.item_changes(both, "a", "b", "canonical_id"), annual.annual_changes(annual.summary(years, score="a"), annual.summary(years, score="b"))
    return {"label_comparison": items, "annual_comparison": yearly, "summary": annual.change_summary(items, yearly)}


def run_checks(made: Run, *, provisional: bool) -> DataFrame:
    """(check, violations) of everything that has to hold before a run is published."""
    ads, matches, labels, yearly = made.ads, made.matches, made.labels, made.annual
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    filled = lambda name, columns: {f"{name}_{c}_blank": blank(c) for c in columns}
    known = F.col("match_status") == "matched"
    ids = ads.select("canonical_id")
    found = [
        checks.unique_key(ads, ["canonical_id"], "ads_unique"), checks.unique_key(made.firms, ["股票代码"], "firms_unique"),
        checks.unique_key(made.duplicates, ["source_id"], "lineage_unique"), checks.unique_key(matches, ["canonical_id"], "matches_unique"),
        checks.unique_key(labels, ["canonical_id"], "labels_unique"), checks.unique_key(yearly, ["year"], "years_unique"), checks.unique_key(made.match_review, ["canonical_id"], "review_unique"),
        checks.complete_mapping(ids, matches, "canonical_id", "matches_complete"), checks.complete_mapping(ids, labels, "canonical_id", "labels_complete"),
        checks.complete_mapping(made.duplicates.select("canonical_id").distinct(), ads, "canonical_id", "lineage_complete"),
        checks.complete_mapping(matches.where(F.col("match_method") != matching.EXACT), made.match_review, "canonical_id", "review_complete"),
        checks.row_rules(ads, {"marker_left": F.concat_ws(" ", *schemas.AD_FIELDS).rlike(text.MARKER)} | filled("ads", ("canonical_id", "source_ids", "duplicate_group_size", "published_date", "year", "岗位"))),
        checks.row_rules(made.firms, filled("firms", ("股票代码", "证券简称", "公司全称"))),
        checks.row_rules(matches, {"matched_without_result": known & (blank("code") | blank("matched_name") | blank("证券简称") | blank("match_note")), "unmatched_without_reason": ~known & blank("unmatched_reason")}),
        checks.row_rules(labels, {"score_range": ~F.coalesce(F.col("score").between(0, 3), F.lit(False))} | filled("labels", ("confidence", "content_hash", "label_status"))),
        checks.row_rules(yearly, {"unlabelled": F.col("n_unlabelled") > 0, "share_bounds": F.exists(F.array(*SHARES), lambda x: ~F.coalesce(x.between(0, 1), F.lit(False)))}),
        checks.row_count(ads, _total(yearly), "denominator"),
        checks.provenance(made.rules),
    ]
    if not provisional:
        texts = ads.select("canonical_id", ad_text().alias("__text"))
        judged = labels.withColumn("evidence", text.split_list(F.coalesce("evidence", F.lit("")))).join(texts, "canonical_id", "left")
        found += [
            checks.row_rules(judged, checks.label_rules("__text", "岗位：") | {"provisional_left": F.col("label_status").startswith("provisional"), "model_score_range": ~F.coalesce(F.col("model_score").between(0, 3), F.lit(False))}),
            checks.one_value(labels, "prompt_version", "one_prompt_version"), checks.one_value(labels, "prompt_fingerprint", "one_fingerprint")]
    if made.sample is not None:
        differ = F.col("disagrees")
        found += [
            checks.unique_key(made.sample, ["canonical_id"], "sample_unique"),
            checks.row_rules(made.sample, {"not_adjudicated": differ & (F.col("adjudicated_score").isNull() | blank("adjudication_reason"))})]
    return settled(checks.union(found))


def _total(yearly: DataFrame) -> int:
    return yearly.agg(F.coalesce(F.sum(F.col("n_ads") + F.col("n_unlabelled")), F.lit(0)).alias("n")).first()["n"]


def plan(ads_raw: DataFrame, firms_raw: DataFrame, rules: DataFrame, source: Labels | None, fingerprint: str = "rubric", *, seed: int = 20260628, audit_size: int = 0, before: DataFrame | None = None) -> Run:
    """All tables of a run; without a source labels are the dictionary's and say so.

    audit_size: rows of the second reading, 0 for none. before: an earlier version's labels.
    """
    ads, duplicates, stats = map(settled, clean_ads(ads_raw))
    firms = settled(clean_firms(firms_raw))
    renamed = rules.select("pattern", F.col("stock_code").alias("code"), F.col("match_method").alias("method"), F.col("match_note").alias("note"))
    names = ["公司名称", "关联公司名称"]
    matches = matching.match(ads, "canonical_id", names, firms, renamed, key=text.company_key, master_name="公司全称", code_col="股票代码", attributes=["证券简称", "证监会行业"])
    matches = settled(matches)
    unmatched = ads.join(matches.where("match_status = 'unmatched'"), "canonical_id", "left_semi")
    scored = similarity.candidates(unmatched, "canonical_id", names, firms, "公司全称", "股票代码")
    named = firms.select(F.col("股票代码").alias("candidate_code"), F.col("公司全称").alias("candidate_company"))
    candidates = settled(matching.top_candidates(scored, "canonical_id").join(named, "candidate_code", "left").withColumn("accepted", F.lit(False)))
    review = matching.review_ledger(matches, candidates, "canonical_id")
    sample = metrics = None
    if source is None:
        labels = settled(labeling.provisional(ads, "canonical_id", ad_text(), fingerprint))
    else:
        labels = source.of(ads.select("canonical_id", ad_text().alias("text")), "primary")
        if audit_size:
            labels, sample, metrics = audited(ads, labels, source, seed, audit_size)
    yearly = settled(annual.summary(ads.select("canonical_id", "year").join(labels.select("canonical_id", "score"), "canonical_id", "left")))
    changes = version_changes(before, labels, ads) if before is not None else {}
    made = Run(ads, duplicates, stats, firms, matches, candidates, review, labels, yearly, stats, rules, sample, metrics, changes)
    made.checks = run_checks(made, provisional=source is None)
    return made


def _report(made: Run) -> str:
    by_method = made.matches.groupBy("match_method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("firms")).orderBy("match_method")
    scores = made.labels.groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy("score")
    reviewed = made.match_review.groupBy("review_decision").agg(F.count(F.lit(1)).alias("n")).orderBy("review_decision")
    sections: dict[str, DataFrame | str] = {
        "Data and cleaning": made.stats, "Company matches": by_method, "Matches that a person looked at": reviewed, "Scores": scores, "Years": made.annual.orderBy("year"),
        "Reliability": made.reliability if made.reliability is not None else "There was no second reading in this run.",
        "Earlier version": made.changes["summary"] if made.changes else "There is no earlier version to compare with.",
        "Limits": "Texts are what advertisers wrote; shares of small years have wide intervals, which the table of years shows.",
        "How to repeat this": "The run reads its labels from the log; the same inputs, log, seed and versions give the same tables, and `verify` recomputes them.",
    }
    return sinks.report("Run", sections)


def publish(made: Run, target: str, *, metadata: Mapping[str, object] | None = None) -> None:
    """Writes all tables, the report, the manifest of files and an archive, after all checks passed; else
    nothing changes. Tables are computed once: what is checked and reported is read from the staged ones."""
    checks.require(made.checks)
    spark = made.ads.sparkSession
    with sinks.Outputs(spark, target) as folder:
        store = Store(spark)
        for name in TABLES:
            sinks.write_parquet(getattr(made, name), f"{folder}/{name}")
        kept = Run(**{k: spark.read.parquet(f"{folder}/{k}") if k in TABLES else v for k, v in vars(made).items()})
        for name in AT_THE_EDGE:
            order = "year" if name == "annual" else F.col("canonical_id").try_cast("bigint")
            sinks.write_csv_file(getattr(kept, name).orderBy(order), f"{folder}/{name}.csv")
        sinks.write_json(made.stats, f"{folder}/stats.json")
        sinks.write_parquet(annual.chart_data(kept.annual), f"{folder}/chart_data")
        if set(MANIFEST) <= set(kept.labels.columns):
            sinks.write_csv_file(kept.labels.select(*MANIFEST).orderBy(F.col("canonical_id").try_cast("bigint")), f"{folder}/request_manifest.csv")
        if made.sample is not None:
            sinks.write_parquet(made.sample, f"{folder}/reliability_sample")
            sinks.write_json(made.reliability, f"{folder}/reliability.json")
        for name, df in made.changes.items():
            sinks.write_parquet(df, f"{folder}/{name}")
        store.write(f"{folder}/report.md", _report(kept).encode())
        sinks.write_document(spark, dict(metadata or {}), f"{folder}/run.json")
        blanks = checks.blank_counts(kept.ads.select("岗位标签", "待遇", "学历", "所在城市")).unionByName(checks.blank_counts(kept.matches.select("证监会行业")))
        verified = verify(spark, folder, sample=made.sample is not None)
        store.write(f"{folder}/verification.md", sinks.report("Verification", {"Result": "All checks passed.", "Checks": made.checks.unionByName(verified).orderBy("check"), "Blank optional values": blanks}).encode())
        listed = files.list_files(spark, folder, without=r"/[._]").select(F.regexp_replace("path", f"^.*/{re.escape(folder.rstrip('/').rpartition('/')[2])}/", "").alias("path"), "bytes", "sha256")
        sinks.write_csv_file(listed.orderBy("path"), f"{folder}/file_manifest.csv")
        names = sinks.archive(spark, folder, f"{folder}/run.zip")
        checks.require(verify_archive(spark, folder, names))


REQUIRED = ("matches.csv", "labels.csv", "annual.csv", "report.md", "verification.md", "file_manifest.csv", "stats.json", "run.json")


def verify_archive(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """What an archive must hold and must not: key files, nothing private, nothing like a key of a service."""
    missing = [("file_" + n, 0 if n in names else 1) for n in REQUIRED]
    private = sum(".env" in n or "private" in n.split("/") for n in names)
    texts = spark.read.text([f"{folder}/{n}" for n in names if n.endswith((".md", ".json", ".csv"))])
    secret = checks.row_rules(texts, {"secret_like": F.col("value").rlike(checks.SECRET)})
    return spark.createDataFrame([*missing, ("private_files", private)], "check string, violations bigint").unionByName(secret)


def run(spark: SparkSession, ads: str, firms: str, rules: str, target: str, *, source: Labels | None = None, fingerprint: str = "rubric", seed: int = 20260628, audit_size: int = 0, baselines: str | None = None) -> Run:
    """A whole run from CSV files. baselines: a folder where the outputs of an earlier version are kept,
    once, before they are replaced; the run's labels are then compared with theirs."""
    before = None
    if baselines and Store(spark).exists(f"{target}/labels"):
        old = spark.read.parquet(f"{target}/labels")
        versions = [r[0] for r in old.select("prompt_version").distinct().collect()] if "prompt_version" in old.columns else []
        if len(versions) == 1 and source is not None and versions[0] != source.versions.prompt_version:
            label = text.version_label(versions[0])
            sinks.snapshot_once(spark, target, baselines, label)
            before = spark.read.parquet(f"{baselines}/{label}/labels")
    made = plan(
        files.read_exact_csv(spark, ads, schemas.ADS_RAW), files.read_csv(spark, firms, schemas.FIRMS), files.read_csv(spark, rules, schemas.ALIAS_RULES),
        source, fingerprint, seed=seed, audit_size=audit_size, before=before)
    publish(made, target, metadata={"seed": seed, "audit_size": audit_size, "offline": source is None or source.labeller is None, "versions": vars(source.versions) if source else {"prompt_fingerprint": fingerprint}})
    return made


def verify(spark: SparkSession, target: str, *, sample: bool | None = None) -> DataFrame:
    """Recomputes what was published and raises one error for all that differs."""
    store = Store(spark)
    if missing := [n for n in ("ads", "duplicates", "matches", "labels", "annual") if not store.exists(f"{target}/{n}")]:
        raise checks.QualityError(f"missing tables: {missing}")
    tables = {n: spark.read.parquet(f"{target}/{n}") for n in ("ads", "duplicates", "matches", "labels", "annual")}
    again = annual.summary(tables["ads"].select("canonical_id", "year").join(tables["labels"].select("canonical_id", "score"), "canonical_id", "left"))
    found = [
        checks.same_values(tables["annual"], again, ["year"], ["n_ads", "n_score_ge_2", *SHARES], "annual_consistency"),
        checks.unique_key(tables["matches"], ["canonical_id"], "published_matches_unique"), checks.unique_key(tables["duplicates"], ["source_id"], "published_lineage_unique"),
        checks.unique_key(tables["labels"], ["canonical_id"], "published_labels_unique"),
        checks.complete_mapping(tables["ads"].select("canonical_id"), tables["labels"], "canonical_id", "published_labels_complete"),
    ]
    if store.exists(f"{target}/reliability.json") if sample is None else sample:
        stored = files.read_json_document(spark, f"{target}/reliability.json")
        now = agreement.agreement(spark.read.parquet(f"{target}/reliability_sample"), "primary_score", "audit_score").first().asDict()
        off = [k for k, v in now.items() if (stored.get(k) != v if not isinstance(v, float) else stored.get(k) is None or abs(stored[k] - v) > 1e-12)]
        found.append(spark.createDataFrame([("reliability_metrics", len(off))], "check string, violations bigint"))
    made = checks.union(found)
    checks.require(made)
    return made


def evaluate(reference: DataFrame, predictions: DataFrame, id_col: str = "canonical_id") -> tuple[DataFrame, DataFrame]:
    """(judgements, metrics with gates) of predictions against a human reference."""
    judged = evaluation.judged(reference, predictions, id_col)
    valid = judged.agg(F.bool_and("schema_valid").alias("schema_valid"))
    metrics = agreement.agreement(judged, "human_score", "score").crossJoin(F.broadcast(valid))
    return judged, agreement.release_gates(metrics, schema_valid="schema_valid")


def stability(trials: Sequence[DataFrame], id_col: str = "canonical_id") -> DataFrame:
    """Stability of trials of the same items, refused unless all of them share one fingerprint."""
    if all("prompt_fingerprint" in t.columns for t in trials):
        together = trials[0].select("prompt_fingerprint")
        for t in trials[1:]:
            together = together.unionAll(t.select("prompt_fingerprint"))
        checks.require(checks.one_value(together, "prompt_fingerprint", "one_fingerprint"))
    return agreement.stability(list(trials), id_col, "score")


def prepare_human_evaluation(frame: DataFrame, ads: DataFrame, target: str, *, seed: int = 20260628, version: str = "v2_1", shown: Sequence[str] = ("岗位", "岗位描述", "岗位标签")) -> dict[str, list[str]]:
    """Development and holdout samples: for each a blind sheet as CSV and as a workbook, and a private map
    of its ids; what is wrong with a sheet (nothing, in the end) by split.

    frame: a sampling frame (canonical_id, score, candidate, risk_points and more); ads: the texts shown.
    """
    spark = frame.sparkSession
    both = sampling.review_splits(frame, "canonical_id", seed, version=version)
    rows = both.join(ads.select("canonical_id", *shown), "canonical_id")
    choices = {"human_score": ["0", "1", "2", "3"], "technology_role": list(scoring.ROLES), "strict_ai": ["true", "false"], "human_confidence": list(scoring.CONFIDENCES)}
    notes = [("task", "Fill in every coloured cell; the texts stay as they are."), ("evidence", "Copy a stretch of one field without any change; a score of 0 needs none."), ("scores", "none is 0, auxiliary 1, core 2, core with strict AI 3.")]
    wrong = {}
    with sinks.Outputs(spark, target) as folder:
        sinks.write_parquet(both, f"{folder}/private/review_id_map")
        for split, quotas in (("development", sampling.DEVELOPMENT), ("holdout", sampling.HOLDOUT)):
            sheet = sampling.blind(rows.where(F.col("split") == split), list(shown), seed)
            wrong[split] = sampling.blind_leaks(sheet, {"canonical_id", "score", "split", "risk_points", "candidate", "rule_score"}, sum(quotas.values()))
            if wrong[split]:
                raise ValueError(f"{split} sheet: {wrong[split]}")
            sinks.write_csv_file(sheet, f"{folder}/{split}.csv")
            write_workbook(sheet, f"{folder}/{split}.xlsx", split, choices=choices, inputs=sampling.INPUTS, notes=notes)
        counts = both.groupBy("split", "score").agg(F.count(F.lit(1)).alias("n")).orderBy("split", "score")
        Store(spark).write(f"{folder}/README.md", sinks.report("Human evaluation", {"Rows": counts, "Columns to fill in": ", ".join(sampling.INPUTS)}).encode())
    return wrong
