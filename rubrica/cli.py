"""Command line: run, verify, prepare-human-eval, evaluate-development, evaluate-stability."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.operators import evaluation, labeling
from rubrica.plans import pipeline
from rubrica.sources import schemas, sinks
from rubrica.sources.files import read_csv, read_yaml_document
from rubrica.sources.store import Store

ROUNDS, TRIALS = (1, 2, 3), (2, 3)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rubrica")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("run", help="clean, match, label from the log, audit, compare, check and publish")
    for name in ("ads", "firms", "rules", "target"):
        c.add_argument(name)
    c.add_argument("--labels", help="folder of label logs, one per stage; a missing or stale label is an error. Without it labels are the dictionary's and provisional")
    c.add_argument("--model", default="")
    c.add_argument("--prompt-version", default="1.0.0")
    c.add_argument("--schema-version", default="1.0.0")
    c.add_argument("--fingerprint", default="rubric")
    c.add_argument("--rubric", help="YAML; the fingerprint is then that of the rubric, the model and the versions")
    c.add_argument("--thinking", action="store_true")
    c.add_argument("--seed", type=int, default=20260628)
    c.add_argument("--audit", type=int, default=0, help="rows of the second reading")
    c.add_argument("--baselines", help="folder that keeps the outputs of earlier versions")
    commands.add_parser("verify", help="recompute published tables").add_argument("target")
    c = commands.add_parser("prepare-human-eval", help="blind review sheets (CSV and workbook) of a sampling frame in Parquet, with a private map")
    for name in ("frame", "ads", "target"):
        c.add_argument(name)
    c.add_argument("--seed", type=int, default=20260628)
    c.add_argument("--version", default="v2_1")
    c.add_argument("--show", nargs="*", default=["岗位", "岗位描述", "岗位标签"])
    c = commands.add_parser("evaluate-development", help="a round's predictions against the human reference, both Parquet or CSV")
    for name in ("reference", "predictions", "target"):
        c.add_argument(name)
    c.add_argument("--round", type=int, choices=ROUNDS, required=True)
    c = commands.add_parser("evaluate-stability", help="a trial's labels beside the frozen first one; after the last trial, stability over all")
    for name in ("reference", "predictions", "target"):
        c.add_argument(name)
    c.add_argument("--trial", type=int, choices=TRIALS, required=True)
    return top


def _table(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    head = spark.read.option("header", True).csv(path).limit(0)
    df = read_csv(spark, path, schemas.text_schema(*head.columns))
    return df.withColumns({c: F.col(c).cast("int") for c in ("score", "human_score") if c in df.columns})


def _evaluated(spark: SparkSession, args: argparse.Namespace, name: str) -> None:
    """Metrics with gates, error counts and the errors of one prediction, in a folder of its own."""
    judged, metrics = pipeline.evaluate(_table(spark, args.reference), _table(spark, args.predictions))
    with sinks.Outputs(spark, f"{args.target}/{name}") as folder:
        sinks.write_csv_file(judged.where("error_type <> 'match'").orderBy("canonical_id"), f"{folder}/errors.csv")
        sinks.write_csv_file(evaluation.error_counts(judged).orderBy("error_type"), f"{folder}/error_counts.csv")
        sinks.write_parquet(_table(spark, args.predictions), f"{folder}/predictions")
        sinks.write_json(metrics, f"{folder}/metrics.json")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("rubrica").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "run":
            fingerprint = args.fingerprint
            if args.rubric:
                fingerprint = labeling.prompt_fingerprint(read_yaml_document(spark, args.rubric), stage="primary", model=args.model, versions={"prompt": args.prompt_version, "schema": args.schema_version}, thinking=args.thinking)
            versions = labeling.Versions(args.model, args.prompt_version, args.schema_version, fingerprint, args.thinking)
            source = pipeline.Labels(args.labels, versions) if args.labels else None
            pipeline.run(spark, args.ads, args.firms, args.rules, args.target, source=source, fingerprint=fingerprint, seed=args.seed, audit_size=args.audit, baselines=args.baselines)
        elif args.command == "verify":
            pipeline.verify(spark, args.target)
        elif args.command == "prepare-human-eval":
            pipeline.prepare_human_evaluation(spark.read.parquet(args.frame), spark.read.parquet(args.ads), args.target, seed=args.seed, version=args.version, shown=args.show)
        elif args.command == "evaluate-development":
            _evaluated(spark, args, f"development_round_{args.round}")
        else:
            _evaluated(spark, args, f"stability_trial_{args.trial}")
            made = [f"{args.target}/development_round_{ROUNDS[-1]}/predictions", *[f"{args.target}/stability_trial_{t}/predictions" for t in TRIALS]]
            if all(Store(spark).exists(p) for p in made):
                sinks.write_json(pipeline.stability([spark.read.parquet(p) for p in made]), f"{args.target}/stability.json")
    except ValueError as e:
        print(f"rubrica: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
