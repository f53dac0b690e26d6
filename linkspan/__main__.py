"""python -m linkspan run|evaluate|validate|profile"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from linkspan.operators import evaluation
from linkspan.plans import runs
from linkspan.sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkspan", description="Record linkage over TSV folders.")
    steps = top.add_subparsers(dest="step", required=True)
    run = steps.add_parser("run", help="candidates, training, matching, validation")
    run.add_argument("--mode", choices=runs.MODES, default="all")
    run.add_argument("--skip-blocking", action="store_true", help="use the candidates that are there")
    run.add_argument("--train")
    run.add_argument("--test")
    run.add_argument("--out", required=True)
    run.add_argument("--threshold", type=float, default=0.5)
    run.add_argument("--neg-ratio", type=int, default=5)
    run.add_argument("--top-k", type=int, default=15)
    evaluate = steps.add_parser("evaluate", help="hold-out macro F0.5")
    evaluate.add_argument("--train", required=True)
    evaluate.add_argument("--val-ratio", type=float, default=0.2)
    evaluate.add_argument("--threshold", type=float, default=0.5)
    evaluate.add_argument("--neg-ratio", type=int, default=5)
    validate = steps.add_parser("validate", help="findings of written lists")
    validate.add_argument("--test", required=True)
    validate.add_argument("--out", required=True)
    validate.add_argument("--check-ids", action="store_true")
    profile = steps.add_parser("profile", help="Markdown profile of a folder")
    profile.add_argument("--data", required=True)
    profile.add_argument("--out", help="also write it to this folder")
    return top


def main(argv: list[str] | None = None) -> int:
    """0, or 1 if a finding is an error."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName("linkspan").getOrCreate()
    findings = None
    if args.step == "run":
        findings = runs.run(spark, args.out, args.train, args.test, args.mode, args.skip_blocking, args.threshold, args.neg_ratio, args.top_k)
    elif args.step == "validate":
        findings = runs.check(spark, args.test, args.out, args.check_ids)
    elif args.step == "evaluate":
        truth = tables.read_tsv(spark, f"{args.train}/truth.tsv", tables.TRUTH_SCHEMA)
        totals, _ = evaluation.run_evaluation(*runs.sources(spark, args.train), truth, args.val_ratio, args.threshold, args.neg_ratio)
        print(totals.first().asDict())
    else:
        print(runs.report(spark, args.data, out=args.out), end="")
    if findings is None:
        return 0
    rows = findings.collect()  # a row a rule
    for row in rows:
        print(*row, sep="\t")
    return 1 if any(r.severity == "error" for r in rows) else 0


if __name__ == "__main__":
    sys.exit(main())
