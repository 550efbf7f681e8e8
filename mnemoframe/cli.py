"""Command line: run, score, aggregate, smoke, validate, render, review."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from mnemoframe.config import RunConfig
from mnemoframe.operators import quality, render
from mnemoframe.plans import experiments
from mnemoframe.sources import files


def session() -> SparkSession:
    return SparkSession.builder.appName("mnemoframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemoframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("run")
    c.add_argument("--config", required=True)
    c.add_argument("--out")
    c.add_argument("--offline", action="store_true", help="let the native store stand in for an external one")
    c = sub.add_parser("score")
    c.add_argument("--runs", required=True)
    c.add_argument("--facts")
    c = sub.add_parser("aggregate")
    c.add_argument("--runs", required=True)
    c = sub.add_parser("smoke")
    c.add_argument("--out", required=True)
    c.add_argument("--store-lang", default="hi")
    c.add_argument("--probe-lang", default="en")
    c = sub.add_parser("validate")
    c.add_argument("banks", nargs="+")
    c = sub.add_parser("render")
    c.add_argument("--template", required=True)
    c.add_argument("--entities", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--batch", type=int, default=1)
    c = sub.add_parser("review")
    c.add_argument("--templates", nargs="+", required=True)
    c.add_argument("--entities", required=True)
    c.add_argument("--hand", nargs="*", default=[], help="hand-written banks, whose sentences and clashes are listed too")
    c.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = session()
    if args.command == "run":
        config = RunConfig.from_yaml(args.config)
        print("\n".join(experiments.run_experiment(spark, config, args.out or config.output_dir, offline=args.offline)))
    elif args.command == "score":
        experiments.score_logs(spark, args.runs, experiments.facts_or_smoke(spark, args.facts)).show(truncate=False)
    elif args.command == "aggregate":
        experiments.aggregate_scores(files.read_scores(spark, args.runs), args.runs).show(1000, truncate=False)
    elif args.command == "smoke":
        config = RunConfig("smoke", languages={"store": args.store_lang, "probe": args.probe_lang}, seeds=[1])
        facts = files.facts_frame(spark, experiments.SMOKE_FACTS)
        experiments.run_experiment(spark, config, args.out, facts)
        scores = experiments.score_logs(spark, args.out, facts)
        scores.show(truncate=False)
        return 0 if scores.filter("write_fidelity > 0").count() else 1
    elif args.command == "validate":
        bad = files.bank_errors(args.banks)
        for path, message in bad:
            print(f"{path}: {message}")
        good = [p for p in args.banks if p not in {x for x, _ in bad}]
        if good:
            raw = files.read_raw_banks(spark, good)
            print(quality.report_text(raw.drop("file_no")))
            across = quality.collisions(raw).orderBy("file", "seq").collect()
            for x in across + quality.bank_overlaps(raw).orderBy("seq").collect():
                print(f"  [{x.fact_id}] {x.severity}: {x.message}")
            failed = quality.report(raw.drop("file_no")).filter("NOT is_valid").count() or any(x.severity == "error" for x in across)
            return int(bool(bad) or bool(failed))
        return 1
    elif args.command == "render":
        t = files.read_templates(spark, [args.template], args.entities)
        facts = render.render(t["plan"], t["relations"], t["lexicon"], t["entities"], args.batch)
        print(files.write_bank(facts, args.out), "facts")
    elif args.command == "review":
        t = files.read_templates(spark, args.templates, args.entities)
        facts = render.render(t["plan"], t["relations"], t["lexicon"], t["entities"])
        hand, raw = files.read_hand_written(spark, args.hand), files.read_raw_banks(spark, args.hand)
        sheets = render.review_sheets(facts, t["relations"], t["lexicon"], t["entities"], hand, raw)
        files.write_xlsx(args.out, sheets, render.REVIEW_COLUMNS, {"How to review": render.REVIEW_NOTES})
    return 0


if __name__ == "__main__":
    sys.exit(main())
