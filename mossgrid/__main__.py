"""Command line: python -m mossgrid {validate,prepare,evaluate,submit,run} ...

A model is named as ``package.module:function``; the function takes a pandas frame of rows and
gives a list of outputs.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from mossgrid.operators import entry, preparation, submit
from mossgrid.plans.runtime import build_session
from mossgrid.sources import question_files


def _function(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _named(text: str) -> tuple[str, object]:
    name, _, function = text.partition("=")
    return name, _function(function)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mossgrid", description="Prepare, validate, evaluate and submit question benchmarks.")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("validate", help="structure of a benchmark folder; exit code 1 on any issue")
    p.add_argument("--base_dir", default="organized_dataset")
    p.add_argument("--check_images", action="store_true")
    p.add_argument("--image_sample_size", type=int, default=100)
    p.add_argument("--decode", action="store_true", help="decode images as a whole")
    p.add_argument("--report", help="write a report of the datasets to this file")
    p = commands.add_parser("prepare", help="samples of the question files as tables")
    p.add_argument("--base_dir", default="organized_dataset")
    p.add_argument("--output_dir", default="processed_data")
    p.add_argument("--max_samples", type=int)
    p.add_argument("--use_subset", action="store_true")
    p.add_argument("--decode", action="store_true")
    p = commands.add_parser("evaluate", help="metrics of predictions, and a comparison with a base model")
    p.add_argument("--predictions", required=True)
    p.add_argument("--references", required=True)
    p.add_argument("--output_dir", default="evaluation_results")
    p.add_argument("--tuned", required=True)
    p.add_argument("--base")
    p.add_argument("--task_type")
    p.add_argument("--max_eval_samples", type=int, default=0)
    p.add_argument("--save_predictions", action="store_true")
    p = commands.add_parser("submit", help="answers of a model to all question files of a folder")
    p.add_argument("--dataset_path", required=True)
    p.add_argument("--model", required=True, type=_function)
    p.add_argument("--output_file", default="predictions.json")
    p = commands.add_parser("run", help="validate, prepare and evaluate")
    p.add_argument("--base-dir", default="organized_dataset")
    p.add_argument("--output-dir", default="work")
    p.add_argument("--model", action="append", required=True, type=_named, help="name=package.module:function; the base model first")
    p.add_argument("--use-subset", action="store_true")
    p.add_argument("--max-samples", type=int)
    for step in ("validation", "prepare", "eval"):
        p.add_argument(f"--skip-{step}", action="store_true")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = build_session("mossgrid")
    if a.command == "validate":
        good, issues = preparation.validate(spark, a.base_dir, check_images=a.check_images, n=a.image_sample_size, decode=a.decode)
        print("\n".join(preparation.shown_issues(issues)))
        if a.report:
            preparation.write_text(spark, a.report, preparation.validation_report(spark, a.base_dir))
        return int(not good)
    if a.command == "prepare":
        chosen = question_files.TRIAL if a.use_subset else None
        preparation.prepare(spark, a.base_dir, a.output_dir, max_samples=a.max_samples, datasets=chosen, decode=a.decode).show(100, False)
        print(preparation.saved_counts(spark, a.output_dir))
    elif a.command == "evaluate":
        tables = spark.read.parquet(a.predictions), spark.read.parquet(a.references)
        entry.evaluate(
            *tables, a.output_dir, tuned=a.tuned, base=a.base, task=a.task_type, max_samples=a.max_eval_samples, save_predictions=a.save_predictions
        ).orderBy("model", "task", "metric").show(500, False)
    elif a.command == "submit":
        submit.submit(spark, a.dataset_path, a.model, a.output_file).orderBy("TaskType").show(100, False)
    else:
        skip = {f"skip_{step}": getattr(a, f"skip_{step}") for step in ("validation", "prepare", "eval")}
        done = entry.run(spark, a.base_dir, a.output_dir, dict(a.model), subset=a.use_subset, max_samples=a.max_samples, **skip)
        if done is not None:
            done.orderBy("model", "task", "metric").show(500, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
