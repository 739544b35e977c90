"""Entry points: evaluation of one or two models with all result files, and the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.operators import evaluation as E
from mossgrid.operators import preparation, submit
from mossgrid.plans.runtime import write_text, written
from mossgrid.sources import question_files, results


def details(values: DataFrame) -> DataFrame:
    """Question, output, parsed output as text, reference and validity of every pair."""
    boxes = F.array_join(F.transform("p_boxes", lambda b: F.array_join(b.cast("array<string>"), ",")), ";")
    shown = F.coalesce("p_label", F.array_join("p_labels", "; "), boxes, F.to_json("p_inst"), F.col("p_number").cast("string"), "p_text")
    return values.select(
        "pred_id", "model", "task", "question", F.col("output").alias("model_output"), shown.alias("parsed_output"), "reference",
        F.col("valid").alias("valid_for_metrics"),
    )


def evaluate(
    predictions: DataFrame,
    references: DataFrame,
    out: str,
    *,
    tuned: str,
    base: str | None = None,
    task: str | None = None,
    max_samples: int = 0,
    save_predictions: bool = False,
    all_tasks: bool = False,
) -> DataFrame:
    """Evaluates the predictions of one or two models and writes under ``out``:
    ``{model}/evaluation_results.json``, ``evaluation_summary.txt`` and, with a base model,
    ``model_comparison.json`` and ``model_comparison.txt``; predictions as parquet if asked for.

    ``task`` and ``max_samples`` keep one task and the first samples of each; ``all_tasks``
    adds the metrics of tasks without samples. Returns (model, task, metric, value).
    """
    spark = predictions.sparkSession
    models = [m for m in (base, tuned) if m is not None]
    pairs = E.evaluation_pairs(predictions.where(F.col("model").isin(models)), references)
    if task is not None:
        pairs = E.only_task(pairs, task)
    values = written(E.parsed(E.first_per_task(pairs, max_samples)))
    long = E.metrics(values)
    long = written(E.with_no_pairs(long) if all_tasks and task is None else long)
    counts = written(E.task_counts(values))
    for model in models:
        results.write_results(long, counts, model, f"{out}/{model}/evaluation_results.json")
    if save_predictions:
        details(values).write.mode("overwrite").partitionBy("model").parquet(f"{out}/predictions")
    write_text(spark, f"{out}/evaluation_summary.txt", results.summary_text(long, counts))
    if base is not None:
        of = lambda m: long.where(F.col("model") == m)
        compared = written(E.compare(of(base), of(tuned)))
        results.write_comparison(compared, E.comparison_rollup(compared), f"{out}/model_comparison.json")
        write_text(spark, f"{out}/model_comparison.txt", results.comparison_text(compared))
    return long


def predicted(spark: SparkSession, prepared: str, predict: dict[str, Callable[[pd.DataFrame], list[str | None]]]) -> tuple[DataFrame, DataFrame]:
    """(predictions, references) of prepared samples, answered by one or more models."""
    samples = written(spark.read.parquet(prepared).withColumn("rec_id", F.monotonically_increasing_id()))
    references = samples.select("rec_id", F.col("answer").alias("Answer"))
    parts = []
    for model, say in predict.items():
        said = submit.with_outputs(samples, say).select(
            F.xxhash64(F.lit(model), "rec_id").alias("pred_id"), "rec_id", F.lit(model).alias("model"), F.col("task_type").alias("TaskType"),
            F.col("question").alias("Question"), F.col("output").alias("Answer"),
        )
        parts.append(said)
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    return written(predictions), references


def run(
    spark: SparkSession,
    base_dir: str,
    work_dir: str,
    predict: dict[str, Callable[[pd.DataFrame], list[str | None]]],
    *,
    subset: bool = False,
    max_samples: int | None = None,
    skip_validation: bool = False,
    skip_prepare: bool = False,
    skip_eval: bool = False,
) -> DataFrame | None:
    """Validation, preparation and evaluation in order; an issue of the first ends the run.

    ``predict``: the models by name, the base model first. Training is outside; the tuned
    model is given as it is. Returns the metrics, nothing if evaluation is skipped.
    """
    if not skip_validation:
        good, issues = preparation.validate(spark, base_dir, check_images=True)
        if not good:
            raise ValueError("\n".join(preparation.shown_issues(issues)))
    if not skip_prepare:
        preparation.prepare(spark, base_dir, f"{work_dir}/prepared", max_samples=max_samples, datasets=question_files.TRIAL if subset else None)
    if skip_eval:
        return None
    predictions, references = predicted(spark, f"{work_dir}/prepared/validation", predict)
    *first, tuned = predict
    return evaluate(predictions, references, f"{work_dir}/evaluation", tuned=tuned, base=first[0] if first else None)
