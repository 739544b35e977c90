"""Result files: metrics and comparison as JSON, summary and comparison as text.

Results are as small as models times tasks times metrics; they are written by the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame

from mossgrid.operators.evaluation import comparison_details, comparison_lines
from mossgrid.plans.runtime import write_text


def encodable(value):
    """The value with numbers that aren't finite as text."""
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {k: encodable(v) for k, v in value.items()}
    if isinstance(value, list):
        return [encodable(v) for v in value]
    return value


def _write(df: DataFrame, path: str, value) -> None:
    write_text(df.sparkSession, path, json.dumps(encodable(value), indent=2, ensure_ascii=False))


def write_results(metrics: DataFrame, counts: DataFrame, model: str, path: str) -> None:
    """Metrics and counts of one model by task, with the totals under ``overall``."""
    tasks: dict[str, dict] = {}
    for r in counts.where(counts["model"] == model).collect():
        tasks[r["task"]] = {k: r[k] for k in ("num_examples", "valid_examples", "skipped_examples")}
    for r in metrics.where(metrics["model"] == model).orderBy("task", "metric").collect():
        tasks.setdefault(r["task"], {}).setdefault("metrics", {})[r["metric"]] = r["value"]
    _write(metrics, path, tasks)


def write_comparison(compared: DataFrame, rollup: DataFrame, path: str) -> None:
    """Comparison by task and metric, and the roll-up."""
    tasks: dict[str, dict] = {}
    for r in compared.orderBy("task", "metric").collect():
        row = r.asDict()
        tasks.setdefault(row.pop("task"), {})[row.pop("metric")] = row
    details = {r["task"]: {k: r[k] for k in r.asDict() if k != "task"} for r in comparison_details(compared).collect()}
    _write(compared, path, {"tasks": tasks, "overall": rollup.first().asDict() | {"details": details}})


def summary_text(metrics: DataFrame, counts: DataFrame) -> str:
    """Per model and task the counts and the metrics, with four decimals."""
    values: dict[tuple, list[str]] = {}
    for r in metrics.orderBy("model", "task", "metric").collect():
        shown = f"{r['value']:.4f}" if math.isfinite(r["value"]) else str(r["value"])
        values.setdefault((r["model"], r["task"]), []).append(f"    {r['metric']}: {shown}")
    lines = ["Evaluation summary"]
    for r in counts.orderBy("model", "task").collect():
        lines.append(f"{r['model']}, {r['task']}: {r['valid_examples']} of {r['num_examples']} valid")
        lines += values.get((r["model"], r["task"]), [])
    return "\n".join(lines) + "\n"


def comparison_text(compared: DataFrame) -> str:
    """Report lines by task, the primary metric first."""
    lines, task = ["Model comparison"], None
    for r in comparison_lines(compared).orderBy("task", "place").collect():
        if r["task"] != task:
            task = r["task"]
            lines.append(f"{task}:")
        lines.append(r["line"])
    return "\n".join(lines) + "\n"
