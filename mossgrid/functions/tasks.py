"""Task names: normal form, routing, prompt instructions, submission keys.

Four matchers exist on purpose: routing for grouping, routing for parsing, exact lookup of
instructions, and the case-sensitive submission map differ in what they accept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrid.functions.fields import strip

# Primary metric of each task.
PRIMARY_METRIC = {
    "classification": "balanced_accuracy",
    "multi-label": "f1_score",
    "detection": "f1_score",
    "instance_detection": "f1_score",
    "counting": "mean_absolute_error",
    "regression": "mean_absolute_error",
    "report_generation": "green_score",
}

# Instruction before the question, by exact normal task name.
INSTRUCTIONS = {
    "classification": "Look at the image carefully and classify what you see. Provide a clear, specific answer.",
    "multi label classification": "Examine the image and identify all relevant labels or categories that apply. List them clearly.",
    "detection": "Examine the image and detect the specified objects or features. Be precise in your response.",
    "instance detection": "Look at the image and identify specific instances of the target objects. Provide precise detection results.",
    "counting": "Count the specified objects or features in the image. Provide an accurate numerical answer.",
    "regression": "Analyze the image and provide a quantitative assessment. Give your answer with appropriate precision.",
    "report generation": "Examine the medical image thoroughly and generate a report describing your findings.",
}
DEFAULT_INSTRUCTION = "Look at the image and answer the question accurately based on what you observe."
TRAINING_REPORT_INSTRUCTION = (
    "Examine the medical image thoroughly and generate a comprehensive report describing your findings."
)

# Prompts of the submission keys.
SUBMISSION_PROMPTS = {
    "classification": "Analyze this medical image and classify it. What is the primary diagnosis or finding?",
    "multi_label": "List all abnormalities and findings present in this medical image. Be comprehensive.",
    "detection": "Identify and locate all abnormalities in this medical image. Provide bounding box coordinates in format [x1,y1,x2,y2] for each finding.",
    "counting": "Count the number of {target} in this medical image. Provide only the numerical count.",
    "report_generation": "Generate a comprehensive medical report for this image. Include findings, impressions, and recommendations.",
    "vqa": "{question}",
}

# Submission keys, by exact name.
SUBMISSION_KEYS = {
    "classification": "classification",
    "Classification": "classification",
    "Multi-label Classification": "multi_label",
    "Detection": "detection",
    "Instance Detection": "detection",
    "Cell Counting": "counting",
    "Regression": "vqa",
    "Report Generation": "report_generation",
}


def task_name(raw: Column) -> Column:
    """Lower case, outer blanks gone, underscore and hyphen as blanks; null is classification."""
    return F.translate(strip(F.lower(F.coalesce(raw, F.lit("classification")))), "_-", "  ")


def _has(name: Column, *parts: str) -> Column:
    found = F.lit(True)
    for part in parts:
        found = found & name.contains(part)
    return found


def route(name: Column) -> Column:
    """Task group of a normal name; the order of the cases is part of the rule."""
    label_like = name.contains("multi") | name.contains("label")
    return (
        F.when(_has(name, "classification") & label_like, "multi-label")
        .when(_has(name, "classification"), "classification")
        .when(_has(name, "instance", "detection"), "instance_detection")
        .when(_has(name, "detection"), "detection")
        .when(_has(name, "counting"), "counting")
        .when(_has(name, "regression"), "regression")
        .when(name.contains("report") | name.contains("generation"), "report_generation")
        .otherwise(name)
    )


def parser_kind(name: Column) -> Column:
    """Parser of a normal name: unlike :func:`route`, classification must lack ``multi``."""
    return (
        F.when(_has(name, "classification") & ~name.contains("multi"), "classification")
        .when(_has(name, "multi", "label"), "multi-label")
        .when(_has(name, "instance", "detection"), "instance_detection")
        .when(_has(name, "detection"), "detection")
        .when(_has(name, "counting"), "counting")
        .when(_has(name, "regression"), "regression")
        .when(name.contains("report") | name.contains("generation"), "report_generation")
        .otherwise("default")
    )


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def instruction(name: Column, *, training: bool = False, n_images: Column | None = None) -> Column:
    """Instruction for a normal name. Training words reports differently and, for several
    images, speaks of them in the plural."""
    table = INSTRUCTIONS | ({"report generation": TRAINING_REPORT_INSTRUCTION} if training else {})
    text = _lookup(table, name, DEFAULT_INSTRUCTION)
    if training and n_images is not None:
        plural = F.replace(F.replace(text, F.lit("the image"), F.lit("the images")), F.lit("this image"), F.lit("these images"))
        text = F.when(n_images > 1, plural).otherwise(text)
    return text


def submission_key(raw: Column) -> Column:
    """Submission key of a raw task name; names are matched exactly, others classify."""
    return _lookup(SUBMISSION_KEYS, raw, "classification")


def primary_metric(task: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in PRIMARY_METRIC.items() for x in item]), task)


def submission_prompt(key: Column, target: Column, question: Column) -> Column:
    """Prompt template of a submission key with its places filled in."""
    pairs = [F.lit(x) for item in SUBMISSION_PROMPTS.items() for x in item]
    template = F.try_element_at(F.create_map(*pairs), key)
    return F.replace(F.replace(template, F.lit("{target}"), target), F.lit("{question}"), question)
