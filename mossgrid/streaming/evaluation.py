"""Evaluation of predictions as they arrive.

The batch parsers are pure expressions, so a stream of prediction files runs through the
same code; state is kept per window and label pair, not per prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mossgrid.functions import answers
from mossgrid.functions.tasks import route, task_name
from mossgrid.operators.evaluation import normal_label


def prediction_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Prediction files of a folder as a stream; repeated predictions are dropped within
    the watermark."""
    stream = spark.readStream.schema(schema).parquet(folder)
    stream = stream.withColumn("run_at", F.col("run_at").cast("timestamp"))  # watermarks need a zoned type
    return stream.withWatermark("run_at", "30 days").dropDuplicatesWithinWatermark(["pred_id"])


def windowed_label_counts(predictions: DataFrame, window: str = "7 days") -> DataFrame:
    """Predicted labels of classification per model and window of the run time; late rows
    beyond the stream's watermark are left out by Spark."""
    chosen = predictions.where(route(task_name(F.col("TaskType"))) == "classification")
    label = normal_label(answers.choice(answers.cleaned(F.col("Answer"))))
    return chosen.groupBy(F.window("run_at", window), "model", label.alias("label")).agg(F.count("*").alias("n"))
