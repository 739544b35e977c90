"""Submission: question files to prompts, model outputs to answers, answers to JSON.

The model is a function over pandas batches; everything around it stays in the plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.functions import submission
from mossgrid.functions.tasks import submission_key
from mossgrid.plans.runtime import delete_at_end, join_parts, shared_folder, written
from mossgrid.sources import question_files as Q


#: Between two records of a JSON array.
SEPARATOR = ",\n"


def with_outputs(df: DataFrame, predict: Callable[[pd.DataFrame], list[str | None]]) -> DataFrame:
    """Adds ``output``, what the model says to each batch of rows. Rows keep their order in
    a batch. Where the model fails on a batch, its rows are tried one by one, and those on
    which it fails again have a null output."""
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",output:string"

    def ask(batch: pd.DataFrame) -> list[str | None]:
        said = list(predict(batch))
        if len(said) != len(batch):
            raise ValueError("the model gave another number of outputs than rows")
        return said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                said = ask(batch)
            except Exception:  # noqa: BLE001
                said = []
                for i in range(len(batch)):
                    try:
                        said += ask(batch.iloc[i : i + 1])
                    except Exception:  # noqa: BLE001
                        said.append(None)
            yield batch.assign(output=said)

    return df.mapInPandas(run, f"struct<{schema}>")


def answered(df: DataFrame, task: str = "TaskType", output: str = "output") -> DataFrame:
    """Replaces ``Answer`` by the submitted answer; it is never null."""
    return df.withColumn("Answer", F.coalesce(submission.answer(submission_key(F.col(task)), F.col(output)), F.lit("")))


def located(spark: SparkSession, base: str) -> DataFrame:
    """Questions of all question files with the path of their image, null where there is
    none. Files without any image folder are left out."""
    files = written(Q.listing(spark, base))
    named = Q.search_question_files(files)
    found = named.join(Q.image_folders(named, files), "path")
    questions = Q.read_found_questions(spark, base).where("_corrupt_record IS NULL").join(found, "path")
    bare = Q.bare_image_name(F.col("ImageName"))
    candidates = F.array(
        F.struct(F.lit(0).alias("i"), F.concat_ws("/", "folder", bare).alias("image")),
        F.struct(F.lit(1).alias("i"), F.concat_ws("/", "folder", F.substring_index(bare, "/", -1)).alias("image")),
    )
    tried = questions.select("path", "pos", F.explode(candidates).alias("x")).select("path", "pos", "x.i", "x.image")
    hit = tried.join(files.select(F.col("path").alias("image")), "image").groupBy("path", "pos").agg(F.min_by("image", "i").alias("image"))
    return questions.join(hit, ["path", "pos"], "left")


def submit(spark: SparkSession, base: str, predict: Callable[[pd.DataFrame], list[str | None]], out: str) -> DataFrame:
    """Answers every question under ``base`` and returns the number of predictions per task.

    Predictions are written in the order of files and places as part files of one JSON object
    a line. If ``out`` ends with ``.json`` the parts are joined into one JSON array of that name.
    """
    questions = located(spark, base)
    rows = questions.where("image IS NOT NULL")
    missing = questions.where("image IS NULL").withColumn("output", F.lit(""))
    done = written(answered(with_outputs(rows, predict).unionByName(missing)).withColumn(
        "Answer", F.when(F.col("image").isNull(), F.lit("")).otherwise(F.col("Answer"))
    ))
    record = F.to_json(F.struct("TaskType", "Modality", "ImageName", "Question", "Answer", "Split"))
    ordered = done.orderBy("pattern", "path", "pos").select(record.alias("value"))
    if not out.endswith(".json"):
        ordered.write.mode("overwrite").text(out)
        return summary(done)
    parts = f"{shared_folder(spark)}/submission-{uuid.uuid4().hex}"
    ordered.write.option("lineSep", SEPARATOR).text(parts)
    delete_at_end(spark, parts)
    join_parts(spark, parts, out, "[\n", "\n]\n", len(SEPARATOR))
    return summary(done)


def summary(predictions: DataFrame) -> DataFrame:
    """Predictions per task; a missing task counts as Unknown."""
    return predictions.groupBy(F.coalesce("TaskType", F.lit("Unknown")).alias("TaskType")).agg(F.count("*").alias("n"))
