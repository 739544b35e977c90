"""Preparation of samples: image checks, sampling, statistics, structural validation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mossgrid.functions.fields import file_name, image_paths
from mossgrid.plans.runtime import write_text, written
from mossgrid.sources import question_files as Q

#: Issues that a report shows.
SHOWN_ISSUES = 10


def samples(questions: DataFrame, images: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Questions with at least one valid image: ids, images, question, answer, task_type,
    modality, num_images, n_skipped.

    ``images``: keys, ``file`` (lower-case name), ``image`` (path), one row for each valid
    image. Missing images are dropped one by one, in place order; a question without any
    left is dropped.
    """
    named = questions.select(*id_cols, *keys, F.posexplode(image_paths(F.col("ImageName"))).alias("at", "name"))
    checked = named.withColumn("file", file_name(F.col("name"))).join(images, [*keys, "file"], "left")
    kept = checked.groupBy(*id_cols).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("at", "image")))), lambda x: x["image"]
        ).alias("images"),
        F.count(F.when(F.col("image").isNull(), 1)).alias("n_skipped"),
    )
    typed = questions.select(
        *id_cols, *keys, F.col("Question").alias("question"), F.col("Answer").alias("answer"),
        F.col("TaskType").alias("task_type"), F.col("Modality").alias("modality"),
    )
    return (
        typed.join(kept.where(F.size("images") > 0), id_cols)
        .withColumn("num_images", F.size("images").cast("long"))
    )


def sampled(questions: DataFrame, n: int | None, group: list[str], key: Column, tie: str) -> DataFrame:
    """n questions of each group in the order of a random key; all for none or zero."""
    if not n or n <= 0:
        return questions
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(key, tie))
    return questions.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def split_sizes(prepared: DataFrame) -> DataFrame:
    """Samples of each dataset in each split, one row for a dataset."""
    return prepared.groupBy("dataset").pivot("split", ["train", "val", "test"]).count().fillna(0)


def distribution(prepared: DataFrame, column: str) -> DataFrame:
    """Count and share in percent of each value, among samples of all rows given."""
    counted = prepared.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the few distinct values
    return counted.withColumn("percent", F.col("n") * 100.0 / total)


def dataset_info(prepared: DataFrame) -> DataFrame:
    """One row: samples of each split and, of training, task types and modalities."""
    train = F.col("split") == "train"
    return prepared.agg(
        F.count(F.when(train, 1)).alias("train_samples"),
        F.count(F.when(F.col("split") == "val", 1)).alias("val_samples"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test_samples"),
        F.array_sort(F.collect_set(F.when(train, F.col("task_type")))).alias("task_types"),
        F.array_sort(F.collect_set(F.when(train, F.col("modality")))).alias("modalities"),
    )


def prepare(
    spark: SparkSession, base: str, out: str, *, max_samples: int | None = None, datasets: list[str] | None = None, decode: bool = False
) -> DataFrame:
    """Reads all question files under ``base``, writes ``out/{train,validation,test}`` and
    ``dataset_info.json``, and returns the samples per dataset and split.

    Evaluation splits take a fifth of ``max_samples``; a fifth of less than one is no limit.
    Images are valid by their first bytes, or by decoding them as a whole. No training sample
    at all is an error.
    """
    files = Q.listing(spark, base)
    known = Q.registry(spark, datasets)
    # At most one file for each known dataset and split.
    placed = Q.placed_files(files).join(F.broadcast(known), ["dataset", "category"])
    paths = [r["path"] for r in placed.select("path").collect()]
    # The folder decides the split; what a record says of itself would clash with it.
    records = Q.read_questions(spark, paths).where("_corrupt_record IS NULL").drop("Split")
    questions = records.join(F.broadcast(placed), "path")
    key = F.xxhash64("path", "pos", F.lit(42))
    group = ["dataset", "split"]
    train = sampled(questions.where("split = 'train'"), max_samples, group, key, "pos")
    rest = sampled(questions.where("split <> 'train'"), max_samples // 5 if max_samples else None, group, key, "pos")
    good = Q.checked_images(spark, base, decode=decode).where("ok").withColumnRenamed("path", "image")
    part = lambda i: F.element_at(F.split("image", "/"), i)
    images = good.select(
        "image", part(-4).alias("category"), part(-3).alias("dataset"), part(-5).alias("split_dir"), file_name(F.col("image")).alias("file")
    )
    prepared = written(samples(train.unionByName(rest), images, ["split_dir", "category", "dataset"], ["path", "pos", "split"]))
    info = dataset_info(prepared).first()
    if not info["train_samples"]:
        raise ValueError("no training samples")
    columns = ["images", "question", "answer", "task_type", "modality", "num_images"]
    for split, name in (("train", "train"), ("val", "validation"), ("test", "test")):
        if info[f"{split}_samples"]:
            prepared.where(F.col("split") == split).select(*columns).write.mode("overwrite").parquet(f"{out}/{name}")
    shares = {
        f"{c}_distribution": {r["value"]: r["n"] for r in distribution(prepared.where("split = 'train'"), c).collect()}
        for c in ("task_type", "modality")
    }
    stats = split_sizes(prepared)
    table = {r["dataset"]: {s: r[s] for s in ("train", "val", "test")} for r in stats.collect()}
    write_text(spark, f"{out}/dataset_info.json", json.dumps(info.asDict() | {"dataset_stats": table} | shares, indent=2))
    return stats


def validate(spark: SparkSession, base: str, *, check_images: bool = False, n: int = 100, decode: bool = False) -> tuple[bool, DataFrame]:
    """(ok, issues): missing image folders and question files, unreadable files, fields
    missing in a file's first record, and, if asked, images that don't begin as such, or
    can't be decoded, among the first n by path of each folder. No known split folder at all
    fails."""
    files = Q.listing(spark, base)
    part = lambda i: F.get(F.split("rel", "/"), F.lit(i))
    folders = [f for _, f, *_ in Q.PLACES]
    tree = files.withColumns({"split_dir": part(0), "category": part(1), "dataset": part(2), "sub": part(3)}).where(
        F.col("split_dir").isin(folders) & F.col("sub").isNotNull()
    )
    present = written(tree.groupBy("split_dir", "category", "dataset").agg(F.collect_set("sub").alias("subs")))
    if present.isEmpty():
        return False, spark.createDataFrame([("no known split folder",)], "issue string")
    where = F.concat_ws("/", "split_dir", "category", "dataset")
    kinds = {"training": ("imagesTr", "train"), "validation-hidden": ("imagesVal", "val"), "validation-public": ("imagesVal", "val"), "testing": ("imagesTs", "test")}
    folder_of = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[0])])
    ending_of = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[1])])
    plain = F.concat("dataset", F.lit("_questions_"), F.element_at(ending_of, F.col("split_dir")), F.lit(".json"))
    with_answers = F.concat("dataset", F.lit("_questions_val_withGT.json"))
    is_val = F.col("split_dir").startswith("validation")
    chosen = F.when(is_val & F.array_contains("subs", with_answers), with_answers).otherwise(plain)
    expected = present.withColumns({"folder": F.element_at(folder_of, F.col("split_dir")), "file": chosen})
    no_folder = expected.where(~F.array_contains("subs", F.col("folder"))).select(
        F.concat(F.lit("Missing image directory: "), where, F.lit("/"), "folder").alias("issue")
    )
    no_file = expected.where(~F.array_contains("subs", F.col("file"))).select(
        F.concat(F.lit("Missing question file: "), where, F.lit("/"), "file").alias("issue")
    )
    there = expected.where(F.array_contains("subs", F.col("file"))).select(F.concat(F.lit(base.rstrip("/") + "/"), where, F.lit("/"), "file").alias("path"))
    first = written(Q.read_questions(spark, [r["path"] for r in there.collect()]).where("pos = 1"))  # a file for each dataset and split
    lacking = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in Q.FIELDS]))
    unreadable = first.where("_corrupt_record IS NOT NULL").select(F.concat(F.lit("Error reading "), "path").alias("issue"))
    fields = first.where("_corrupt_record IS NULL").withColumn("lack", lacking).where(F.size("lack") > 0).select(
        F.concat(F.lit("Missing fields in "), "path", F.lit(": "), F.array_join("lack", ", ")).alias("issue")
    )
    issues = no_folder.unionByName(no_file).unionByName(unreadable).unionByName(fields)
    if check_images:
        held = Q.checked_images(spark, base, decode=decode).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
        rank = F.row_number().over(Window.partitionBy("dir").orderBy("path"))
        bad = held.withColumn("r", rank).where(F.col("r") <= n).where("NOT ok")
        issues = issues.unionByName(bad.select(F.concat(F.lit("Corrupted image: "), "path").alias("issue")))
    issues = written(issues)  # a few rows; finding them again would read all files again
    return issues.isEmpty(), issues


def shown_issues(issues: DataFrame) -> list[str]:
    """Lines of a report: how many issues there are, and the first of them."""
    rows = issues.orderBy("issue").limit(SHOWN_ISSUES).collect()
    return [f"{issues.count()} issues", *[f"  - {r['issue']}" for r in rows]]


def validation_report(spark: SparkSession, base: str) -> str:
    """Text: per split the number of datasets and their sorted names."""
    files = Q.listing(spark, base)
    part = lambda i: F.get(F.split("rel", "/"), F.lit(i))
    named = files.select(part(0).alias("split"), F.concat_ws("/", part(1), part(2)).alias("name"), part(3).alias("sub")).where("sub IS NOT NULL")
    rows = named.groupBy("split").agg(F.sort_array(F.collect_set("name")).alias("names")).orderBy("split").collect()
    lines = ["Dataset validation report", ""]
    for r in rows:
        lines += [f"{r['split'].upper()}:", f"Total datasets: {len(r['names'])}", *[f"  - {x}" for x in r["names"]], ""]
    return "\n".join(lines)


def batched_images(rows: DataFrame, batch: str, order: str, images: str = "images") -> DataFrame:
    """(batch, images, counts): the images of each batch in one list, and how many each of
    its rows has. A batch is bounded by its size in training."""
    return (
        rows.groupBy(batch)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(images).alias("i")))).alias("rows"))
        .select(batch, F.flatten(F.transform("rows", lambda r: r["i"])).alias("images"), F.transform("rows", lambda r: F.size(r["i"])).alias("counts"))
    )


def running_mean(timings: DataFrame, order: str, value: str, group: list[str], last: int = 100) -> DataFrame:
    """Adds ``mean``: the mean of the last timings of a group up to each row."""
    frame = Window.partitionBy(*group).orderBy(order).rowsBetween(1 - last, Window.currentRow)
    return timings.withColumn("mean", F.avg(value).over(frame))


def missing_images(prepared: DataFrame, files: DataFrame, n: int = 3) -> DataFrame:
    """Image paths of the first n samples that no longer exist; a check after saving."""
    first = prepared.limit(n).select(F.explode("images").alias("path"))
    return first.join(files.select("path"), "path", "left_anti")


def saved_counts(spark: SparkSession, out: str) -> dict[str, int]:
    """Rows of each split that was written under ``out``; zero for one that wasn't."""
    system = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda name: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}"))
    return {n: spark.read.parquet(f"{out}/{n}").count() if there(n) else 0 for n in ("train", "validation", "test")}
