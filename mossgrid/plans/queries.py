"""Queries over the reference operators and the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mossgrid.functions import answers, geometry, prompts, reports, submission, tasks
from mossgrid.functions.fields import category, file_name, file_names, image_paths
from mossgrid.operators import evaluation as E
from mossgrid.operators import preparation as P
from mossgrid.operators import submit
from mossgrid.operators.entry import details
from mossgrid.operators.split_values import split_values
from mossgrid.plans.runtime import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The two models that the comparison queries set side by side.
BASE_MODEL, TUNED_MODEL = "orbis-small", "lumen-7"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pairs(spark: SparkSession, d: str, *routed: str) -> DataFrame:
    """Predictions with references; of some tasks only, filtered before the join."""
    predictions = table(spark, d, "predictions")
    if routed:
        predictions = predictions.where(tasks.route(tasks.task_name(F.col("TaskType"))).isin(*routed))
    return E.evaluation_pairs(predictions, table(spark, d, "questions"))


def values(spark: SparkSession, d: str, *routed: str) -> DataFrame:
    return E.parsed(pairs(spark, d, *routed), routed)


def outputs(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Cleaned outputs of predictions of some tasks: pred_id, text, raw."""
    predictions = table(spark, d, "predictions").where(tasks.route(tasks.task_name(F.col("TaskType"))).isin(*kinds))
    return predictions.select("pred_id", answers.cleaned(F.col("Answer")).alias("text"), F.coalesce("Answer", F.lit("")).alias("raw"))


def rounded(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def text_of(boxes: Column) -> Column:
    return F.array_join(F.transform(boxes, lambda b: F.array_join(b.cast("array<string>"), ",")), ";")


# Task names and prompts


@query
def task_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").groupBy(tasks.task_name(F.col("TaskType")).alias("task_name")).agg(F.count("*").alias("n"))


@query
def task_router(spark: SparkSession, d: str) -> DataFrame:
    name = tasks.task_name(F.col("TaskType"))
    return (
        table(spark, d, "questions")
        .groupBy(tasks.route(name).alias("task"), tasks.parser_kind(name).alias("parser"), tasks.submission_key(F.col("TaskType")).alias("submission"))
        .agg(F.count("*").alias("n"))
    )


@query
def instruction_lookup(spark: SparkSession, d: str) -> DataFrame:
    name, n = tasks.task_name(F.col("TaskType")), F.size(image_paths(F.col("ImageName")))
    return (
        table(spark, d, "questions")
        .groupBy(tasks.instruction(name).alias("evaluation"), tasks.instruction(name, training=True, n_images=n).alias("training"))
        .agg(F.count("*").alias("n"))
    )


@query
def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").where("Question IS NOT NULL")
    full = prompts.full_question(tasks.task_name(F.col("TaskType")), F.col("Question"))
    chat = prompts.messages(image_paths(F.col("ImageName")), full, F.col("Answer"))
    return q.select("rec_id", chat.alias("m")).select(
        "rec_id",
        F.size("m").alias("n_messages"),
        F.size(F.get("m", F.lit(0))["content"]).alias("n_parts"),
        F.element_at(F.get("m", F.lit(0))["content"], -1)["text"].alias("text"),
    )


@query
def prompt_flatten(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").where("Question IS NOT NULL")
    flat = prompts.flat_chat(F.size(image_paths(F.col("ImageName"))), F.col("Question"), F.col("Answer"))
    return q.select("rec_id", flat.alias("chat"))


@query
def assistant_split(spark: SparkSession, d: str) -> DataFrame:
    return prompt_flatten(spark, d).select("rec_id", prompts.assistant_start(F.col("chat")).alias("start"))


@query
def label_mask_ratio(spark: SparkSession, d: str) -> DataFrame:
    """White-space tokens stand for ids: a token's id is its length, and 3 is padding."""
    words = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    q = table(spark, d, "questions").where("Question IS NOT NULL AND Answer IS NOT NULL")
    ids = F.transform(F.concat(words(F.col("Question")), words(F.col("Answer"))), F.length)
    labels = prompts.masked_labels(ids, F.size(words(F.col("Question"))), 3)
    return q.select("rec_id", labels.alias("l")).select(
        "rec_id", F.size(F.filter("l", lambda x: x == prompts.IGNORED)).alias("n_masked"), rounded(prompts.learning_ratio(F.col("l"))).alias("ratio")
    )


@query
def image_cap(spark: SparkSession, d: str) -> DataFrame:
    images = image_paths(F.col("ImageName"))
    return table(spark, d, "questions").select(
        "rec_id", F.size(images).alias("n_images"), F.size(prompts.capped_images(images, 2)).alias("n_capped")
    )


@query
def training_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = prompts.training_steps(F.col("n"), 3, 2, 8)
    n = table(spark, d, "questions").where("split_dir = 'training'").groupBy("dataset").agg(F.count("*").alias("n"))
    return n.select("dataset", steps.alias("steps"), prompts.logging_step(steps).alias("logging"))


# Parsers of model output


@query
def clean_output(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("pred_id", answers.cleaned(F.col("Answer")).alias("text"))


@query
def parse_classification(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "classification").select("pred_id", answers.choice(F.col("text")).alias("label"))


@query
def parse_multilabel(spark: SparkSession, d: str) -> DataFrame:
    found = answers.labels(F.col("text"))
    return outputs(spark, d, "multi-label").select("pred_id", F.size(found).alias("n"), F.array_join(found, "|").alias("labels"))


@query
def parse_detection(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "detection").select("pred_id", text_of(answers.boxes(F.col("text"))).alias("boxes"))


@query
def parse_instance(spark: SparkSession, d: str) -> DataFrame:
    found = outputs(spark, d, "instance_detection").select("pred_id", answers.instances(F.col("text")).alias("m"))
    return found.select(
        "pred_id",
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"),
        F.aggregate(F.map_values("m"), F.lit(0), lambda a, b: a + F.size(b)).alias("n_boxes"),
    )


@query
def parse_counting(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "counting").select("pred_id", answers.count(F.col("text")).cast("long").alias("count"))


@query
def parse_regression(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "regression").select("pred_id", answers.measure(F.col("text")).alias("value"))


@query
def parse_report(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "report_generation").select("pred_id", answers.report(F.col("text")).alias("report"))


@query
def reference_validity(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, d, "counting", "regression").select("pred_id", "r_number", "valid")


@query
def prediction_details(spark: SparkSession, d: str) -> DataFrame:
    return details(values(spark, d)).drop("model", "task")


# Submission


@query
def submit_classification(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "classification").select("pred_id", submission.letter(F.col("raw")).alias("answer"), submission.confidence(F.col("raw")).alias("confidence"))


@query
def submit_multilabel(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "multi-label", "report_generation").select("pred_id", submission.findings(F.col("raw")).alias("answer"))


@query
def submit_detection(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "detection", "instance_detection").select("pred_id", submission.box_list(F.col("raw")).alias("answer"))


@query
def submit_box_labels(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of detection outputs with their labels and places."""
    found = outputs(spark, d, "detection", "instance_detection").select("pred_id", F.posexplode(submission.labelled_boxes(F.col("raw"))).alias("pos", "x"))
    return found.select("pred_id", "pos", "x.label", F.array_join(F.col("x.box").cast("array<string>"), ",").alias("box"))


@query
def instance_versions(spark: SparkSession, d: str) -> DataFrame:
    return E.instance_versions(values(spark, d, "instance_detection"), ["model"])


@query
def submit_counting(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, "counting", "regression").select("pred_id", submission.first_count(F.col("raw")).alias("answer"))


@query
def submit_report_sections(spark: SparkSession, d: str) -> DataFrame:
    found = outputs(spark, d, "report_generation").select("pred_id", submission.sections(F.col("raw")).alias("s"))
    return found.select("pred_id", "s.findings", "s.impression", "s.recommendations")


@query
def submit_answers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").withColumn("output", F.col("Answer"))
    return submit.answered(p).select("pred_id", tasks.submission_key(F.col("TaskType")).alias("key"), F.col("Answer").alias("answer"))


@query
def submission_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").where("Question IS NOT NULL")
    prompt = tasks.submission_prompt(tasks.submission_key(F.col("TaskType")), F.lit("objects"), F.col("Question"))
    return p.select("pred_id", prompt.alias("prompt"))


@query
def prediction_summary(spark: SparkSession, d: str) -> DataFrame:
    return submit.summary(table(spark, d, "predictions"))


# Paths and preparation


def _valid_images(spark: SparkSession, d: str) -> DataFrame:
    """The first valid file of each name in a dataset's split folder."""
    listed = table(spark, d, "image_files").where("is_valid").withColumn("file", file_name(F.col("path")))
    return listed.groupBy("dataset", "split_dir", "file").agg(F.min("path").alias("image"))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return P.samples(table(spark, d, "questions"), _valid_images(spark, d), ["dataset", "split_dir"], ["rec_id"])


@query
def path_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each listed path once: its first listing."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("listed_at", "file_id"))
    return table(spark, d, "image_files").withColumn("r", rank).where("r = 1").select("path", "file_id")


def _resolved(spark: SparkSession, d: str, q: DataFrame) -> DataFrame:
    """Adds the image of a row's dataset and path p: the file of the whole path if listed, else of its name."""
    whole = F.concat_ws("/", "dataset", "p")
    files = table(spark, d, "image_files").select("path", "dataset", file_name(F.col("path")).alias("file"))
    exact = files.select(F.col("path").alias("exact")).distinct()
    by_name = files.groupBy("dataset", "file").agg(F.min("path").alias("named"))
    tried = q.withColumns({"whole": whole, "file": file_name(F.col("p"))})
    joined = tried.join(exact, tried["whole"] == exact["exact"], "left").join(by_name, ["dataset", "file"], "left")
    return joined.withColumn("image", F.coalesce("exact", "named"))


@query
def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    """First image of a question; those of the whole list are in path_resolve_each."""
    q = table(spark, d, "questions").select("rec_id", "dataset", F.get(image_paths(F.col("ImageName")), F.lit(0)).alias("p")).where("p IS NOT NULL")
    return _resolved(spark, d, q).select("rec_id", "image")


@query
def path_resolve_each(spark: SparkSession, d: str) -> DataFrame:
    """Every image of a question with its place in the list, from 0; null where no file is found."""
    q = table(spark, d, "questions").select("rec_id", "dataset", F.posexplode(image_paths(F.col("ImageName"))).alias("place", "p")).where("p IS NOT NULL")
    return _resolved(spark, d, q).select("rec_id", "place", "image")


@query
def prepare_samples(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d).select("rec_id", "num_images", "n_skipped", F.array_join("images", "|").alias("images"))


@query
def prepare_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Named images that aren't there or aren't valid, by dataset."""
    named = table(spark, d, "questions").select("dataset", "split_dir", F.explode(file_names(F.col("ImageName"))).alias("file"))
    valid = _valid_images(spark, d)
    return named.join(valid, ["dataset", "split_dir", "file"], "left_anti").groupBy("dataset").agg(F.count("*").alias("n_missing"))


@query
def prepare_sampled(spark: SparkSession, d: str) -> DataFrame:
    """100 questions of each dataset and split, by a key both engines compute alike."""
    key = (F.col("rec_id") * 2654435761) % 4294967296
    return P.sampled(table(spark, d, "questions"), 100, ["dataset", "split_dir"], key, "rec_id").select("rec_id", "dataset", "split_dir")


@query
def prepare_firstn(spark: SparkSession, d: str) -> DataFrame:
    return E.first_per_task(pairs(spark, d), 25).select("pred_id", "model", "task")


@query
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("split_dir") == "training", "train").when(F.col("split_dir") == "testing", "test").otherwise("val")
    out = P.split_sizes(table(spark, d, "questions").withColumn("split", split))
    return out.select("dataset", *[F.col(c).cast("long").alias(c) for c in ("train", "val", "test")])


@query
def task_distribution(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "questions").where("split_dir = 'training'").withColumn("task", category(F.col("TaskType")))
    return P.distribution(train, "task").select("value", "n", rounded("percent", 4).alias("percent"))


@query
def dataset_info(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("split_dir") == "training", "train").when(F.col("split_dir") == "testing", "test").otherwise("val")
    q = table(spark, d, "questions").select(
        split.alias("split"), category(F.col("TaskType")).alias("task_type"), category(F.col("Modality")).alias("modality")
    )
    info = P.dataset_info(q)
    return info.select(
        "train_samples", "val_samples", "test_samples", F.array_join("task_types", "|").alias("task_types"), F.array_join("modalities", "|").alias("modalities")
    )


@query
def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset and split: question rows without text, names without a listed file."""
    q = table(spark, d, "questions")
    lacking = q.groupBy("dataset", "split_dir").agg(
        F.count(F.when(F.trim(F.coalesce("Question", F.lit(""))) == "", 1)).alias("no_question"),
        F.count(F.when(F.trim(F.coalesce("Answer", F.lit(""))) == "", 1)).alias("no_answer"),
        F.count(F.when(category(F.col("TaskType")).isNull(), 1)).alias("no_task"),
    )
    files = table(spark, d, "image_files").groupBy("dataset", "split_dir").agg(
        F.count("*").alias("n_files"), F.count(F.when(~F.col("is_valid"), 1)).alias("n_invalid")
    )
    return lacking.join(files, ["dataset", "split_dir"], "full").fillna(0)


@query
def category_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Question rows by the category of their dataset (a small dimension table)."""
    return table(spark, d, "questions").join(table(spark, d, "datasets"), "dataset").groupBy("category", "split_dir").agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("n_datasets"))


# Metrics


def _wide(long: DataFrame, names: list[str]) -> DataFrame:
    out = long.groupBy("model").pivot("metric", names).agg(F.first("value"))
    return out.select("model", *[rounded(n).alias(n) for n in names])


@query
def cls_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _wide(E.classification(values(spark, d, "classification"), ["model"]), ["accuracy", "valid_samples"])


@query
def cls_balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _wide(E.classification(values(spark, d, "classification"), ["model"]), ["balanced_accuracy"])


@query
def cls_f1_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _wide(E.classification(values(spark, d, "classification"), ["model"]), ["f1_score"])


@query
def cls_distribution(spark: SparkSession, d: str) -> DataFrame:
    return E.class_table(E.class_counts(values(spark, d, "classification"), ["model"]), ["model"]).select("model", "label", "support", "predicted", "hits")


@query
def multilabel_f1(spark: SparkSession, d: str) -> DataFrame:
    return _wide(E.multi_label(values(spark, d, "multi-label"), ["model"]), ["f1_score", "precision", "recall", "valid_samples"])


@query
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the first predicted box with each reference box, where there is any; those of
    all predicted boxes are in iou_all_pairs."""
    v = values(spark, d, "detection").where("size(p_boxes) > 0")
    iou = geometry.overlap(F.get("p_boxes", F.lit(0)), F.col("r"))
    return v.select("pred_id", "p_boxes", F.posexplode("r_boxes").alias("pos", "r")).select("pred_id", "pos", rounded(iou).alias("iou")).where("iou > 0")


@query
def iou_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of every predicted box with every reference box."""
    return E.box_pairs(values(spark, d, "detection")).withColumn("iou", rounded("iou"))


@query
def detection_f1(spark: SparkSession, d: str) -> DataFrame:
    m = E.with_ratios(E._sums(E.box_matches(values(spark, d, "detection")), ["model"]))
    return m.select("model", "tp", "fp", "fn", rounded("f1_score").alias("f1_score"))


@query
def detection_matches(spark: SparkSession, d: str) -> DataFrame:
    """Greedy matches at a low threshold, pair by pair: the order of boxes decides."""
    return E.box_matches(values(spark, d, "detection"), 0.1).select("pred_id", "tp", "n_pred", "n_ref")


@query
def instance_f1(spark: SparkSession, d: str) -> DataFrame:
    s = E.instance_sweep(values(spark, d, "instance_detection"), ["model"])
    return s.where("threshold = 0.5").select("model", "tp", "fp", "fn", rounded("f1_score").alias("f1_score"))


@query
def instance_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = E.instance_sweep(values(spark, d, "instance_detection"), ["model"])
    return s.select("model", "threshold", "tp", "fp", "fn", rounded("precision").alias("precision"), rounded("recall").alias("recall"))


@query
def instance_per_id(spark: SparkSession, d: str) -> DataFrame:
    s = E.instance_names(values(spark, d, "instance_detection"), ["model"])
    return s.select("model", "inst", "tp", "fp", "fn", rounded("f1_score").alias("f1_score"))


@query
def instance_coco(spark: SparkSession, d: str) -> DataFrame:
    long = E.instance_detection(values(spark, d, "instance_detection"), ["model"])
    return _wide(long, ["average_f1", "average_precision", "average_recall", "f1_score_at_03", "f1_score_at_05", "valid_samples"])


@query
def count_mae_rmse(spark: SparkSession, d: str) -> DataFrame:
    return _wide(E.number_errors(values(spark, d, "counting"), ["model"]), ["mean_absolute_error", "root_mean_squared_error", "valid_samples"])


@query
def regression_mae_rmse(spark: SparkSession, d: str) -> DataFrame:
    return _wide(E.number_errors(values(spark, d, "regression"), ["model"]), ["mean_absolute_error", "root_mean_squared_error", "valid_samples"])


# Reports


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, d, "report_generation").select("pred_id", "model", "p_text", "r_text")


def _components(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return E.report_scores(_reports(spark, d)).select("pred_id", *[rounded(n).alias(n) for n in names])


@query
def green_entities(spark: SparkSession, d: str) -> DataFrame:
    """Mentions in the references by kind and term."""
    m = E.report_scores(_reports(spark, d)).select("pred_id", F.explode_outer("ref_m").alias("m")).where("m IS NOT NULL")
    return m.groupBy("m.kind", "m.term").agg(
        F.count("*").alias("n"), F.sum(F.col("m.denied").cast("long")).alias("n_denied"), F.count("m.size").alias("n_sized"),
        rounded(F.avg("m.severity")).alias("severity"), rounded(F.avg("m.doubt")).alias("doubt"),
    )


@query
def green_entity_kinds(spark: SparkSession, d: str) -> DataFrame:
    return E.report_scores(_reports(spark, d)).select(
        "pred_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("matched_kinds", "missed_kinds", "extra_kinds")]
    )


@query
def green_locations(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d, "location_accuracy")


@query
def green_negation(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d, "negation_handling")


@query
def green_temporal(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d, "temporal_accuracy")


@query
def green_measurement(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d, "measurement_accuracy")


@query
def green_significance(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d, "clinical_significance")


@query
def green_structure(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d, "structure_completeness")


@query
def green_severity_corr(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d, "severity_correlation")


@query
def green_overall(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d, "entity_matching", "overall")


@query
def green_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = E.report_rollup(E.report_scores(_reports(spark, d)), ["model"])
    return out.select("model", *[rounded(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "model"])


@query
def green_missed_top5(spark: SparkSession, d: str) -> DataFrame:
    return E.most_missed(E.report_scores(_reports(spark, d)), ["model"]).select("model", "place", "kind", "missed")


@query
def bleu(spark: SparkSession, d: str) -> DataFrame:
    """BLEU of reports with all four orders."""
    out = E.bleu(_reports(spark, d), ["model"], "pred_id", "p_text", "r_text")
    return out.select("model", rounded("bleu_score").alias("bleu_score"))


@query
def bleu_4(spark: SparkSession, d: str) -> DataFrame:
    """Another name of bleu, from when that stopped at pairs of words."""
    return bleu(spark, d)


@query
def clinical_efficacy(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select(
        "pred_id", reports.efficacy_category("p_text").alias("generated"), reports.efficacy_category("r_text").alias("reference"),
        reports.efficacy("p_text", "r_text").alias("score"),
    )


@query
def word_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("pred_id", rounded(reports.word_overlap(F.col("p_text"), F.col("r_text"))).alias("share"))


# All tasks, both models


@query
def task_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.metrics(values(spark, d)).select("model", "task", "metric", rounded("value").alias("value"))


@query
def results_overall(spark: SparkSession, d: str) -> DataFrame:
    return E.task_counts(values(spark, d))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    both = values(spark, d).where(F.col("model").isin(BASE_MODEL, TUNED_MODEL))
    long = cut_lineage(E.metrics(both))  # a few rows for each model and task, read three times
    side = lambda m: long.where(F.col("model") == m)
    return E.compare(side(BASE_MODEL), side(TUNED_MODEL))


@query
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    numbers = ["base", "finetuned", "absolute_diff", "relative_diff_percent", "improvement_magnitude_percent"]
    return _compared(spark, d).select("task", "metric", *[rounded(n).alias(n) for n in numbers], "improvement", "is_primary_metric")


@query
def comparison_rollup(spark: SparkSession, d: str) -> DataFrame:
    return E.comparison_rollup(_compared(spark, d))


@query
def comparison_report(spark: SparkSession, d: str) -> DataFrame:
    return E.comparison_lines(_compared(spark, d))


# Packed values


@query
def p5_values(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "questions").where(category(F.col("TaskType")) == "multi label classification")
    return split_values(labelled, table(spark, d, "label_terms"), id_col="rec_id", value_col="Answer")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_values(spark, d).where("known").select("rec_id", "pos", "val")
