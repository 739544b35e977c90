"""Evaluation: predictions and references to parsed pairs, metrics per model and task,
and the comparison of two models.

Metrics are long tables (model, task, metric, value). Whatever grows with the data is
aggregated on the map side first: contingency counts for classes, sums for boxes, numbers
and reports. A precision, recall or F1 without denominator is zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrid.functions import answers, geometry, lexicon, reports
from mossgrid.functions.fields import strip
from mossgrid.functions.tasks import parser_kind, primary_metric, route, task_name
from mossgrid.plans.runtime import spread, written

THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]
COMPONENTS = [*lexicon.WEIGHTS, "overall", "severity_correlation"]


def evaluation_pairs(predictions: DataFrame, references: DataFrame, key: str = "rec_id") -> DataFrame:
    """Predictions with their references: id, model, task, question, output, reference."""
    refs = references.select(F.col(key), F.col("Answer").alias("reference"))
    return predictions.join(refs, key).select(
        "pred_id",
        "model",
        F.col("TaskType").alias("task_raw"),
        task_name(F.col("TaskType")).alias("task_name"),
        route(task_name(F.col("TaskType"))).alias("task"),
        F.col("Question").alias("question"),
        F.col("Answer").alias("output"),
        "reference",
    )


def first_per_task(pairs: DataFrame, n: int = 0, order: str = "pred_id") -> DataFrame:
    """The first n pairs of each model and task in input order; all for n = 0."""
    if n <= 0:
        return pairs
    ranked = pairs.withColumn("__rank", F.row_number().over(Window.partitionBy("model", "task").orderBy(order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def only_task(pairs: DataFrame, task: str) -> DataFrame:
    """Pairs of one task; a task without pairs is an error."""
    chosen = pairs.where(F.col("task") == task)
    if chosen.isEmpty():
        raise ValueError(f"no examples of task {task!r}")
    return chosen


def parsed(pairs: DataFrame, tasks: tuple[str, ...] = ()) -> DataFrame:
    """Adds the typed values of output (``p_*``) and reference (``r_*``), one nullable
    column for each kind, and ``valid``. Number tasks need both numbers; others are valid.

    ``tasks``: only the columns of these tasks, for pairs that hold no other.
    """
    ref = F.coalesce(F.col("reference"), F.lit(""))
    base = pairs.withColumns({"__text": answers.cleaned(F.col("output")), "__ref": answers.cleaned(ref)})
    kind, t, r = parser_kind(F.col("task")), F.col("__text"), F.col("__ref")
    wanted = lambda *names: not tasks or any(n in tasks for n in names)
    columns: dict[str, Column] = {}

    def add(name: str, tested: Column, p: Column, q: Column) -> None:
        columns[f"p_{name}"], columns[f"r_{name}"] = F.when(tested, p), F.when(tested, q)

    if wanted("classification"):
        add("label", kind == "classification", answers.choice(t), ref)
    if wanted("multi-label"):
        add("labels", kind == "multi-label", answers.labels(t), answers.labels(r))
    if wanted("detection"):
        add("boxes", kind == "detection", answers.boxes(t), answers.boxes(r))
    if wanted("instance_detection"):
        add("inst", F.col("task") == "instance_detection", answers.instances(t), answers.instances(r))
    if wanted("counting", "regression"):
        counting, number = kind == "counting", answers.reference_number(ref)
        columns["p_number"] = F.when(counting, answers.count(t).cast("double")).when(kind == "regression", answers.measure(t))
        columns["r_number"] = F.when(counting, F.floor(number).cast("double")).when(kind == "regression", number)
    if wanted("report_generation"):
        add("text", kind == "report_generation", answers.report(t), ref)
    typed = base.withColumns(columns).drop("__text", "__ref")
    if "p_number" not in columns:
        return typed.withColumn("valid", F.lit(True))
    numeric = F.col("task").isin("counting", "regression")
    return typed.withColumn("valid", ~numeric | (F.col("p_number").isNotNull() & F.col("r_number").isNotNull()))


def ratio(over: Column, under: Column) -> Column:
    return F.coalesce(F.try_divide(over.cast("double"), under), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.metric", "x.value")


def normal_label(label: Column) -> Column:
    """White space collapsed, single letters in upper case, all else in lower case."""
    bare = F.regexp_replace(strip(F.coalesce(label, F.lit(""))), r"(?U)\s+", " ")
    return F.when((F.length(bare) == 1) & bare.rlike(r"^\p{L}$"), F.upper(bare)).otherwise(F.lower(bare))


def class_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Contingency counts of normal labels: keys, ref, pred, n. All class metrics follow
    from this table, which is as small as the set of label pairs."""
    return df.groupBy(*keys, normal_label(F.col("r_label")).alias("ref"), normal_label(F.col("p_label")).alias("pred")).agg(
        F.count("*").alias("n")
    )


def class_table(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Per class of references or predictions: support, predicted, hits."""
    sides = F.array(
        F.struct(F.col("ref").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p")),
    )
    return (
        counts.select(*keys, F.explode(sides).alias("x"), F.when(F.col("ref") == F.col("pred"), F.col("n")).alias("h"))
        .groupBy(*keys, F.col("x.label").alias("label"))
        .agg(
            F.sum("x.s").alias("support"),
            F.sum("x.p").alias("predicted"),
            # A hit shows on both sides.
            (F.coalesce(F.sum("h"), F.lit(0)) / 2).cast("long").alias("hits"),
        )
    )


def classification(df: DataFrame, keys: list[str], *, compat_binary: bool = False) -> DataFrame:
    """Balanced accuracy (mean recall over reference classes), accuracy, weighted F1.

    ``compat_binary``: with two classes or fewer every metric is zero, as where a binary
    average with string labels fails.
    """
    table = class_table(class_counts(df, keys), keys)
    f1 = ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    out = table.groupBy(*keys).agg(
        F.avg(F.when(F.col("support") > 0, F.col("hits") / F.col("support"))).alias("balanced_accuracy"),
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        ratio(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_score"),
        F.sum("support").alias("valid_samples"),
        F.count("*").alias("__classes"),
    )
    metrics = ["balanced_accuracy", "accuracy", "f1_score", "valid_samples"]
    if compat_binary:
        for m in metrics:
            out = out.withColumn(m, F.when(F.col("__classes") <= 2, F.lit(0)).otherwise(F.col(m)))
    return _long(out, keys, metrics)


def label_scores(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 of each sample's label sets; null without reference."""
    bare = lambda c: F.array_distinct(F.transform(F.filter(c, lambda x: x != ""), strip))
    sets = df.withColumns({"__p": bare(F.col("p_labels")), "__r": bare(F.col("r_labels"))})
    hits = F.size(F.array_intersect("__p", "__r"))
    scored = sets.withColumns({"precision": ratio(hits, F.size("__p")), "recall": ratio(hits, F.size("__r"))})
    scored = scored.withColumn("f1_score", harmonic(F.col("precision"), F.col("recall")))
    has_reference = F.size("__r") > 0
    return scored.withColumns({m: F.when(has_reference, F.col(m)) for m in ("precision", "recall", "f1_score")}).drop("__p", "__r")


def multi_label(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted means over the samples that have a reference label."""
    metrics = ["f1_score", "precision", "recall"]
    out = label_scores(df).groupBy(*keys).agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics], F.count("f1_score").alias("valid_samples")
    )
    return _long(out, keys, [*metrics, "valid_samples"])


def with_ratios(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1_score to sums tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1_score", harmonic(F.col("precision"), F.col("recall")))


def _sums(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("tp").cast("long").alias("tp"),
        F.sum(F.col("n_pred") - F.col("tp")).cast("long").alias("fp"),
        F.sum(F.col("n_ref") - F.col("tp")).cast("long").alias("fn"),
        F.count("*").alias("n_rows"),
    )


def box_pairs(df: DataFrame) -> DataFrame:
    """(pred_id, p_pos, r_pos, iou): every predicted box of a row with every reference box.

    Pairs that are apart have zero; a box without four numbers has no overlap (null).
    """
    predicted = df.select("pred_id", "r_boxes", F.posexplode("p_boxes").alias("p_pos", "p"))
    both = predicted.select("pred_id", "p_pos", "p", F.posexplode("r_boxes").alias("r_pos", "r"))
    sound = (F.size("p") == 4) & (F.size("r") == 4)
    return both.select("pred_id", "p_pos", "r_pos", F.when(sound, geometry.overlap(F.col("p"), F.col("r"))).alias("iou"))


def box_matches(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds tp, n_pred, n_ref of each sample's boxes at one threshold."""
    return df.withColumns(
        {
            "tp": geometry.matched(F.col("p_boxes"), F.col("r_boxes"), F.lit(threshold)),
            "n_pred": F.size("p_boxes"),
            "n_ref": F.size("r_boxes"),
        }
    )


def detection(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 over all samples at an overlap above one half."""
    out = with_ratios(_sums(box_matches(df), keys)).withColumn("valid_samples", F.col("n_rows"))
    return _long(out, keys, ["f1_score", "precision", "recall", "valid_samples"])


def instance_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each sample and instance name of either side, with both box lists."""
    none = F.array().cast(geometry.BOXES)
    names = F.array_union(F.map_keys("p_inst"), F.map_keys("r_inst"))
    at = lambda m, k: F.coalesce(F.try_element_at(F.col(m), k), none)
    return df.select(*keys, "p_inst", "r_inst", F.explode(names).alias("inst")).select(
        *keys, "inst", at("p_inst", F.col("inst")).alias("p_boxes"), at("r_inst", F.col("inst")).alias("r_boxes")
    )


def instance_sweep(df: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn and ratios at each threshold; boxes match within their instance name."""
    rows = instance_rows(df, keys)
    per = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), geometry.matched(F.col("p_boxes"), F.col("r_boxes"), F.lit(t)).alias("tp"))
            for t in THRESHOLDS
        ]
    )
    swept = rows.select(*keys, F.size("p_boxes").alias("n_pred"), F.size("r_boxes").alias("n_ref"), F.explode(per).alias("x"))
    return with_ratios(_sums(swept.select(*keys, "n_pred", "n_ref", "x.threshold", "x.tp"), [*keys, "threshold"])).drop("n_rows")


def instance_names(df: DataFrame, keys: list[str], threshold: float = 0.3) -> DataFrame:
    """Ratios per instance name at ``threshold`` or more. A predicted box without four
    numbers is ignored; a reference box without them is missed."""
    rows = instance_rows(df, keys)
    sound = F.filter("p_boxes", lambda b: F.size(b) == 4)
    matched = rows.withColumns(
        {
            "tp": geometry.matched(F.col("p_boxes"), F.col("r_boxes"), F.lit(threshold), inclusive=True),
            "n_pred": F.size(sound),
            "n_ref": F.size("r_boxes"),
        }
    )
    return with_ratios(_sums(matched, [*keys, "inst"])).drop("n_rows")


def instance_detection(df: DataFrame, keys: list[str], *, compat_versions: bool = False) -> DataFrame:
    """F1 above one half (``f1_score``), at 0.3 and 0.5, and means over the thresholds.

    ``compat_versions``: where :func:`instance_versions` tells v1_original_only, only the
    metrics above one half are given.
    """
    swept = instance_sweep(df, keys)
    at = lambda t, m: F.max(F.when(F.col("threshold") == t, F.col(m)))
    out = swept.groupBy(*keys).agg(
        at(0.5, "f1_score").alias("f1_score"),
        at(0.5, "precision").alias("precision"),
        at(0.5, "recall").alias("recall"),
        at(0.3, "f1_score").alias("f1_score_at_03"),
        at(0.5, "f1_score").alias("f1_score_at_05"),
        at(0.3, "precision").alias("precision_at_03"),
        at(0.3, "recall").alias("recall_at_03"),
        F.avg("f1_score").alias("average_f1"),
        F.avg("precision").alias("average_precision"),
        F.avg("recall").alias("average_recall"),
    )
    metrics = [c for c in out.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count("*").alias("valid_samples"))
    long = _long(counted.join(out, keys, "left").fillna(0.0, metrics), keys, [*metrics, "valid_samples"])
    if not compat_versions:
        return long
    original = F.col("metric").isin("f1_score", "precision", "recall", "valid_samples")
    first = instance_versions(df, keys).where("n_broken > 0").select(*keys, F.lit(True).alias("first"))
    return long.join(first, keys, "left").where(F.col("first").isNull() | original).drop("first")


def instance_versions(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metrics_version, n_broken): v1_original_only where a box that would be compared
    hasn't four numbers, so that only the metrics above one half are sound; else v2."""
    rows = instance_rows(df, keys)
    odd = lambda c: F.exists(c, lambda b: F.size(b) != 4)
    broken = (F.size("p_boxes") > 0) & (F.size("r_boxes") > 0) & (odd("p_boxes") | odd("r_boxes"))
    counted = rows.groupBy(*keys).agg(F.count(F.when(broken, 1)).alias("n_broken"))
    return counted.select(*keys, F.when(F.col("n_broken") > 0, "v1_original_only").otherwise("v2").alias("metrics_version"), "n_broken")


def number_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute and root mean squared error over valid pairs. Without any the mean is
    infinite and there is no root; an operand that is not finite makes the mean infinite."""
    error = F.col("p_number") - F.col("r_number")
    good = F.col("valid")
    out = df.groupBy(*keys).agg(
        F.avg(F.when(good, F.abs(error))).alias("mean_absolute_error"),
        F.sqrt(F.avg(F.when(good, error * error))).alias("root_mean_squared_error"),
        F.count(F.when(good, 1)).alias("valid_samples"),
    )
    infinite = F.lit(float("inf"))
    mae = F.col("mean_absolute_error")
    broken = mae.isNull() | F.isnan(mae) | (mae == infinite)
    out = out.withColumns(
        {
            "mean_absolute_error": F.when(broken, infinite).otherwise(mae),
            "root_mean_squared_error": F.when(~broken, F.col("root_mean_squared_error")),
            "valid_samples": F.when(broken, F.lit(0)).otherwise(F.col("valid_samples")),
        }
    )
    return _long(out, keys, ["mean_absolute_error", "root_mean_squared_error", "valid_samples"]).where("value IS NOT NULL")


def bleu(df: DataFrame, keys: list[str], id_col: str, generated: str, reference: str, n_gram: int = 4) -> DataFrame:
    """(keys, bleu_score): mean clipped precision of each order, geometric mean, brevity.

    N-grams are counted by exploding and grouping, so the cost is linear in the text. The texts
    are partitioned by row before, so the n-grams themselves aren't shuffled. A text shorter
    than n words has precision zero; an order without any match makes the score zero.
    """
    tokens = lambda c: F.array_remove(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"(?U)\s+"), "")
    placed = spread(df.select(*keys, id_col, generated, reference), id_col)
    base = placed.select(*keys, id_col, tokens(generated).alias("p"), tokens(reference).alias("r"))
    orders = list(range(1, min(n_gram, 4) + 1))

    def item(n: Column, gram: Column, in_p: Column, in_r: Column) -> Column:
        return F.struct(n.alias("n"), gram.alias("gram"), in_p.alias("p"), in_r.alias("r"))

    def grams(side: str) -> Column:
        ones = (F.lit(int(side == "p")), F.lit(int(side == "r")))

        def of(n: int) -> Column:
            places = F.when(F.size(side) >= n, F.sequence(F.lit(1), F.size(side) - n + 1))
            return F.transform(
                F.coalesce(places, F.array().cast("array<int>")), lambda i: item(F.lit(n), F.array_join(F.slice(side, i, n), " "), *ones)
            )

        return F.concat(*[of(n) for n in orders])

    # Order zero holds the lengths of the texts.
    items = F.concat(grams("p"), grams("r"), F.array(item(F.lit(0), F.lit(""), F.size("p"), F.size("r"))))
    counted = (
        base.select(*keys, id_col, F.explode(items).alias("x"))
        .groupBy(*keys, id_col, "x.n", "x.gram")
        .agg(F.sum("x.p").alias("p"), F.sum("x.r").alias("r"), F.count(F.when(F.col("x.n") == 0, 1)).alias("rows"))
        .groupBy(*keys, id_col, "n")
        .agg(F.sum(F.least("p", "r")).alias("hits"), F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("rows").alias("rows"))
    )
    at = lambda n, value: F.sum(F.when(F.col("n") == n, value))
    sums = counted.groupBy(*keys).agg(
        at(0, F.col("rows")).alias("rows"),
        at(0, F.col("p")).alias("lp"),
        at(0, F.col("r")).alias("lr"),
        *[at(n, ratio(F.col("hits"), F.col("p"))).alias(f"m{n}") for n in orders],
    )
    means = [F.coalesce(F.col(f"m{n}"), F.lit(0.0)) / F.col("rows") for n in orders]
    logs = sum((F.when(m > 0, F.log(m)) for m in means), F.lit(0.0)) / len(orders)
    brevity = F.when(F.col("lp") > F.col("lr"), 1.0).when(F.col("lp") == 0, 0.0).otherwise(F.exp(1 - F.try_divide(F.col("lr"), F.col("lp"))))
    return sums.select(*keys, F.coalesce(brevity * F.exp(logs), F.lit(0.0)).alias("bleu_score"))


def report_scores(df: DataFrame) -> DataFrame:
    """Report rows with their score components; see :func:`mossgrid.functions.reports.scored`."""
    return reports.scored(df, "p_text", "r_text")


def report_rollup(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation, least and greatest of each component, entity averages."""
    stats = [
        f(c).alias(f"{c}_{name}")
        for c in COMPONENTS
        for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    ]
    return scored.groupBy(*keys).agg(
        *stats,
        F.avg("ref_entities").alias("avg_ref_entities"),
        F.avg("gen_entities").alias("avg_gen_entities"),
        F.avg(F.size("matched_kinds")).alias("avg_matched_kinds"),
        F.count("*").alias("valid_samples"),
    )


def most_missed(scored: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The n kinds missed most often; ties in the order of names."""
    # An outer explode: for an inner one the optimiser would test the list's size below the
    # projection and find all mentions a second time.
    exploded = scored.select(*keys, F.explode_outer("missed_kinds").alias("kind")).where("kind IS NOT NULL")
    counted = exploded.groupBy(*keys, "kind").agg(F.count("*").alias("missed"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("missed"), "kind"))
    return counted.withColumn("place", rank).where(F.col("place") <= n)


def report_generation(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean report score, BLEU and efficacy."""
    df = spread(df.select(*keys, "pred_id", "p_text", "r_text"), "pred_id")  # scores are heavier than their texts
    scored = report_scores(df).select(*keys, "overall", reports.efficacy("p_text", "r_text").alias("e"))
    means = scored.groupBy(*keys).agg(
        F.avg("overall").alias("green_score"), F.avg("e").alias("clinical_efficacy"), F.count("*").alias("valid_samples")
    )
    out = means.join(bleu(df, keys, "pred_id", "p_text", "r_text"), keys)
    return _long(out, keys, ["green_score", "bleu_score", "clinical_efficacy", "valid_samples"])


# Metrics of a task without pairs.
NO_PAIRS = {
    "classification": {"balanced_accuracy": 0.0, "accuracy": 0.0, "f1_score": 0.0, "valid_samples": 0.0},
    "multi-label": {"f1_score": 0.0, "precision": 0.0, "recall": 0.0, "valid_samples": 0.0},
    "detection": {"f1_score": 0.0, "precision": 0.0, "recall": 0.0, "valid_samples": 0.0},
    "instance_detection": {"f1_score": 0.0, "precision": 0.0, "recall": 0.0, "valid_samples": 0.0},
    "counting": {"mean_absolute_error": float("inf"), "valid_samples": 0.0},
    "regression": {"mean_absolute_error": float("inf"), "valid_samples": 0.0},
    "report_generation": {"green_score": 0.0, "bleu_score": 0.0, "valid_samples": 0.0},
}


def with_no_pairs(long: DataFrame) -> DataFrame:
    """Adds the metrics of the tasks of which a model has no pairs."""
    spark = long.sparkSession
    rows = [(task, metric, value) for task, listed in NO_PAIRS.items() for metric, value in listed.items()]
    spine = long.select("model").distinct().crossJoin(F.broadcast(spark.createDataFrame(rows, "task string, metric string, value double")))
    return long.unionByName(spine.join(long.select("model", "task").distinct(), ["model", "task"], "left_anti"))


def metrics(values: DataFrame) -> DataFrame:
    """(model, task, metric, value) of all tasks from parsed pairs.

    The pairs are written once, so that they are joined and parsed once; each task then reads
    its own columns and rows.
    """
    keys = ["model", "task"]
    kinds = [c for c in values.columns if c.startswith(("p_", "r_"))]
    held = written(values.select(*keys, "pred_id", "valid", *kinds).sortWithinPartitions("task"))
    of = lambda *tasks: held.where(F.col("task").isin(*tasks))
    parts = [
        classification(of("classification"), keys),
        multi_label(of("multi-label"), keys),
        detection(of("detection"), keys),
        instance_detection(of("instance_detection"), keys),
        number_errors(of("counting", "regression"), keys),
        report_generation(of("report_generation"), keys),
    ]
    return reduce(DataFrame.unionByName, parts)


def task_counts(values: DataFrame) -> DataFrame:
    """Examples, valid and skipped ones of each model and task, with totals of the model."""
    counted = values.groupBy("model", "task").agg(
        F.count("*").alias("num_examples"), F.count(F.when(F.col("valid"), 1)).alias("valid_examples")
    )
    total = counted.groupBy("model").agg(
        F.lit("overall").alias("task"), F.sum("num_examples").alias("num_examples"), F.sum("valid_examples").alias("valid_examples")
    )
    both = counted.unionByName(total)
    return both.withColumn("skipped_examples", F.col("num_examples") - F.col("valid_examples"))


# Metrics that a comparison shows beside the primary ones.
HIGHER_IS_BETTER = ["accuracy", "f1_score", "balanced_accuracy", "precision", "recall", "green_score"]
LOWER_IS_BETTER = ["mean_absolute_error", "root_mean_squared_error"]


def compare(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Metrics of two models side by side: differences, improvement and its size.

    Both have (task, metric, value). A task that only the base has is an error; metrics of
    one side are left out. Sizes are relative to the base, absolute times 100 where the
    base is zero, infinite where it isn't finite and the values differ.
    """
    missing = base.select("task").distinct().join(tuned.select("task").distinct(), "task", "left_anti")
    if not missing.isEmpty():
        raise KeyError("a task of the base model is missing in the other")
    b, t = F.col("base"), F.col("finetuned")
    infinite = F.lit(float("inf"))
    off = lambda x: F.isnan(x) | (F.abs(x) == infinite)
    both = base.select("task", "metric", F.col("value").alias("base")).join(
        tuned.select("task", "metric", F.col("value").alias("finetuned")), ["task", "metric"]
    )
    return both.withColumn("absolute_diff", t - b).withColumns(
        {
            "relative_diff_percent": F.when(b != 0, F.try_divide(F.col("absolute_diff"), b) * 100),
            # A difference that is no number improves nothing.
            "improvement": ~F.isnan("absolute_diff")
            & F.when(F.col("metric").isin(LOWER_IS_BETTER), F.col("absolute_diff") < 0).otherwise(F.col("absolute_diff") > 0),
            "improvement_magnitude_percent": F.when(b == 0, F.abs("absolute_diff") * 100)
            .when(off(b), F.when(F.isnan("absolute_diff") | (F.col("absolute_diff") != 0), infinite).otherwise(0.0))
            .otherwise(F.abs(F.try_divide(F.col("absolute_diff"), b)) * 100),
            "is_primary_metric": F.coalesce(F.col("metric") == primary_metric(F.col("task")), F.lit(False)),
        }
    )


def comparison_rollup(compared: DataFrame) -> DataFrame:
    """One row: tasks whose primary metric improved, all of them, the rate in percent."""
    primary = compared.where("is_primary_metric")
    return primary.agg(
        F.count(F.when(F.col("improvement"), 1)).alias("improved_tasks"), F.count("*").alias("total_tasks")
    ).withColumn("improvement_rate", ratio(F.col("improved_tasks") * 100, F.col("total_tasks")))


def comparison_details(compared: DataFrame) -> DataFrame:
    """Each task whose primary metric both models have: metric, whether and how much it improved."""
    primary = compared.where("is_primary_metric")
    return primary.select("task", F.col("metric").alias("primary_metric"), F.col("improvement").alias("improved"), "improvement_magnitude_percent")


def shown(value: Column, pattern: str = "%.4f") -> Column:
    """A value as text; what isn't finite by name."""
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .otherwise(F.format_string(pattern, value))
    )


def comparison_lines(compared: DataFrame) -> DataFrame:
    """Report lines in order: per task the primary metric first, then the known ones by name."""
    compared = compared.where(F.col("is_primary_metric") | F.col("metric").isin(HIGHER_IS_BETTER + LOWER_IS_BETTER))
    size = F.col("improvement_magnitude_percent")
    line = F.concat(
        F.when(F.col("is_primary_metric"), "* ").otherwise("  "),
        F.col("metric"),
        F.lit(": "),
        shown(F.col("base")),
        F.lit(" -> "),
        shown(F.col("finetuned")),
        F.lit(" ("),
        F.when(F.col("improvement"), "up ").otherwise("down "),
        F.when(size == float("inf"), "inf").otherwise(F.format_string("%.1f%%", size)),
        F.lit(")"),
    )
    place = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("is_primary_metric"), "metric"))
    return compared.select("task", place.alias("place"), line.alias("line"))
