"""Run-time helpers shared by the operators: sessions, checkpoints, ordered budget cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "mossgrid", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MOSSGRID_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` of the session wins. Only on a single machine (tests) a temporary
    folder is used where it is unset; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="mossgrid-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back without its lineage.

    Reliable checkpoint: the data survive the loss of any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Has a folder deleted when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, as a compressed columnar table: several times smaller, and
    columns that aren't needed aren't read again. Its partitions aren't those of ``df``. The
    table is deleted when the driver ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    delete_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def write_text(spark: SparkSession, path: str, *parts: str) -> None:
    """A small text file, on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for part in parts:
            out.write(part.encode())
    finally:
        out.close()


def join_parts(spark: SparkSession, folder: str, path: str, before: str, after: str, drop: int) -> None:
    """One file of the part files of a folder in their order, as a stream from file to file.
    The last ``drop`` bytes, a separator after the last record, are left out."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    found = system.listStatus(hadoop.fs.Path(folder))
    parts = sorted((str(s.getPath()), s.getLen()) for s in found if s.getPath().getName().startswith("part-") and s.getLen())
    out = system.create(target, True)
    try:
        out.write(before.encode())
        for i, (part, size) in enumerate(parts, 1):
            source = system.open(hadoop.fs.Path(part))
            try:
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - drop * (i == len(parts)))
            finally:
                source.close()
        out.write(after.encode())
    finally:
        out.close()


def spread(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Hash-partitioned by the columns into as many parts as the session shuffles, at least
    two for each core. For stages that are heavier than their bytes, Python ones above all:
    AQE would merge their small partitions by size."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *cols)


def fingerprint(*cols: Column) -> tuple[Column, Column]:
    """128 bits of hash over the columns, as two independently seeded longs."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)


def budget_cut(
    df: DataFrame,
    budgets: DataFrame,
    group: str,
    key: Column,
    weight: Column,
    tie: str,
    bucket_bits: int = 12,
) -> DataFrame:
    """Rows of each group, in the order of a random ``key``, until the budget is met.

    ``budgets`` has one row per group: ``group`` and a long ``budget``; its size is that
    of a target table, so it may be broadcast. A row is taken if the weight of the rows
    before it is below the budget: with weight 1 exactly ``budget`` rows are taken. ``tie``
    names a unique column that orders equal keys.

    No group is ever sorted as a whole. The key's top ``bucket_bits`` bits name a bucket,
    bucket weights are pre-aggregated on the map side, a running sum over at most
    ``2**bucket_bits`` rows per group finds the one bucket the budget ends in, and only
    that bucket's rows are ranked. Adds ``__before``: the weight before the row if it is
    in the cut bucket, else null.
    """
    keyed = df.withColumn("__key", key).withColumn("__w", weight.cast("long"))
    keyed = keyed.withColumn("__bucket", F.shiftrightunsigned("__key", 64 - bucket_bits))
    per_bucket = keyed.groupBy(group, "__bucket").agg(F.sum("__w").alias("__bw"))
    running = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        per_bucket.join(F.broadcast(budgets.select(group, "budget")), group)
        .withColumn("__start", F.coalesce(F.sum("__bw").over(running), F.lit(0)))
        .where(F.col("__start") < F.col("budget"))
        .groupBy(group)
        .agg(
            F.max(F.struct("__bucket", "__start", "budget")).alias("__last"),
        )
        .select(
            group,
            F.col("__last.__bucket").alias("__cut"),
            F.col("__last.__start").alias("__cut_start"),
            F.col("__last.budget").alias("__budget"),
        )
    )
    # One row per group of the target table: bounded by that table.
    marked = keyed.join(F.broadcast(cuts), group).where(F.col("__bucket") <= F.col("__cut"))
    whole = marked.where(F.col("__bucket") < F.col("__cut")).withColumn("__before", F.lit(None).cast("long"))
    inside = Window.partitionBy(group).orderBy("__key", tie)
    ranked = (
        marked.where(F.col("__bucket") == F.col("__cut"))
        .withColumn(
            "__before",
            F.col("__cut_start")
            + F.coalesce(F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .where(F.col("__before") < F.col("__budget"))
    )
    return whole.unionByName(ranked).select(*df.columns, "__before")
