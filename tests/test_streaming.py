"""The stream gives what a batch over the same files gives."""

import shutil

from pyspark.sql import functions as F

from mossgrid.streaming.evaluation import prediction_stream, windowed_label_counts

SOURCE = "/root/testdata/sf0.001/predictions.parquet"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(SOURCE, tmp_path / "in/a.parquet")
    batch = spark.read.parquet(SOURCE).withColumn("run_at", F.col("run_at").cast("timestamp"))
    stream = prediction_stream(spark, str(tmp_path / "in"), spark.read.parquet(SOURCE).schema)
    query = windowed_label_counts(stream).writeStream.outputMode("complete").format("memory").queryName("labels").start()
    try:
        query.processAllAvailable()
        plain = lambda df: sorted(tuple(r) for r in df.select(F.col("window.start").cast("string"), "model", "label", "n").collect())
        got = plain(spark.table("labels"))
    finally:
        query.stop()
    assert got == plain(windowed_label_counts(batch.dropDuplicates(["pred_id"]))) and got
