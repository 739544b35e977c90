"""Staged field expressions equal the nested ones."""

from pyspark.sql import functions as F

from mossgrid.functions import fields

ROWS = ["a/S1_01.png", '["s2_1.png", "x/s3_1.png"]', "['B_1.png', '', null]", "[broken", None, " ", "x\\S3_9.PNG ", "plain.png", "_x.png", "[]", '["a_1.png", "A_2.png"]', "a/", ".hidden"]


def test_staged(spark):
    df = spark.createDataFrame([(i, x, "names") for i, x in enumerate(ROWS)], "i int, f string, other string")
    both = fields.with_study_keys(fields.with_file_names(df, "f", "n"), "f", "k")
    for r in both.withColumns({"n2": fields.file_names(F.col("f")), "k2": fields.study_keys(F.col("f"))}).collect():
        assert (r["n"], r["k"]) == (r["n2"], r["k2"]), r["f"]
    assert both.columns == ["i", "f", "other", "n", "k"]
