"""Objects that repeat a key count with its last value."""

from mossgrid.llm.canonical import collapsed_records
from tests.llm.test_canonical import groups


def test_repeated_keys(spark):
    lines = ['{"a": 1, "a": 2}', '{"a": 1, "a": 2}', '{"A": 2}', '{"a": 2, "a": 1}', "{'a': 2}", '{"a": -0.5}', '{"a": "- 0.5"}', '{"b": {"c": 1, "c": 2}}', '{"b": {"c": 1, "c": 2}}']
    assert groups(spark, lines) == {0: {1, 2}, 7: {8}}
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id long, record string")
    assert sorted(tuple(r) for r in collapsed_records(df).collect())[0] == (0, 3, 2)
