"""Nulls in any column, ids included, crash no operator and lose no row."""

from mossgrid.llm import canonical, mixture, overlap, pairs, quota, related, spans, tokens


def test_overlap(spark):
    rows = [(None, "training", "a_1.png", "x", "which one is it"), (1, "testing", "a_1.png", "x", "which one is it"), (2, "training", "A_1.png", "X", "Which one is it?"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "rec_id long, split_dir string, ImageName string, Answer string, Question string")
    assert [tuple(r) for r in overlap.cross_split_overlaps(df).collect()] == [(2, 1)]


def test_quota_and_splits(spark):
    rows = [(None, None, None, None), (None, "a_1.png", "Detection", "CT"), (1, None, None, "CT"), (2, "a_2.png", "Detection", None)]
    df = spark.createDataFrame(rows, "rec_id long, ImageName string, TaskType string, Modality string")
    targets = spark.createDataFrame([("CT", "Detection", 1000, 1), (None, None, None, None)], "Modality string, TaskType string, target_permille int, min_rows int")
    sample, report = quota.proportional_sample(df, targets)
    assert sample.count() == 1 and report.count() == 1  # the minimum counts more than the size
    splits = spark.createDataFrame([("train", 900), ("test", 100), (None, None)], "split_name string, target_permille int")
    out = related.grouped_splits(df, splits).collect()
    assert len(out) == 4 and len({r["split_name"] for r in out if r["group_key"] == "a"}) == 1
    assert sorted((r["rec_id"] or 0, r["group_key"]) for r in related.related_records(df).collect()) == [(0, "a"), (2, "a")]


def test_lines_and_pairs(spark):
    df = spark.createDataFrame([(None, '{"a": 1}'), (1, '{"A": 1}'), (None, None), (2, '{"a":1}')], "raw_id long, record string")
    assert [tuple(r) for r in canonical.formatting_duplicates(df).collect()] == [(1, 2)]
    assert canonical.collapsed_records(df).first()["n_copies"] == 3
    p = spark.createDataFrame([(None, None, None, None), (1, None, "q", "a fine answer.")], "pred_id long, TaskType string, Question string, Answer string")
    terms = spark.createDataFrame([(None,)], "term string")
    assert [tuple(r) for r in pairs.broken_pairs(p, terms).collect()] == [(None, "empty")]


def test_documents(spark):
    text = "one two three " * 30
    df = spark.createDataFrame([(None, text, None), (1, text, "a"), (2, text, None), (None, None, "a")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_spans(df).collect()} == {1: len(text), 2: len(text)}
    assert tokens.encode(df).count() == 4
    targets = spark.createDataFrame([("a", 1000, 2), (None, 5, None)], "source string, target_permille int, max_repeats int")
    mixed, report = mixture.mix_sources(df, targets)
    assert report.count() == 1 and {r["source"] for r in mixed.collect()} == {"a"}
