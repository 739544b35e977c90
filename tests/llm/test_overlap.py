"""Cross-split overlaps against all pairs of a small random table."""

import random
import re

from mossgrid.llm.overlap import cross_split_overlaps, overlap_report

COLUMNS = "rec_id long, split_dir string, dataset string, Question string, Answer string, ImageName string, id string, train string, q string"


def brute(rows):
    words = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    names = lambda x: frozenset(n for p in re.findall(r"[^\[\]\"',]+", x or "") if (n := re.split(r"[/\\]", p.strip())[-1].strip().lower()))
    out = []
    for a in rows:
        for b in rows:
            if a[1] == "training" and b[1] not in ("training", None) and names(a[5]) and names(a[5]) == names(b[5]):
                x, y = set(words(a[3])), set(words(b[3]))
                if words(a[4]) and words(a[4]) == words(b[4]) and x and len(x & y) * 5 >= 4 * max(len(x), len(y)):
                    out.append((a[0], b[0]))
    return sorted(out)


def test_random(spark):
    r = random.Random(3)
    rows = []
    bases = ["a b c d e f g h i j", "a b c d e k l m n o p", "q r", "s t u v w x", ""]
    for i in range(400):
        text = " ".join(w if r.random() < 0.93 else r.choice("zy") for w in r.choice(bases).split())
        image = r.choice(["imagesTr/x_1.png", "X_1.PNG", '["y_1.png", "q//x_1.png"]', "['x_1.png', 'y_1.png']", "\\z\\x_1.png", None, " ", "[]"])
        rows.append((i, r.choice(["training", "testing", "validation-public", None]), "d", r.choice([text, text.upper(), None]), r.choice(["A", "a.", "b b", "", None, "!"]), image, "clash", "clash", "clash"))
    rows += rows[:5]
    df = spark.createDataFrame(rows, COLUMNS)
    got = sorted((p["train_id"], p["eval_id"]) for p in cross_split_overlaps(df).collect())
    assert got == brute(rows) and len(got) > 15


def test_long_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    near = text.replace("w7 ", "v7 ")
    rows = [(1, "training", "d", text, "A", "x_1.png"), (2, "testing", "d", near, "A", "x_1.png"), (3, "testing", "e", "w1 w2", "A", "x_1.png")]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], COLUMNS)
    pairs = cross_split_overlaps(df)
    assert [tuple(p) for p in pairs.collect()] == [(1, 2)]
    report = {(r["split_dir"], r["dataset"]): (r["n_records"], r["n_overlapping"]) for r in overlap_report(df, pairs).collect()}
    assert report == {("testing", "d"): (1, 1), ("testing", "e"): (1, 0)}
    assert cross_split_overlaps(df.limit(0)).count() == 0
