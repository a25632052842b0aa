import random

from pyspark.sql import functions as F

from waymark.llm import quality
from waymark.llm.fit import Logistic, fold


def tables(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice("the of and to in is that for with as by on at from or".split()) + rnd.choice("abcdefgh") for _ in range(120)]
        good = i % 3 > 0
        text = " ".join(words) + "." if good else " | ".join(w.upper() + "##" for w in words)
        rows.append((i, text, "z"))
        labels.append((i, int(good)))
    rows += [(700, None, "z"), (701, "", "z"), (702, "W## | " * 300_000, "z"), (None, "x", "z"), (5, rows[5][1], "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = tables(spark)
    got = quality.scores(docs, labels, fold("doc_id", 5) != 0).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["score"] for r in got}
    held = {r["doc_id"] for r in docs.where(fold("doc_id", 5) == 0).collect()} & set(range(600))
    assert held and sum((by[i] >= 0.3) == (i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert by[700] == by[701] and all(0 <= s <= 1 for s in by.values()) and by[702] < 0.3


def test_no_labels_and_no_rows(spark):
    docs, labels = tables(spark)
    assert {round(r["score"], 6) for r in quality.scores(docs, labels.where(F.lit(False)), F.lit(True)).collect()} == {0.5}
    assert quality.scores(docs.where(F.lit(False)), labels, F.lit(True)).count() == 0


def test_logistic_is_calibrated():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    p = 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))
    y = rng.random(5000) < p
    assert abs(Logistic(x, y).score(x) - p).mean() < 0.02
