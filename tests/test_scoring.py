import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from featspan.operators import metrics as m


def area(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture
def binary(spark):
    rnd = random.Random(0)
    rows = []
    for _ in range(300):
        p = rnd.choice([rnd.random(), 0.25, 0.5])
        y = int(rnd.random() < 0.3 + 0.4 * p)
        rows.append((y, float(p > 0.5), [1 - p, p]))
    return rows, spark.createDataFrame(rows, "label int, prediction double, probability array<double>").repartition(4)


def test_binary_metrics(spark, binary):
    rows, df = binary
    want = area([r[0] for r in rows], [r[2][1] for r in rows])
    assert m.auc_binary(df).first()["value"] == pytest.approx(want)
    raw = df.withColumn("rawPrediction", F.col("probability")[1])
    assert BinaryClassificationEvaluator(numBins=0).evaluate(raw) == pytest.approx(want)
    tp = sum(y == 1 and z == 1 for y, z, _ in rows)
    f1 = 2 * tp / (sum(y == 1 for y, _, _ in rows) + sum(z == 1 for _, z, _ in rows))
    acc = sum(y == z for y, z, _ in rows) / len(rows)
    both = m.metrics(df, m.METRICS, m.BINARY).first()
    assert both["scores"] == pytest.approx({"auc": want, "F1-score": f1, "Acc": acc})
    assert both["score"] == pytest.approx(want + f1 + acc)


def test_multi_class_metrics(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(200):
        probs = [rnd.choice([0.1, 0.3, rnd.random()]) for _ in range(4)]
        rows.append((rnd.randrange(4), float(probs.index(max(probs))), probs))
    df = spark.createDataFrame(rows, "label int, prediction double, probability array<double>")
    want = sum(area([r[0] == c for r in rows], [r[2][c] for r in rows]) for c in range(4)) / 4
    assert m.auc_macro(df).first()["value"] == pytest.approx(want)
    f1s = []
    for c in range(4):
        tp = sum(y == c and z == c for y, z, _ in rows)
        f1s.append(2 * tp / (sum(y == c for y, _, _ in rows) + sum(z == c for _, z, _ in rows)))
    assert m.f1_macro(df).first()["value"] == pytest.approx(sum(f1s) / 4)


def test_f1_macro_sees_classes_that_are_only_predicted(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 1.0)], "label int, prediction double")
    assert m.f1_macro(df).first()["value"] == pytest.approx((2 / 3 + 1 + 0) / 3)


def test_one_class_has_no_area_and_nothing_found_is_zero(spark):
    df = spark.createDataFrame([(0, 0.0, [0.5, 0.5])] * 3, "label int, prediction double, probability array<double>")
    assert m.auc_binary(df).first()["value"] is None
    assert m.f1_positive(df).first()["value"] == 0


def test_unknown_metrics(spark, binary):
    _, df = binary
    assert m.metric(df, "mse", m.REGRESSION).first()["value"] == 0
    with pytest.raises(ValueError):
        m.metric(df, "mse", m.BINARY, compatible=False)


def test_area_never_gathers_all_scores_in_one_task(binary):
    plan = m.auc_binary(binary[1])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
