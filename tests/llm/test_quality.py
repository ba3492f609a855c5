import random
import zlib

import numpy as np
import pytest

from featspan.llm.quality import WIDTH, classify, drop_rejected, statistics_of


def corpus(n=600):
    rng = random.Random(6)
    syllables = ["the", "an", "tion", "er", "ing", "re", "ou", "st", "ent", "ly"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(30, 200))]
        good = i % 4 != 0
        if good:
            text = ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9))
        else:
            text = rng.choice([lambda: " | ".join(w), lambda: " ".join([w[0]] * len(w)), lambda: "!! ".join(w).upper()])()
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    one, two = (
        {r.doc_id: r.score for r in classify(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, turned)
    )
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_rejected_documents_go(spark):
    docs, labels = corpus(300)
    rows = [(t, i, "c") for i, t in docs] + [("", 900, "c"), (None, 901, "c"), (docs[1][1], None, "c")]
    d = spark.createDataFrame(rows, "text string, doc_id long, score string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = drop_rejected(d, y)
    assert kept.columns == ["text", "doc_id", "score"]
    stays = {r.doc_id for r in classify(d, y).collect() if r.predicted == 1}
    assert {r.doc_id for r in kept.collect()} == stays
    assert None in stays


@pytest.mark.parametrize(("given", "score"), [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (1, 0)], 0.0), ([(1, None), (None, 1), (7, 1)], 0.5)])
def test_without_both_classes(spark, given, score):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame(given, "doc_id long, quality int")
    assert zlib.crc32(b"1") % 5
    rows = classify(d, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {score}
    assert classify(d.limit(0), labels).count() == 0


def test_statistics_of_nothing():
    assert statistics_of(None) == statistics_of(" \n ") == (0, [0.0] * WIDTH)


def test_scores_equal_a_plain_discriminant(spark):
    docs, labels = corpus(400)
    docs += [(9000, None), (9001, "a"), (9002, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), shrinkage=0.1, calm=20.0).collect()}
    made = {i: statistics_of(t) for i, t in docs}
    quality = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5}
    centre = np.mean([made[i][1] for i in quality], axis=0)
    drawn = {i: centre + (np.array(x) - centre) * n / (n + 20.0) for i, (n, x) in made.items()}
    scale = np.std([drawn[i] for i in quality], axis=0)
    scale = np.maximum(scale, 1e-4)
    log = {}
    for k in (0, 1):
        own = np.array([drawn[i] / scale for i, q in quality.items() if q == k])
        spread = np.cov(own.T, bias=True)
        spread = 0.9 * spread + 0.1 * np.trace(spread) / WIDTH * np.eye(WIDTH)
        inverse, det = np.linalg.inv(spread), np.linalg.slogdet(spread)[1]
        gap = {i: x / scale - own.mean(axis=0) for i, x in drawn.items()}
        log[k] = {i: np.log(len(own)) - det / 2 - g @ inverse @ g / 2 for i, g in gap.items()}
    for i in drawn:
        assert got[i] == pytest.approx(1 / (1 + np.exp(np.clip(log[0][i] - log[1][i], -700, 700))), abs=1e-4)  # moments and centred sums round differently
