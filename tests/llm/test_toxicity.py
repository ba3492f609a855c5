import random
import zlib

import numpy as np
import pyarrow as pa

from featspan.llm.toxicity import Index, Settings, classify_toxicity, fit, known_terms, score_toxicity, unit

RUDE = ["scum", "idiot", "trash", "Énorme", "clown"]


def corpus(n=900):
    rng = random.Random(12)
    syllables = ["the", "an", "tion", "er", "ing", "re", "ou", "st", "ent", "ly"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = [word() for _ in range(rng.randrange(20, 150))]
        if toxic:
            for _ in range(rng.randrange(2, 7)):
                w[rng.randrange(len(w))] = rng.choice(RUDE) + rng.choice(["", "!", ","])
        text = " ".join(w)
        docs.append((i, text.upper() if i % 7 == 0 else text, "x"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
        elif toxic:
            labels.append((i, 1, 1))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in classify_toxicity(*frames(spark, docs, labels)).collect()}
    assert len(got) == len(docs)
    assert {i for i, r in got.items() if r.held_out} == {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.98 * len(held)
    assert all(e.toxic == 1 and e.doc_id != r.doc_id for r in held if r.predicted for e in r.evidence)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(500)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    one, other = (classify_toxicity(*frames(spark, docs, x)).select("doc_id", "score").collect() for x in (labels, turned))
    assert sorted(one) == sorted(other)


def test_neighbours_equal_all_cosines():
    rng = np.random.default_rng(3)
    terms, n = 40, 700
    vectors = []
    for _ in range(n):
        places = np.sort(rng.choice(terms, rng.integers(1, 9), replace=False))
        vectors.append((places, unit(places, rng.integers(1, 4, len(places)), np.linspace(0.5, 3, terms))))
    ids = rng.permutation(10_000)[:n]
    index = Index(ids, np.ones(n, np.int64), np.ones(n), vectors, terms)
    dense = np.zeros((n, terms))
    for i, (places, weights) in enumerate(vectors):
        dense[i, places] = weights
    for i in range(60):
        places, weights = vectors[i]
        at, cosines = index.nearest(places, weights, 15, int(ids[i]))
        exact = dense @ dense[i]
        want = sorted((-round(c, 9), j) for c, j in zip(exact.tolist(), ids.tolist(), strict=True) if j != ids[i] and c > 0)[:15]
        assert [round(-c, 9) for c in cosines.tolist()] == [c for c, _ in want]
        assert {j for c, j in want if c < want[-1][0]} <= set(index.ids[at].tolist())


def test_scores_are_the_same_in_any_division(spark):
    docs, labels = corpus(400)
    d, marks = frames(spark, docs, labels)
    judge = fit(d, marks, Settings(per_class=60))
    one = sorted(score_toxicity(d.repartition(7), judge).select("doc_id", "score").collect())
    assert one == sorted(score_toxicity(d.coalesce(1), fit(d.repartition(3), marks, Settings(per_class=60))).select("doc_id", "score").collect())


def test_odd_rows(spark):
    docs, labels = corpus(400)
    docs += [(5000, None, ""), (5001, "", ""), (None, "scum idiot", ""), (5002, "scum " * 50_000, ""), (1, docs[0][1], "")]
    labels += [(None, 1, 1), (5000, 1, None), (5001, 1, 7), (2, 0, 1), (2, 0, 0)]
    got = classify_toxicity(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.1
    assert by[5002].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False


def test_no_rows_and_no_labels(spark):
    d, marks = frames(spark, *corpus(30))
    assert classify_toxicity(d.limit(0), marks).count() == 0
    assert {r.score for r in classify_toxicity(d, marks.limit(0)).collect()} == {0.0}
    assert {r.predicted for r in classify_toxicity(d, marks.where("toxic = 1")).collect()} == {1}


def test_terms_of_a_text():
    vocabulary = np.sort(np.zeros(0, np.uint64))
    assert len(known_terms(pa.array(["a b", None]), vocabulary)[0]) == 0
