import random
import tracemalloc

import numpy as np
import pytest
from plain import contamination, sha256

from featspan.llm.decontam import TestIndex, decontaminate, judge, matches, words_of


def tables(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)] + ["é", "naïve"]
    write = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(write(rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(9, 21)]
    items += [(30, None), (31, "..."), (32, items[2][1].lower()), (33, "W1-w2,W3 " * 8), (None, items[0][1])]
    docs = []
    for i in range(80):
        w = write(rng.randrange(0, 60))
        if i % 4 == 0 and (own := (rng.choice(items)[1] or "").split()):
            at = rng.randrange(len(own))
            w[len(w) // 2 : len(w) // 2] = own[at:] if i % 8 else own
        docs.append((i, rng.choice([" ", "; ", "\n"]).join(w)))
    return [*docs, (200, None), (201, ""), (202, "W1 w2 w3 " * 400), (203, "--")], items


@pytest.mark.parametrize("block_words", [2_000_000, 50])
def test_hits_equal_plain_search(spark, block_words):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in judge(d, b, block_words=block_words).collect()), key=str)
    want = contamination(docs, [x for x in items if x[0] is not None])
    assert got == sorted(((i, n, h, len(k), sha256(",".join(k)), c) for i, n, h, k, c in want), key=str)
    kept = decontaminate(d.selectExpr("text", "doc_id", "1 as items"), b)
    assert kept.columns == ["text", "doc_id", "items"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_, c in want if not c)


def test_longest_match_and_places(spark):
    passage = [f"p{i}" for i in range(30)]
    d = spark.createDataFrame([(1, " ".join(["x"] * 5 + passage[3:23] + ["y"]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    row = matches(d, b).first()
    assert (row.covered, row["items"], row.longest) == ([5, 25], ["7"], 20)


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_long_items_are_cut_without_loss(spark, block_words):
    words = [f"w{i % 37}x{i % 41}" for i in range(900)]
    d = spark.createDataFrame(
        [(1, " ".join(["a", *words[100:420], "b"])), (2, " ".join(words[50:70])), (3, " ".join(words[-13:])), (4, " ".join(words[:12]))],
        "doc_id long, text string",
    ).coalesce(1)
    b = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[300:330]))], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.longest) for r in matches(d, b, block_words=block_words).collect()}
    assert got == {1: (["7", "8"], 320), 2: (["7"], 20), 3: (["7"], 13), 4: ([], 0)}
    rows = {r.doc_id: (r.n_words, r.n_hit) for r in judge(d, b, block_words=block_words).collect()}
    assert rows == {1: (322, 320), 2: (20, 20), 3: (13, 13), 4: (12, 0)}


def test_memory_grows_with_the_words_not_with_their_square():
    words = words_of(" ".join(f"w{i % 997} v{i % 1009}" for i in range(20_000)))
    tracemalloc.start()
    index = TestIndex([("7", words, 13)], 13)
    numbers = np.array([index.ids[w] for w in words], np.uint32)
    found = list(index.search(numbers, np.full(len(words), len(words))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(words) - 12 and max(int(x[3].max()) for x in found) == len(words)
    assert most < 100_000_000


def test_nulls_repeats_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(5, "A b"), (5, "A b")], "item_id long, text string")
    for block_words in (100, 1):
        rows = judge(d, b.union(spark.createDataFrame([(6, "c d e")], b.schema)), block_words=block_words).collect()
        assert sorted((r.doc_id or 0, r.n_hit, r.contaminated) for r in rows) == [(0, 2, True), (1, 2, True), (1, 2, True), (2, 0, False)]
    # a row goes by its own text, with an id or without, and whatever other rows share its id
    more = d.union(spark.createDataFrame([(None, "x y"), (1, "clean"), (None, None)], d.schema)).withColumn("_text_key", d["doc_id"] * 0)
    kept = decontaminate(more, b)
    assert kept.columns == more.columns
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str) == [(0, "x y"), (0, None), (1, "clean"), (2, None)]
    assert judge(d, b.limit(0)).where("contaminated").count() == 0
    assert judge(d.limit(0), b).count() == 0
