import random

import pytest
from plain import near_copies, without_repeats

from featspan.llm.minhash import accidental, drop_near_duplicates, estimate, hyper_registers, near_duplicates
from featspan.llm.substring import COVER, PERIOD, repeated_passages
from featspan.llm.text import U64, mixed


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    write = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, passage, base = [], write(40), write(90)
    for i in range(60):
        w = write(rng.randrange(0, 120))
        if i % 3 == 0:
            w[rng.randrange(len(w) + 1) :][:0] = passage[rng.randrange(20) :]
            w = w[: len(w) // 2] + passage[rng.randrange(25) :] + w[len(w) // 2 :]
        rows.append((i * 3 % 101, rng.choice(" \t\n").join(w)))
    for i in range(50):  # a family whose members are more and less alike
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(90)] = rng.choice(vocabulary)
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, " ".join(base).upper() if i % 2 else "  ".join(base)) for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "a b c"), (404, "A B C"), (405, "a b"), (406, "x " * 5000), (407, "x " * 5001)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4)


def test_near_copies_equal_all_pairs(docs):
    want = near_copies(corpus())
    for block in (1024, 7):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, block=block).collect()}
        assert got == want


def test_one_of_each_group_stays(docs):
    want = {i for i, (_, name) in near_copies(corpus()).items() if i == name}
    kept = drop_near_duplicates(docs.selectExpr("text", "doc_id", "1 as component_id"))
    assert kept.columns == ["text", "doc_id", "component_id"]
    assert {r.doc_id for r in kept.collect()} == want


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_corrected_for_collisions():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = (mixed(rng.integers(0, 1 << 62, 3000).astype(U64)) for _ in range(2))
    a[:2000] = b[:2000]  # 2000 of 4000
    regs = hyper_registers(np.concatenate([a, b]), np.array([3000, 3000]), 2000)
    n = np.array([3000])
    assert abs(estimate(regs[:1], regs[1:], n, n)[0] - 0.5) < 0.06
    assert 0 < accidental(n.astype(float), n.astype(float))[0] < 2 / 2**10


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("block", [8 << 20, 600])
def test_repeats_equal_plain_windows(spark, docs, block):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in repeated_passages(docs, block_bytes=block).collect())
    assert got == sorted(without_repeats(corpus()))


def test_repeats_of_odd_rows(spark):
    run = " ".join(f"t{i}" for i in range(20))
    rows = [(None, run), (5, run), (5, run), (7, f"{run} {run}"), (9, None), (9, "")]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in got))
    assert by == [(0, 20, 20), (5, 20, 0), (5, 20, 0), (7, 40, 40), (9, 0, 0), (9, 0, 0)]
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_are_copies_too(spark):
    run, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, run, 1), (None, run + " end", 2), (3, run, 3), (None, other, 4), (None, other, 5), (None, "", 6), (None, None, 7), (None, " ", 8)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _near_key int")).collect()
    assert sorted(r._near_key for r in kept if r._near_key not in (4, 5)) == [3, 6, 7, 8]
    assert sum(r._near_key in (4, 5) for r in kept) == 1
