import os

import pytest
from plain import contamination, known_secrets, masked, near_copies

import corpus_pipeline as p
from featspan.llm import quality
from featspan.llm.storage import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_equal_plain_versions(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    outs = []
    for name, stage in p.STAGES:
        docs = p.materialise(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        outs.append(docs)
    good, unique, clean, safe, packed = outs
    assert all(x.columns == columns for x in (good, unique, clean, safe))

    y = {r.doc_id: r.predicted for r in quality.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    rows = [(i, r.text) for i, r in before.items() if y[i] == 1]
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, _ in rows)

    groups = near_copies(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, _ in rows)

    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {i for i, *_, hit in contamination(rows, items) if hit}
    rows = [(i, t) for i, t in rows if i not in bad]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows)

    # the tables hold no random strings beyond the known forms
    want = {i: masked(t, known_secrets(t)) for i, t in rows}
    got = {r.doc_id: r for r in safe.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(want[i]) for i, r in got.items())
    assert all((r.lang, r.source) == (before[i].lang, before[i].source) for i, r in got.items())

    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(want)
    used = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024
    assert len(used) <= sum(used.values()) / 1024 * 1.02 + 2


def test_run_gives_the_last_stage(spark):
    assert p.ORACLE_SQL is None
    assert p.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
