import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from featspan.llm.packing import Capacity, best_fit, pack, pack_documents, pieces
from featspan.llm.tokens import Encoder

vocabularies = pytest.importorskip("public_tokenizers")
PATH = vocabularies.path("byte_bpe_50k.json")

TEXTS = [
    None, "", " ", "\n", "a  b", "  a", "a\n\nb c", "x \n y", "don't 's a's", "a b c", "a ", "<|endoftext|> x", "a\tb c", "1½ 2²",
    "　x y", "é x", "🙂🙂 a", "it's.' a.b.", "ab%%% c'd", "x\ny.\nz\n", "é öx", "word " * 3000, "z" * 5000,
]


@cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_remembered_words_encode_like_whole_texts():
    rng = random.Random(1)
    bits = ["the", "Re", " ", " ", "\n", "  ", ".", ",", "é", "12", "'s", "ing", "$$", "ß", "中", "\t"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(30)) for _ in range(400)]
    for memory in (500_000, 5):
        for text, got in zip(texts, Encoder(PATH, memory).encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole(text), text


def test_pieces_hold_the_documents_ids(spark):
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")
    rows = pieces(df, PATH, 100, ids=True).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == [*whole(text), 2]
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.length == 100 for r in own[1:]) and 1 <= own[0].length <= 100
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in own)


def test_queries_encode_like_the_untouched_tokenizer(spark, tmp_path):
    import corpus_pipeline
    from featspan.llm.queries import op4_best_fit_packing
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(PATH)
    texts = [*TEXTS, "a <|endoftext|> x", "a<|endoftext|>", "<|endoftext|><|endoftext|> b", "a <|endoftext| > x", "word " * 2000 + "<|endoftext|> x"]
    ids = [untouched.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids[len(TEXTS)] == [64, 220, 50256, 2124]
    for memory in (500_000, 5):
        assert [np.frombuffer(g, "<u4").tolist() for g in Encoder(PATH, memory, added=True).encode([t or "" for t in texts])] == ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (op4_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, df, str(tmp_path))):
        got = {}
        for r in rows.collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, own in enumerate(ids):
            whole_ids = np.array([*own, 2], "<u4")
            for r in got[i]:
                assert zlib.crc32(whole_ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert sum(r.length for r in got[i]) == len(whole_ids)


def laid_out(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity.tokens and len(own) <= capacity.documents
        assert sum(r.length**2 for r in own) <= capacity.attention or len(own) == 1
    return len(bins)


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(documents=3), Capacity(attention=300_000)])
def test_every_capacity_holds(spark, capacity):
    rng = random.Random(7)
    sizes = [rng.randrange(1, 500) for _ in range(3000)]
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for group in (8192, 500):
        rows = pack(cut, capacity, group).collect()
        assert sorted(r.length for r in rows) == sorted(sizes)
        used = laid_out(rows, capacity)
        least = max(sum(sizes) / capacity.tokens, len(sizes) / capacity.documents, sum(n * n for n in sizes) / capacity.attention)
        assert used <= 1.1 * least + 8


def test_best_fit_prefers_the_tightest_bin():
    bins, offsets = best_fit(np.array([600, 500, 500, 420, 24]), Capacity())
    assert bins[0] == bins[3] and bins[1] == bins[2] == bins[4]
    assert offsets.tolist() == [0, 0, 500, 600, 1000]


def test_documents_are_packed_whole(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, None), (None, "x y"), (None, "x y")], "doc_id long, text string")
    rows = pack_documents(df, PATH).collect()
    laid_out(rows, Capacity())
    assert sum(r.length for r in rows) == sum(len(whole(t)) + 1 for t in [*TEXTS, None, "x y", "x y"])
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_equal_rows_fill_several_groups(spark):
    from featspan.llm.packing import PIECES
    from featspan.llm.storage import materialise

    rows = spark.range(6000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "100L as length", "5L as ids_crc32")
    cut = materialise(spark.createDataFrame(rows.rdd, PIECES).repartition(3), "equal")
    got = pack(cut, Capacity(tokens=1024), group=1000).selectExpr("sequence_id >> 32 as g", "sequence_id", "offset", "length").collect()
    by = Counter(r.g for r in got)
    assert len(by) == 6 and max(by.values()) < 1300
    assert len({r.sequence_id for r in got}) <= 6000 / 10 + 6


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_plain_best_fit(seed):
    """Longest first, each into the fullest sequence that holds it: as many sequences, as full."""
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 1025), rng.randrange(1, 200), 1024]) for _ in range(700)]
    left = []
    for n in sorted(lengths, reverse=True):
        room = [(space - n, k) for k, space in enumerate(left) if space >= n]
        if room:
            left[min(room)[1]] -= n
        else:
            left.append(1024 - n)
    bins, offsets = best_fit(np.array(lengths), Capacity(tokens=1024))
    used = Counter()
    for b, n in zip(bins.tolist(), lengths, strict=True):
        used[b] += n
    assert sorted(used.values()) == sorted(1024 - space for space in left)
    for b in used:
        own = sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if x == b)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
