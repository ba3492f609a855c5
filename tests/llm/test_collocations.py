import random
import re
from collections import Counter

import pytest

from featspan.llm.collocations import collocations, score_cuts

SCHEMA = "doc_id long, text string, lang string, n long, f long"


def plain_collocations(rows, least, covered=100, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {p for p, a in f.items() if a >= least and len(p) > 2}
    out = []
    for p in often:
        lang, w, a = p[0], p[1:], f[p]
        inside = any(q[0] == lang and len(q) > len(p) and 100 * f[q] >= covered * a and any(q[i : i + len(w)] == w for i in range(1, len(q))) for q in often)
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "a", "of", "New", "york", "City", "été", "x-y", "the", "of", "Été", "la"]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        text = "".join(x + rng.choice([" ", "  ", "\t", " ", ". ", "\n", ",", " "]) for x in w)
        text += rng.choice(["New York City hall is open", "to be or not to be", "aa aa aa aa aa aa", ""])
        rows.append((i, text, rng.choice(["en", "fr", None]), 0, 0))
    copy = (1000, "one line that everyone has. " * 3, "en", 0, 0)
    return rows + [copy] * 40 + [(None, None, None, 0, 0), (2000, "", "en", 0, 0)]


@pytest.mark.parametrize(("least", "shards", "slots"), [(5, 2, 1 << 16), (12, 3, 1 << 16), (12, 1, 1 << 16), (8, 2, 16)])
def test_phrases_equal_plain_counts(spark, least, shards, slots):
    rows = texts(least + shards)
    got = collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), least=least, shards=shards, slots=slots, slice_bytes=2000).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows, least))


def test_few_are_kept_in_order(spark):
    rows = texts(3)
    got = collocations(spark.createDataFrame(rows, SCHEMA), least=5, top=4, covered=60).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_collocations(rows, 5, covered=60, top=4))


def test_products_beyond_64_bits_are_exact(spark):
    a, words, left, right = 9 * 10**12, 8 * 10**13 + 7, 9 * 10**12 + 1, 3 * 10**13 + 11
    rows = [(2, a, words, [left, a], [right, a])]
    got = score_cuts(spark.createDataFrame(rows, "n int, a long, words long, lefts array<long>, rights array<long>")).first()
    assert (got.l, got.r, got.score) == (left, right, 1000 * a * words // (left * right))


def test_no_text(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, 0, 0), (2, " .\n", "en", 0, 0)], SCHEMA), least=1).count() == 0
