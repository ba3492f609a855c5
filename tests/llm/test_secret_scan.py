import random
import string

from plain import known_secrets, masked, sha256
from pyspark.sql import functions as F

from featspan.llm import secret_scan as s

TRICKY = [
    None,
    "",
    "token=api:abcdefghi",
    "token=token:abcdefgh token=secret1 x",
    'api_key : "k-1_2.3=" APIKEY=\'short\' Passwd   =  abcdef',
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "c AKIAAKIA" + "9" * 14,
    "é" * 5 + "deadbeef" * 3 + "ü token=" + "0123456789abcdef" * 3,
    "password=password=password=",
    "x" * 50_000 + " secret:abcdef " + "f" * 24,
]


def plain(spans):
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_known_forms_equal_plain_regexes(spark):
    rng = random.Random(3)
    bits = ["token", "=", ":", " ", '"', "AKIA", "abc", "0f", "Z9", "secret", "API_KEY", "é", "\n", "'", "-"]
    texts = TRICKY + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in s.scan(docs).collect()}
    for i, text in enumerate(texts):
        spans = known_secrets(text)
        assert got[i].base_sha256 == sha256(plain(spans))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert set(filter(None, plain(spans).split(","))) <= set(filter(None, got[i].spans.split(",")))


def test_random_strings_are_told_from_writing(spark):
    rng = random.Random(1)
    letters = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(40)]
    syllables = ["the", "an", "tion", "er", "ing", "re", "ou", "st", "ent", "ly"]
    words = ["".join(rng.choice(syllables) for _ in range(10)) for _ in range(400)]
    rows = [(i, f"say {k} now") for i, k in enumerate(keys)] + [(100 + i, f"say {w} now") for i, w in enumerate(words)]
    rows += [(1000, "say " + "ab" * 20 + " now"), (1001, "say " + "A" * 60 + " now")]
    found = {r.doc_id for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if "random:4:44" in r.spans}
    assert len(found & set(range(40))) >= 36
    assert not {i for i in found if i >= 100}


def test_redaction(spark):
    rows = [(i, t, len(t or ""), "x") for i, t in enumerate(TRICKY)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found string")
    got = s.redact(docs.drop("found")).orderBy("doc_id").collect()
    assert [r.text for r in got] == [t and masked(t, known_secrets(t)) for t in TRICKY]
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_runs_that_reach_beyond_known_forms(spark):
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits
    write = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    texts = [f"say {write(40)}-{write(32, '0123456789abcdef')} now" for _ in range(40)]  # known form: the hex part
    texts += [f"get /{write(20)}/{write(20)}/token=abcdef now" for _ in range(40)]  # the assignment
    texts += [f"say token={write(40)} now" for _ in range(40)]  # wholly a known form
    docs = spark.createDataFrame([(i, t, "b", "f", "k", "K") for i, t in enumerate(texts)], "doc_id long, text string, base string, found string, _kept string, KEPT string")
    got = {r.doc_id: r for r in s.scan(docs).collect()}
    beside = [sum("random" in got[i].spans for i in range(a, a + 40)) for a in (0, 40, 80)]
    assert min(beside[:2]) >= 36 and beside[2] == 0
    assert all(got[i].n_hex == 1 for i in range(40)) and all(got[i].n_assign == 1 for i in range(40, 120))
    masked_ = {r.doc_id: r for r in s.redact(docs).collect()}
    assert s.redact(docs).columns == docs.columns
    assert all((r.base, r.found, r._kept, r[5]) == ("b", "f", "k", "K") for r in masked_.values())
    for i, text in enumerate(texts):
        if "random" in got[i].spans or i >= 80:
            assert masked_[i].text in ("say [secret] now", "get [secret] now"), masked_[i].text


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.scan(docs).count() == 0
    assert s.redact(docs).count() == 0


def test_the_sql_twin_agrees_on_random_runs(spark):
    import duckdb
    import pandas as pd

    from featspan.llm.queries import OP1_SQL

    rng = random.Random(8)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_letters + string.digits + "+/", "etaoinshr", "01"]
    run = lambda: "".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randrange(15, 90)))
    rows = [(i, " ".join(rng.choice([run(), "é", "token=" + run()]) for _ in range(rng.randrange(6)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(TRICKY)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = sorted(tuple(r) for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(con.execute(OP1_SQL).fetchall())
    assert sum("random" in r[5] for r in got) > 50


def test_many_matches_in_one_text(spark):
    rng = random.Random(9)
    letters = string.ascii_letters + string.digits
    words = ["token=abcdef%d" % i if i % 2 else "".join(rng.choice(letters) for _ in range(30)) for i in range(6000)]
    words[100] = "é🙂" + "f0" * 700 + "=token=abcdefg"
    text = " ".join(words)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = s.scan(df).first()
    assert row.n_assign == 3001 and row.n_hex == 1
    spans = [x.split(":") for x in row.spans.split(",")]
    assert spans == sorted(spans, key=lambda x: (int(x[1]), s.KINDS.index(x[0]), int(x[2])))
    assert sum(x[0] == "random" for x in spans) > 2500
    assert s.redact(df).first().text == masked(text, [(int(a), k, int(b)) for k, a, b in spans])


def test_discoveries_inside_known_stretches(spark):
    base = [(0, 0, 10), (10, 2, 20), (30, 0, 40), (35, 2, 50)]
    spans = [(0, 3, 20), (5, 3, 21), (19, 3, 31), (31, 3, 50), (45, 3, 51), (20, 3, 25), (50, 3, 60)]
    kind = "array<struct<start:int,kind:int,end:int>>"
    df = spark.createDataFrame([(base, spans)], f"base {kind}, spans {kind}")
    got = df.select(s._not_within(F.col("spans"), F.col("base")).alias("x")).first().x
    assert [tuple(r) for r in got] == [(5, 3, 21), (19, 3, 31), (20, 3, 25), (45, 3, 51), (50, 3, 60)]
