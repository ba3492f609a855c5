import hashlib
import random

import pytest

from featspan.llm import warc
from featspan.llm.storage import new_folder

MAGIC = warc.MAGIC


def fake_record(body: str) -> str:
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: {len(http)}\r\n\r\n{http}\r\n\r\n"


def pages():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        body = "".join(rng.choice("abc <>\n") for _ in range(rng.randrange(0, 900)))
        rows.append((i, f"http://x/{i}", f"<p>{body}"))
    copy = "<html>" + "é copied " * 200
    rows += [(i, None, copy) for i in range(200, 230)]
    rows += [(300, "http://a b\r\nc", None), (301, "u", ""), (302, "u", MAGIC), (303, "u", MAGIC * 40 + "x" * 3000 + MAGIC)]
    rows += [(304 + k, "u", "start " + fake_record("y" * 50) * (k + 1) + " end") for k in range(4)]
    rows += [(310, "u", "z" * 30_000 + fake_record("w" * 20_000) + "q"), (311, "u", "short"), (312, "u", "short"), (313, "u", f"a{MAGIC}WARC-Type: x\r\nContent-Length: 10\r\n\r\n")]
    return rows


def expected(rows):
    out = []
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            first[h] = max(first.get(h, i), i)
    for i, _, h in rows:
        h = (h or "").encode()
        again = i is not None and first.get(h, i) != i
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


@pytest.fixture(params=["128m", "2000b"])
def split(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip_with_magic_inside_payloads(spark, split):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive_pages(spark, df).collect()), key=str)
    assert got == expected(rows)


def test_nulls_repeats_and_other_columns(spark):
    big = "b" * 2000
    rows = [(None, None, big, 1), (None, "u", None, 2), (5, "u", big, 3), (5, "u", big, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, bytes int")
    got = warc.archive_pages(spark, df).collect()
    assert len(got) == 4
    assert all(r.record_type == "response" for r in got)
    assert sorted(r.payload_bytes for r in got) == [0, 2000, 2000, 2000]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(spark, df).count() == 0


def test_damaged_archives_are_reported(spark):
    df = spark.createDataFrame([(1, "u", "x" * 50), (2, "u", "y" * 50)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archive(df, new_folder(spark, "damaged"))
    text = "".join(sorted(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    cut = new_folder(spark, "cut")
    spark.createDataFrame([(text.replace("y" * 50, "y" * 20),)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(cut)
    with pytest.raises(ValueError, match="end early"):
        warc.read_archive(spark, cut)
    assert sorted(r.page_id for r in warc.read_archive(spark, cut, strict=False).collect()) == [1, 2]


def test_header_names_in_any_case_and_measured_sizes(spark):
    def record(i, http, length="Content-Length", kind="WARC-Type"):
        return f"{MAGIC}{kind}: response\r\nwarc-record-id: <urn:x-page:{i}>\r\n{length}: {len(http)}\r\n\r\n{http}"

    body = "HTTP/1.1 200 OK\r\nContent-Length: 999\r\n\r\nhello"
    text = "\r\n\r\n".join([record(1, body), record(2, body, "content-length"), record(3, body, "CONTENT-LENGTH", "warc-type")])
    path = new_folder(spark, "cases")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    got = warc.read_archive(spark, path, strict=False).orderBy("page_id").collect()
    assert [(r.page_id, r.payload_bytes) for r in got] == [(1, 5), (2, 5), (3, 5)]
