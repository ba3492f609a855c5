"""Web archives: writing pages as WARC records, and reading them back by boundary-chain verification.

Writing: pages of equal payload share one stored copy; the others become revisit records. Records are
plain lines of Spark's text writer whose line separator is the end of a record, so files go to any
store Spark writes to, by its commit protocol.

Reading: files are cut into blocks like any text, with the record magic as separator, and every chunk
after a magic is a candidate record. Whether it is one cannot be told inside a block, as payloads may
hold the magic too. So tasks emit for each candidate where its successor must begin, by its stated
length, and follow these pointers as far as their block goes. Pointer jumping from each file's start
over the few places where chains enter another block then finds the entries that are real, and only
candidates on the chains from real entries are records. A payload that holds the magic lies in several
chunks; these are fetched by a second read, of those records alone.

Null html is an empty payload; a null url is left out; pages without an id are stored and come back
without one, never as a revisit. Pages that repeat an id and payload are all responses. A table
without pages gives an archive without records. Payloads must be valid UTF-8.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from featspan.llm.storage import materialise, new_folder

#: Fixed values of the format.
MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def write_archive(pages: DataFrame, path: str, least: int = 1000, date: str = "2000-01-01T00:00:00Z") -> str:
    """Write a record per page to ``path``; equal payloads of ``least`` bytes or more are stored once."""
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    given = given.withColumns({"bytes": F.octet_length("html").cast("long"), "sha1": F.sha1(F.col("html").cast("binary"))})
    stored = given.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"), F.count("page_id").alias("n"))
    # a written table, so that Spark knows its size: small ones are sent to the tasks, others joined by shuffle
    stored = materialise(stored.where("n > 1").select("sha1", "bytes", "first"), "stored-once")
    joined = given.join(stored, ["sha1", "bytes"], "left")
    again = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
        F.when(again, F.lit("")).otherwise(F.col("html")),
    )
    own = F.coalesce(F.concat(F.lit(f"WARC-Record-ID: <{_ID}"), F.col("page_id").cast("string"), F.lit(">\r\n")), F.lit("WARC-Record-ID: <urn:x-page-without-id>\r\n"))
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("\r\n")), F.lit(""))
    revisit = F.concat(
        F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <{_ID}"), F.col("first").cast("string"), F.lit(">\r\n")
    )
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(again, F.lit("revisit\r\n")).otherwise(F.lit("response\r\n")),
        own,
        F.lit(f"WARC-Date: {date}\r\n"),
        uri,
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.lit("\r\n"),
        F.when(again, revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("http").cast("string"),
        F.lit(END),
        F.col("http"),
    )
    joined.withColumn("http", http).select(record.alias("value")).write.option("lineSep", END).text(path)
    return path


_HEADER = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
_CANDIDATE = (
    "file string, block long, at long, next long, leaves long, whole boolean, body long, page_id long, record_type string, "
    "refers_to long, stated_sha1 string, payload_bytes long, payload_sha1 string, chunk_bytes long, file_bytes long"
)
_NAMES = [c.split()[0] for c in _CANDIDATE.split(", ")]


def _number(field: bytes | None) -> int | None:
    found = re.search(rb"urn:x-page:(-?\d+)>", field or b"")
    return int(found[1]) if found else None


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, in file order within a block."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start", "file_size")]
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), *meta)


def _parse(chunk: bytes, at: int) -> dict | None:
    """The record a chunk starts, if its header is well formed; offsets count from the block's first chunk."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {name.lower(): value.rstrip() for name, value in reversed(_HEADER.findall(chunk[: end + 2]))}  # the first of a name counts
    if b"warc-type" not in head or not head.get(b"content-length", b"").isdigit():
        return None
    length, kind = int(head[b"content-length"]), head[b"warc-type"].decode("latin-1")
    out = {
        "at": at - len(MAGIC),
        "next": at + end + 4 + length + len(END),
        "body": at + end + 4,
        "whole": len(chunk) >= end + 4 + length,
        "page_id": _number(head.get(b"warc-record-id")),
        "record_type": kind,
        "refers_to": _number(head.get(b"warc-refers-to")),
        "stated_sha1": head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1"),
    }
    return out | (_payload(chunk[end + 4 : end + 4 + length], kind) if out["whole"] else {})


def _payload(body: bytes, kind: str) -> dict:
    """Size and digest of the payload of an HTTP response, as it is; a revisit holds none, its header states the size."""
    end = body.find(b"\r\n\r\n")
    stated = re.search(rb"^Content-Length:[ \t]*(\d+)[ \t]*\r?$", body[: end + 2], re.MULTILINE | re.IGNORECASE) if end >= 0 else None
    own = body[end + 4 :] if end >= 0 else body
    size = int(stated[1]) if stated and kind == "revisit" else len(own)
    return {"payload_bytes": size, "payload_sha1": hashlib.sha1(own).hexdigest()}


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per candidate record with its successor and the place where its chain leaves the block, and
    a row per block with the bytes of its chunks (``at`` null). Offsets count from the block's first chunk.
    """

    def finish(key: tuple, found: list[dict], size: int, file_size: int) -> pa.RecordBatch:
        leaves: dict[int, int] = {}
        for c in reversed(found):
            leaves[c["at"]] = c["leaves"] = leaves.get(c["next"], c["next"])
        rows = [*found, {"chunk_bytes": size, "file_bytes": file_size}]
        file, block = key
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        arrays = [
            pa.array([r.get(n, file if n == "file" else block if n == "block" else None) for r in rows], kinds[c.split()[1]])
            for n, c in zip(_NAMES, _CANDIDATE.split(", "), strict=True)
        ]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, at, size = None, [], 0, 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                chunk, file, block, file_size = row
                if (file, block) != key:
                    if key is not None:
                        yield finish(key, found, at, size)
                    key, found, at, size = (file, block), [], 0, file_size
                    first = block == 0  # what stands before a file's first magic is no record
                else:
                    first = False
                record = None if first else _parse(chunk, at)
                if record:
                    found.append(record)
                at += len(chunk) + len(MAGIC)
        if key is not None:
            yield finish(key, found, at, size)

    return _chunks(spark, path).mapInArrow(run, _CANDIDATE)


def _jump(found: DataFrame) -> DataFrame:
    """(file, at) of the real candidates by which chains from the files' starts enter a block.

    Doubling: every round the reached places follow their pointers, and pointers follow each other,
    so the rounds grow with the logarithm of the blocks of a file.
    """
    ends = found.select("file", F.col("leaves").alias("at")).distinct()
    starts = found.where("at = 0").select("file", "at").distinct()
    jumps = materialise(found.join(ends.union(starts).distinct(), ["file", "at"], "left_semi").select("file", "at", F.col("leaves").alias("to")).distinct(), "jumps")
    reached = materialise(starts, "reached")
    n = reached.count()
    while True:
        onward = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        real = onward.join(jumps, ["file", "at"], "left_semi")
        reached = materialise(reached.unionByName(real).distinct(), "reached")
        now = reached.count()
        if now == n:
            return reached
        n = now
        after = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = materialise(jumps.join(after, ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")), "jumps")


def _on_chain(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, at) of the candidates on a chain from a real entry; a group is one block of one file."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        following = dict(zip(rows.column("at").to_pylist(), rows.column("next").to_pylist(), strict=True))
        real: set[int] = set()
        for at, entry in zip(rows.column("at").to_pylist(), rows.column("entry").to_pylist(), strict=True):
            while entry and at in following and at not in real:
                real.add(at)
                at = following[at]
        return pa.table({"file": pa.array([key[0].as_py()] * len(real), pa.string()), "at": pa.array(sorted(real), pa.int64())})

    marked = found.select("file", "block", "at", "next").join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left")
    return marked.select("file", "block", "at", "next", "entry").groupBy("file", "block").applyInArrow(run, "file string, at long")


def _split_payloads(spark: SparkSession, path: str, broken: DataFrame, blocks: DataFrame) -> DataFrame:
    """payload_bytes and payload_sha1 of records whose payload holds the magic, by (file, at)."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            places = []
            for size, file, block in zip(pa.compute.binary_length(batch.column(0)).to_pylist(), *(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
                if (file, block) != key:
                    key, at = (file, block), 0
                places.append(at)
                at += size + len(MAGIC)
            columns = [*batch.columns[:3], pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "file", "block", "place"])

    def join_up(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        whole = MAGIC.encode().join(rows.column("value").to_pylist())
        first, body, end = rows.column("place")[0].as_py(), rows.column("body")[0].as_py(), rows.column("next")[0].as_py() - len(END)
        made = _payload(whole[body - first : end - first], "response")
        return pa.table({"file": [key[0].as_py()], "at": [key[1].as_py()], **{k: [v] for k, v in made.items()}})

    spans = broken.join(blocks, "file").where("base < next AND base + chunk_bytes > at")
    spans = materialise(spans.select("file", "block", "base", "at", "body", "next"), "split-payloads")
    pieces = _chunks(spark, path).mapInArrow(placed, "value binary, file string, block long, place long").join(spans, ["file", "block"])
    pieces = pieces.withColumn("place", F.col("place") + F.col("base")).where("place > at AND place < next")
    pieces = pieces.select("file", "at", "value", "place", "body", "next")
    return pieces.groupBy("file", "at").applyInArrow(join_up, "file string, at long, payload_bytes long, payload_sha1 string")


def read_archive(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of all archive files below ``path``.

    ``payload_bytes`` and ``payload_sha1`` are measured on stored payloads, stated for revisits. With
    ``strict`` a file whose chain does not end at its last byte, or a payload that differs from its
    digest, raises an error; without, what the chain reaches is returned.
    """
    raw = materialise(candidates(spark, path), "candidates")
    # bases of blocks: a window over the blocks of one file, which its size bounds
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = raw.where("at IS NULL").withColumn("base", F.coalesce(F.sum("chunk_bytes").over(before), F.lit(0)))
    blocks = materialise(blocks.select("file", "block", "base", "chunk_bytes", "file_bytes"), "blocks")
    moved = {c: F.col(c) + F.col("base") for c in ("at", "next", "leaves", "body")}
    found = raw.where("at IS NOT NULL").drop("chunk_bytes", "file_bytes").join(blocks.select("file", "block", "base"), ["file", "block"])
    found = materialise(found.withColumns(moved).drop("base"), "placed")
    real = _on_chain(found, _jump(found))
    records = materialise(found.join(real, ["file", "at"], "left_semi"), "records")
    if strict:
        ends = records.groupBy("file").agg(F.max("next").alias("end"))
        sizes = blocks.groupBy("file").agg(F.max("file_bytes").alias("size"))
        cut = sizes.join(ends, "file", "left").where("coalesce(end, 0) <> size").limit(3).collect()
        if cut:
            raise ValueError(f"record chains end early in {[r['file'] for r in cut]}")
    broken = records.where("NOT whole").select("file", "at", "body", "next")
    if broken.limit(1).count():
        mended = _split_payloads(spark, path, broken, blocks).select("file", "at", F.col("payload_bytes").alias("pb"), F.col("payload_sha1").alias("ps"))
        records = records.join(mended, ["file", "at"], "left")
        records = records.withColumns({"payload_bytes": F.coalesce("pb", "payload_bytes"), "payload_sha1": F.coalesce("ps", "payload_sha1")}).drop("pb", "ps")
    if strict and records.where("record_type <> 'revisit' AND payload_sha1 <> stated_sha1").limit(1).count():
        raise ValueError("a payload differs from its digest")
    sha1 = F.when(F.col("record_type") == "revisit", F.col("stated_sha1")).otherwise(F.col("payload_sha1"))
    return records.withColumn("payload_sha1", sha1).drop("block", "leaves", "whole", "stated_sha1")


def archive_pages(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write pages to a new archive in the shared folder and read it back."""
    records = read_archive(spark, write_archive(pages, new_folder(spark, "archive"), least))
    return records.select(
        "page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to"
    )
