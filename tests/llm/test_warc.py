"""Archives: round trips, chains of boundaries, records within payloads."""

import base64
import gzip
import hashlib
import random

import duckdb
import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def inner(text="hello", page=9):
    """A whole record, as a payload may hold one."""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(text)}\r\n\r\n{text}\r\n\r\n"


def pages():
    rng = random.Random(2)
    texts = ["", None, "plain", "é日本 " * 40, "WARC/1.1\r\n", inner(), "x" + inner() * 3 + "y", inner(inner()), "WARC/1.1\r\n" * 50, "\r\n\r\nWARC/1.1\r\n\r\n\r\n", "WARC/1.1", "W" + inner(), "z" * 70_000 + inner() + "z" * 70_000]
    rows = [(i, f"http://a/{i} b\r\nX", texts[i % len(texts)]) for i in range(120)]
    rows += [(1000 + i, None, rng.choice(["copy", "", inner("q")]) + ("" if rng.random() < 0.7 else str(i))) for i in range(200)]
    return [(*r, "c") for r in rows] + [(None, None, None, None), (None, None, "lonely", None), (7, "u", "again", None), (7, "u", "again", None), (-3, "u", "again", "c")]


def plain(rows):
    most = {}
    for i, _, h, _ in rows:
        k = h or ""
        most[k] = max([x for x in (most.get(k), i) if x is not None], default=None)
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    return sorted([(i, len((h or "").encode()), sha(h or ""), *(("response", None) if i == most[h or ""] else ("revisit", most[h or ""]))) for i, _, h, _ in rows], key=repr)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


@pytest.mark.parametrize("limit", [10_000_000, 0])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", limit)
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    assert got(warc.round_trip(df)) == plain(pages())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_splits(spark, monkeypatch, tmp_path):
    """Many splits and segments a file: chains by several rounds of pointer jumping, payloads over splits and buckets."""
    monkeypatch.setattr(warc, "BUCKET", 4096)
    rows = [(i, "u", t, "c") for i, t in enumerate((random.Random(i).choice(["a", inner() * 4, "b" * 999, "WARC/1.1\r\n" * 9]) + str(i)) for i in range(900))]
    rows += [(5000, "u", ("k" * 3000 + inner()) * 40, "c")]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), path, compression=None)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        back = warc.read(spark, path, payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.record_id, bytes(r.payload).decode()) for r in back) == sorted((f"<urn:page:{i}>", t) for i, _, t, _ in rows)
    assert all(r.declared_digest == f"sha1:{r.payload_digest}" and r.payload_bytes == len(r.payload) for r in back)


def test_broken_files(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: "
    files = {"cut": inner("one") + head + "999\r\n\r\nshort", "gap": inner("one") + "junk" + inner("lost"), "odd": "junk" + inner(), "empty": "", "binary": None, "members": None}
    for name, text in files.items():
        if text is not None:
            (tmp_path / f"{name}.warc").write_bytes(text.encode())
    (tmp_path / "binary.warc").write_bytes(head.encode() + b"3\r\n\r\n\xff\x00\xfe\r\n\r\n")
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(inner("one").encode()) + gzip.compress(inner("two").encode()))
    back = sorted(((r.file.split("/")[-1].split(".")[0], r.offset, r.payload and bytes(r.payload)) for r in warc.read(spark, str(tmp_path), payload=True).collect()), key=repr)
    assert back == [("binary", 0, b"\xff\x00\xfe"), ("cut", 0, b"one"), ("cut", len(inner("one")), None), ("gap", 0, b"one"), ("members", 0, b"one"), ("members", len(inner("one")), b"two")]


def test_sql_says_the_same(spark, tmp_path):
    rows = [r for r in pages() if r[2] is None or "\x00" not in r[2]]
    at = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(at)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{at}/*.parquet'")
    have = con.execute(warc.ORACLE).fetchall()
    assert sorted(have, key=repr) == plain(rows)
