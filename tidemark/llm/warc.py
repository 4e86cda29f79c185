"""WARC archives: written from pages, read back by verified chains of record boundaries.

Writing: Spark's text sink writes a record to a line whose separator is the end of a WARC
record, so archives are committed like any table and live in any store that Spark knows. A
payload is stored once; other records of it are revisits.

Reading: the text source cuts the files at the magic of a record, which a payload may hold
as well. Tasks emit for each candidate record the offset of its successor, and contract
the chains within a segment (an Arrow batch of a split): to each candidate the offset at
which its chain leaves the segment, and its place in the forest of successors, numbered so
that those that lead to a record are an interval. Pointer jumping from the start of each file over the exits then
gives the one record at which the file's chain enters each segment; candidates on its way are
records, all others are bytes of a payload.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, meet, scratch, settle

VERSION = "WARC/1.1"
# Fixed values of the formats: line and record ends, the base32 alphabet, names of header fields.
CRLF, END = "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "uri": "WARC-Target-URI", "declared_digest": "WARC-Payload-Digest"}
#: Records of a file at most.
FILE_RECORDS = 20_000
#: Repeated payloads (about 100 bytes each) that are broadcast at most; more meet the pages by a shuffle.
BROADCAST_PAYLOADS = 200_000
#: Bytes of a file in one bucket when parts of a payload look for their record.
BUCKET = 2**20
PIECE = ("file string, block bigint, segment bigint, rel bigint, size bigint, next bigint, leaves bigint, low bigint, high bigint, record_type string, record_id string, "
         "refers_to string, uri string, declared_digest string, head bigint, block_bytes bigint, http boolean, payload_bytes bigint, payload_digest binary, raw binary")


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex digits: 20 bits, that is five digits, become four letters."""
    def letters(i: int) -> Column:
        bits = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.concat(*(letters(i) for i in range(8)))


def _repeated(marked: DataFrame) -> DataFrame:
    """``marked`` (``sha``, ``least``: the row has enough bytes, ``page_id``) with ``original``: the largest page_id of a payload that comes more than once."""
    facts = settle(marked.where("least").groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    if facts.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS:
        return marked.join(F.broadcast(facts.drop("n")), "sha", "left")
    return meet(marked, facts, "sha", "n")


def write(pages: DataFrame, path: str, at_least: int = 0, compression: str | None = "gzip", file_records: int = FILE_RECORDS, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record of each row (page_id, url, html) to archives below ``path``.

    Of pages of the same html, ``at_least`` bytes long, those of the largest page_id (all of them, if
    the row is repeated) become responses, the others revisits that refer to it. A null html is
    empty; a null page_id counts as smaller than any and is written as such; a null url is left out; control
    characters in it are escaped. Uncompressed archives are read in splits, compressed ones whole, so
    a file holds at most ``file_records`` records. No rows: no records. Other columns are ignored.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(html, 256).alias("sha"), (F.octet_length(html) >= at_least).alias("least"))
    rows = _repeated(rows).withColumn("revisit", F.col("least") & F.coalesce(F.col("page_id") < F.col("original"), F.col("page_id").isNull() & F.col("original").isNotNull()))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.octet_length("html").cast("string")), F.lit(CRLF))
    body = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    revisit = F.concat(line("WARC-Refers-To", urn(F.col("original"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    record = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", uri)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("html")))),
        F.when(F.col("revisit"), revisit).otherwise(F.lit("")), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(body).cast("string")), F.lit(CRLF), body)
    out = gathered(rows.select(record.alias("value"))).write.option("lineSep", END).option("maxRecordsPerFile", file_records)
    (out.option("compression", compression) if compression else out).text(path)


def _header(piece: bytes, name: str) -> str | None:
    got = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", piece)
    return got[1].decode("utf-8", "replace").rstrip() if got else None


def _parsed(piece: bytes) -> dict | None:
    """What the header of a candidate says, or None where ``piece`` doesn't begin with one."""
    head = piece.find(END.encode())
    length = _header(piece[: head + 2], "Content-Length") if head >= 0 else None
    if length is None or not re.fullmatch(r"[0-9]{1,15}", length):
        return None
    out: dict = {key: _header(piece[:head], name) for key, name in FIELDS.items()}
    if out["record_type"] is None or out["record_id"] is None:
        return None
    return out | {"head": head + 4, "block_bytes": int(length), "http": (_header(piece[:head], "Content-Type") or "").startswith("application/http")}


def _forest(starts: list[int], nexts: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(offset at which the chain of each candidate leaves, low, high): a candidate leads to c exactly where low[c] <= its own low < high[c]."""
    n = len(starts)
    at = np.searchsorted(starts, nexts)
    parent = [int(p) if p < n and starts[p] == nexts[i] else -1 for i, p in enumerate(at)]
    below, leaves, low, free, roots = [1] * n, list(nexts), [0] * n, [0] * n, 0
    for i in range(n):  # a successor comes later
        if parent[i] >= 0:
            below[parent[i]] += below[i]
    for i in reversed(range(n)):
        p = parent[i]
        low[i] = roots if p < 0 else free[p]
        roots += below[i] if p < 0 else 0
        if p >= 0:
            free[p] += below[i]
            leaves[i] = leaves[p]
        free[i] = low[i] + 1
    return leaves, low, [a + b for a, b in zip(low, below, strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, bytes up to the next magic) in the order of a split become rows of ``PIECE``; offsets count from the split's first piece."""
    import hashlib

    magic, names = f"{VERSION}{CRLF}".encode(), [c.split()[0] for c in PIECE.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PIECE.split(", ")])
    split, offset, segment = None, 0, 0
    for batch in batches:
        rows: list[dict] = []
        for file, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != split:
                split, offset, segment = (file, block), 0, 0
            row = dict.fromkeys(names) | {"file": file, "block": block, "segment": segment, "rel": offset, "size": len(piece) + len(magic), "raw": piece}
            if said := _parsed(piece):
                row |= said
                # ``rel`` is where the piece's bytes begin; the record began with the magic before them.
                row["next"] = offset + said["head"] + said["block_bytes"] + len(END) + len(magic)
                own = piece[said["head"] : said["head"] + said["block_bytes"]]
                if len(own) == said["block_bytes"]:
                    if said["http"]:
                        own = own[own.find(END.encode()) + 4 :] if END.encode() in own else b""
                    row |= {"payload_bytes": len(own), "payload_digest": hashlib.sha1(own).digest()}
            rows.append(row)
            offset += len(piece) + len(magic)
        for key in dict.fromkeys((r["file"], r["block"]) for r in rows):
            own = [r for r in rows if (r["file"], r["block"]) == key and r["next"] is not None]
            for r, leaves, low, high in zip(own, *_forest([r["rel"] for r in own], [r["next"] for r in own]), strict=True):
                r |= {"leaves": leaves, "low": low, "high": high}
        segment += 1
        yield pa.RecordBatch.from_pylist(rows, schema)


def _nodes(pieces: DataFrame) -> DataFrame:
    """Candidates with ``start``, the offset in the file at which their bytes begin (behind the magic), and ``to``, that at which the chain leaves the segment."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.groupBy("file", "block").agg(F.sum("size").alias("bytes"))  # a row of each split
    base = splits.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    return pieces.drop("raw").join(base, ["file", "block"]).withColumn("start", F.col("base") + F.col("rel")).withColumn("to", F.col("base") + F.col("leaves")).drop("base")


def _chain(nodes: DataFrame) -> DataFrame:
    """file, block, segment, entry: ``low`` of the record at which the chain of the file enters the segment, by pointer jumping from the file's start."""
    nodes = nodes.where("next IS NOT NULL").select("file", "block", "segment", "start", "to", "low")
    first = F.col("start") == len(VERSION + CRLF)
    entered = nodes.where(~first).join(nodes.select("file", F.col("to").alias("start")).distinct(), ["file", "start"], "left_semi")
    pointers = settle(nodes.where(first).unionByName(entered))  # few: candidates at which some chain enters a segment
    jump, reached = pointers.select("file", F.col("start").alias("at"), "to"), pointers.where(first).select("file", F.col("start").alias("at"))
    while True:  # round k finds what lies 2^k to 2^(k+1) segments from the start, and doubles the pointers
        new = settle(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(pointers.select("file", F.col("start").alias("at")), ["file", "at"], "left_semi"))
        if not new.limit(1).count():
            break
        reached = settle(reached.unionByName(new))
        jump = settle(jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "at", F.col("far").alias("to")))
    return settle(pointers.join(reached.withColumnRenamed("at", "start"), ["file", "start"]).select("file", "block", "segment", F.col("low").alias("entry")))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, start, head, block_bytes, http, bytes of all pieces) become (file, start, payload); a payload that ends too early is null."""
    for batch in batches:
        out = []
        for head, size, http, whole in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            own = whole[head : head + size]
            out.append(None if len(own) < size else own.partition(END.encode())[2] if http else own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["file", "start", "payload"])


def _long_payloads(pieces: DataFrame, placed: DataFrame, records: DataFrame) -> DataFrame | None:
    """file, start, payload of the records whose payload holds the magic, or None where there is none.

    Their pieces find them by buckets of the file, each of which holds few bytes, so that no
    file is one window; a record stands in every bucket that it reaches into.
    """
    cut = settle(records.where("next > rel + size").select("file", "block", "rel", "start", (F.col("start") + F.col("next") - F.col("rel")).alias("end"), "head", "block_bytes", "http"))
    if not cut.limit(1).count():
        return None
    spans = cut.select("file", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))).alias("bucket"), "start", "end")
    owners = spans.select("file", "bucket", F.greatest("start", F.col("bucket") * BUCKET - 1).alias("at"), F.struct("start", "end").alias("owner"), F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("bigint").alias("rel"))
    others = placed.join(records.select("file", "block", "rel"), ["file", "block", "rel"], "left_anti").select("file", F.floor(F.col("start") / BUCKET).alias("bucket"), F.col("start").alias("at"), F.lit(None).cast("struct<start: bigint, end: bigint>").alias("owner"), "block", "rel")
    order = Window.partitionBy("file", "bucket").orderBy("at", F.col("owner").isNull())
    found = owners.unionByName(others).withColumn("owner", F.last("owner", ignorenulls=True).over(order)).where((F.col("at") < F.col("owner.end")) & F.col("rel").isNotNull())
    parts = found.select("file", "block", "rel", "at", F.col("owner.start").alias("start")).unionByName(cut.select("file", "block", "rel", F.col("start").alias("at"), "start"))
    raw = parts.join(pieces.select("file", "block", "rel", F.col("raw").cast("string").alias("raw")), ["file", "block", "rel"])
    joined = raw.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("parts"))  # the payload itself, a value anyway
    whole = joined.select("file", "start", F.array_join("parts.raw", VERSION + CRLF).cast("binary").alias("whole"))
    return cut.join(whole, ["file", "start"]).select("file", "start", "head", "block_bytes", "http", "whole").mapInArrow(_assembled, "file string, start bigint, payload binary")


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives below ``path``: file, offset, record_type, record_id, refers_to, uri, declared_digest, payload_bytes, payload_digest and, if asked for, payload.

    A record counts if the chain of boundaries from the start of its file reaches it, so a
    whole record within a payload doesn't. A chain ends where no record follows; a payload
    that the file's end cuts off has null bytes and digest. An HTTP head is no part of the payload.
    Files of another beginning and no files: no records.
    """
    at = f"{scratch(spark)}/{uuid.uuid4().hex}"
    lines = spark.read.schema("value string").option("lineSep", VERSION + CRLF).text(path)
    cut = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    cut.mapInArrow(_pieces, PIECE).write.option("compression", "zstd").parquet(at)
    pieces = spark.read.schema(PIECE).parquet(at)
    placed = _nodes(pieces)
    records = placed.join(_chain(placed), ["file", "block", "segment"]).where("low <= entry AND entry < high")
    long = _long_payloads(pieces, placed, records)
    out = records
    if long is not None:
        long = settle(long)
        out = out.join(long.withColumn("is_long", F.lit(True)), ["file", "start"], "left")
        for name, value in (("payload_bytes", F.octet_length("payload").cast("bigint")), ("payload_digest", F.unhex(F.sha1("payload")))):
            out = out.withColumn(name, F.when(F.col("is_long"), value).otherwise(F.col(name)))
    kept = ["file", (F.col("start") - len(VERSION + CRLF)).alias("offset"), *FIELDS, "payload_bytes", base32(F.lower(F.hex("payload_digest"))).alias("payload_digest")]
    if payload:
        own = pieces.select("file", "block", "rel", F.expr("substring(raw, head + 1, block_bytes)").alias("_block"))
        out = out.join(own, ["file", "block", "rel"])
        short = F.when(F.col("payload_digest").isNotNull(), F.expr("substring(_block, length(_block) - payload_bytes + 1, payload_bytes)"))
        kept.append((F.when(F.col("is_long"), F.col("payload")).otherwise(short) if long is not None else short).alias("payload"))
    return out.select(*kept)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a revisit has the bytes and the digest of the response that it refers to.

    One whose response isn't there has null bytes and its declared digest.
    """
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS bigint)")
    revisits = records.where("record_type = 'revisit'").withColumn("key", F.concat_ws(" ", "refers_to", "declared_digest"))
    responses = records.where("record_type = 'response'")
    facts = responses.select(F.concat_ws(" ", "record_id", F.concat(F.lit("sha1:"), "payload_digest")).alias("key"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).groupBy("key").agg(F.max("_bytes").alias("_bytes"), F.max("_digest").alias("_digest"))
    counted = settle(facts.join(revisits.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"))
    known = meet(revisits, counted, "key", "n")
    names = [page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type"]
    return (responses.select(*names, F.lit(None).cast("bigint").alias("refers_to"))
            .unionByName(known.withColumn("payload_bytes", F.col("_bytes")).withColumn("payload_digest", F.coalesce("_digest", F.expr("substring(declared_digest, 6)"))).select(*names, page("refers_to").alias("refers_to"))))


def round_trip(pages: DataFrame, at_least: int = 0, compression: str | None = "gzip") -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and says what reading them back gives: one row a page, as in ``resolve``.

    Nulls, repeated rows and empty tables as in ``write``.
    """
    path = f"{scratch(pages.sparkSession)}/{uuid.uuid4().hex}"
    write(pages, path, at_least, compression)
    return resolve(settle(read(pages.sparkSession, path)))


#: The same rows as DuckDB SQL.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM original THEN NULL ELSE original END AS refers_to
FROM d"""
