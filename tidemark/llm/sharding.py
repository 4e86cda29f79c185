"""Sharding by extendible hashing, on DataFrame functions alone.

A row's address is a string of bits: md5 of the key, then md5 of the text, then md5 of a
row number, so that even repeated keys and repeated rows can be told apart. The
directory holds the shards as address prefixes. A bucket that exceeds the byte limit
splits on its next bit; only oversized buckets split. Instead of splitting bit by bit,
one histogram of address cells is rolled up to every depth, and each cell takes its
smallest depth that fits: that is the same directory in one pass. Cells that are
still too large go on, alone, with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, meet, settle

#: Bytes of a shard of the registered query: small enough that the tests' tables split.
LIMIT_BYTES = 2**20
WORD = 60  # bits of 15 hexadecimal digits


def _bits(digest: Column, word: int) -> Column:
    return F.lpad(F.conv(F.substring(digest, 1 + 15 * word, 15), 16, 2), WORD, "0")


def assign(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (address prefix), depth, shard_bytes, shard_docs: one row per document.

    A shard holds at most ``limit_bytes`` of UTF-8 text, unless it is a single larger
    document. Null and empty texts have no bytes; a null doc_id is hashed as ''. Repeated
    keys and rows are split by the later parts of the address. One shard with an empty
    prefix holds everything that fits into one; an empty table has no shards. Other
    columns are ignored.
    """
    key, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = settle(gathered(docs).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), _bits(F.md5(key), 0).alias("a"), F.md5(key).alias("k"),
                              F.md5(text).alias("t"), F.md5(F.monotonically_increasing_id().cast("string")).alias("u")))
    total, n = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    first = min(WORD, max(0, math.ceil(math.log2(total / limit_bytes)) + 3)) if total > limit_bytes else 0
    # Depths at which the histogram is taken, and the address bits known by then.
    parts = [_bits(F.col("k"), 0), _bits(F.col("k"), 1), _bits(F.col("t"), 0), _bits(F.col("t"), 1), _bits(F.col("u"), 0), _bits(F.col("u"), 1)]
    depths = [first, *(d for d in (WORD, 2 * WORD, 2 * WORD + max(first, 12), 3 * WORD, 4 * WORD, 4 * WORD + max(first, 12), 5 * WORD, 6 * WORD) if d > first)]
    out, least = None, 0
    for deep in depths:
        if deep > WORD:
            rows = rows.withColumn("a", F.concat(*parts[: -(-deep // WORD)]))
        rows = rows.withColumn("cell", F.substring("a", 1, deep))
        cells = rows.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(deep)))).withColumn("shard", F.expr("substring(cell, 1, depth)"))
        sizes = levels.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.count(F.lit(1)).alias("_cells"))
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1)
        if deep == depths[-1]:  # no more bits: what is left differs in nothing
            fits = fits | (F.length("shard") == deep)
        # Short prefixes stand for very many cells; they have no hot task to themselves.
        held = meet(levels.select("cell", "depth", "shard"), sizes.withColumn("fits", fits), "shard", "_cells").where("fits")
        leaf = held.groupBy("cell").agg(F.min_by(F.struct("depth", "shard", "shard_bytes", "shard_docs"), "depth").alias("s"))
        placed = settle(meet(rows, leaf.join(cells.select("cell", "n"), "cell"), "cell", "n"), n)  # a repeated key makes a hot cell
        done = placed.where("s is not null").select("doc_id", "n_bytes", "s.shard", "s.depth", "s.shard_bytes", "s.shard_docs")
        out = done if out is None else out.unionByName(done)
        rows, least = placed.where("s is null").select("doc_id", "n_bytes", "a", "k", "t", "u"), deep + 1
        if not rows.limit(1).count():
            break
    return out


def directory(assigned: DataFrame) -> DataFrame:
    """shard, depth, shard_bytes, shard_docs: the directory's buckets, one row each; none for an empty table.

    ``assigned`` is what ``assign`` returns: null ids, repeated rows and rows without text
    count as documents there, so the sums are those of its columns of the same names.
    """
    return assigned.groupBy("shard", "depth").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))


#: The same directory by sums at every depth; enough bits for the sizes it is run at.
ORACLE = f"""
WITH rows_ AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS a
  FROM documents),
levels AS (SELECT r.*, d.depth, substr(r.a, 1, d.depth) AS shard FROM rows_ r, (SELECT unnest(range(0, 17))::INTEGER AS depth) d),
sizes AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM levels GROUP BY ALL)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_docs
FROM levels JOIN sizes USING (depth, shard)
WHERE shard_bytes <= {LIMIT_BYTES} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
