"""SimHash near-duplicates linked through BK-trees.

1. Fingerprints: words, 4-word shingles, XXH64, bit majority (numpy, Arrow batches).
2. Shard trees: two fingerprints within radius r agree on at least one (or, with more
   blocks, several) of their bit blocks, so each fingerprint joins the shard of every
   block combination and all links lie inside some shard. A shard has a BK-tree (children
   keyed by integer Hamming distance to the parent), and each member follows only the
   edges within the radius. All fingerprints together are unbounded and may not pass through
   the driver, so small shards, which are nearly all, go to a task each.
3. The trees of shards of more than ``SHARD_LIMIT`` members are broadcast instead, a bounded
   number of nodes at a time, to the members where they are.
4. Shards emit only edges that join two of their parts (at most members - 1), and
   iterated min-label propagation with hooking turns edges into components.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, gathered, meet, scratch, settle

#: Members above which a shard is large; nodes of large shards' trees that are broadcast at once (20 bytes each).
BITS, SHARD_LIMIT, TREE_NODES = 64, 2048, 65_536
#: Keys (16 bytes each) of large shards that are broadcast at most.
BROADCAST_SHARDS = 100_000
#: Keys (16 bytes each) of documents that go or are repeated, broadcast at most.
BROADCAST_DROPS = 500_000
#: Mean members of a shard up to which its key is long enough.
MEAN_SHARD = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if shingle == 4 and n > 1:
        h = [digest(b" ".join(w), seed) for w in zip(words, words[1:], words[2:], words[3:], strict=False)]
    else:
        h = [digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)]
    counts = np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, 8192):
        part = np.array(h[a : a + 8192], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array(np.array([fingerprint(t.as_py()) for t in b], dtype=np.uint64).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed long (the same 64 bits); null text counts as empty."""
    return by_text(_fingerprints, "long")(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BKTree:
    """Children keyed by Hamming distance to the parent; ``near`` follows only edges within the radius."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def near(self, value: int, radius: int) -> list[int]:
        if self.root is None:
            return []
        found, todo = [], [self.root]
        while todo:
            own, children = todo.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            if children:
                for edge, child in children.items():
                    if -radius <= edge - d <= radius:
                        todo.append(child)
        return found


class Parts:
    """Union-find over the members of one shard."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shard_edges(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that span the links within one shard: each member asks the tree of those before it."""
    tree, parts, out = BKTree(), Parts(), []
    for v in members:
        out += [(v, w) for w in tree.near(v, radius) if w != v and parts.join(v, w)]
        tree.add(v)
    return out


def schemes(radius: int) -> list[tuple[int, int]]:
    """(blocks, blocks that must agree) by rising key length; all are exact, for blocks - agree = radius."""
    return [(radius + 1 + more, 1 + more) for more in range(4)]


def _keys(fp: Column, blocks: int, agree: int) -> Column:
    """One shard key for each choice of ``agree`` blocks: a hash of the choice and its bits."""
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for i, pick in enumerate(combinations(range(blocks), agree)):
        mask = sum(masks[p] for p in pick)
        mask = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(i).alias("c"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("v")))
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int = 4, limit: int = SHARD_LIMIT) -> DataFrame:
    """a, b (long): edges that connect exactly what links within ``radius`` connect, over distinct ``fp``."""
    n = fps.count()
    plan = schemes(radius)
    blocks, agree = next((p for p in plan if n / 2 ** (BITS * p[1] / p[0]) <= MEAN_SHARD), plan[-1])
    rows = fps.select("fp", F.explode(_keys(F.col("fp"), blocks, agree)).alias("k")).select("k.c", "k.v", "fp")
    sizes = rows.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    hot = settle(sizes.select("c", "v"), n)
    if not hot.limit(1).count():
        return _small_shards(rows, radius).distinct()
    sent = F.broadcast(hot) if hot.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS else hot
    small = _small_shards(rows.join(sent, ["c", "v"], "left_anti"), radius)
    return small.unionByName(_large_shards(settle(rows.join(sent, ["c", "v"], "left_semi")), radius)).distinct()


def _small_shards(rows: DataFrame, radius: int) -> DataFrame:
    """a, b: each shard (c, v) goes to one task, which builds its tree."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []
        for b in batches:
            c, v, f = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy().view(np.uint64).tolist()
            for row in zip(c, v, f, strict=True):
                if row[:2] != key:
                    out += _shard_edges(members, radius) if len(members) > 1 else []
                    key, members = row[:2], []
                members.append(row[2])
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out + (_shard_edges(members, radius) if len(members) > 1 else []))

    spread = rows.repartition(F.col("c"), F.col("v")).sortWithinPartitions("c", "v", "fp")
    return spread.mapInArrow(search, "a long, b long")


def _large_shards(rows: DataFrame, radius: int) -> DataFrame:
    """a, b: the trees of large shards are broadcast, ``TREE_NODES`` nodes at a time, to the members where they are.

    The members themselves are not shuffled and not copied; each block of trees is one pass
    over them, and its edges (in each task at most members + nodes) are written.
    """
    spark = rows.sparkSession
    blocks = -(-rows.count() // TREE_NODES)
    at = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("fp"), F.lit(blocks)) == k).toArrow()  # near TREE_NODES rows of 20 bytes
        sent = spark.sparkContext.broadcast(tuple(own[c].to_numpy() for c in ("c", "v", "fp")))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            nodes: dict[tuple[int, int], list[int]] = {}
            for c, v, f in zip(*(x.tolist() for x in sent.value[:2]), sent.value[2].view(np.uint64).tolist(), strict=True):
                nodes.setdefault((c, v), []).append(f)
            trees: dict[tuple[int, int], tuple[BKTree, Parts]] = {}
            for b in batches:
                out = []
                for c, v, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy().view(np.uint64).tolist(), strict=True):
                    if (c, v) not in trees:
                        tree = BKTree()
                        for x in nodes.get((c, v), ()):
                            tree.add(x)
                        trees[c, v] = tree, Parts()
                    tree, parts = trees[c, v]
                    out += [(f, w) for w in tree.near(f, radius) if w != f and parts.join(f, w)]
                yield _edges(out)

        rows.mapInArrow(probe, "a long, b long").write.parquet(f"{at}/k={k}")
        sent.unpersist()
    return spark.read.schema("a long, b long").parquet(at).select("a", "b")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(map(_signed, a), pa.int64()), pa.array(map(_signed, b), pa.int64())], names=["a", "b"])


def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """fp, root: for every end of the ``at_most`` edges (a, b) the smallest fp of its component.

    Alternating large-star and small-star; each round is written to the shared folder.
    The centres of large stars meet their edges without a shuffle (``meet``).
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), at_most)
    before, n = None, edges.count()
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = meet(both, low, "a", "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (meet(large, low, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .unionByName(low.select("a", F.col("m").alias("b")))).distinct()
        edges = settle(small, 2 * n)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before, n = tuple(state), state[0]
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("fp"), "root").unionByName(
        edges.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def groups(by_fp: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """``by_fp`` (one row of each fingerprint ``fp``, at most ``n``) with root: the smallest fp that is reachable, its own included."""
    roots = components(near_links(by_fp.select("fp"), radius), 10 * n)
    return by_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per document.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows
    stay, each with its component. Null doc_ids are not chosen as component_id unless
    the whole component has none (then it is null). An empty table gives no rows;
    other columns are ignored.
    """
    marked = settle(gathered(docs).select("doc_id", fingerprint_of(F.col("text")).alias("fp")))
    n = marked.count()
    by_fp = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), n)
    linked = settle(groups(by_fp, n, radius), n)
    # One row of each fingerprint; a hot component is aggregated by task before its rows meet.
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    found = meet(linked, ids, "root", "_n").select("fp", "n", "component_id")
    return meet(marked, found, "fp", "n").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs``, all columns, with one document of each component: that with the smallest doc_id (nulls last, ties by a hash of the text).

    Of repeated rows (one doc_id, one text) one stays. Null and empty texts are linked with
    each other. An empty table gives no rows; no column name clashes. Texts are read twice
    and never shuffled, but for repeated rows and where more than ``BROADCAST_DROPS``
    documents go: what is shuffled is ids, text hashes and fingerprints.
    """
    docs = gathered(docs)
    marked = settle(docs.select(F.col("doc_id").alias("i"), _text_key(F.col("text")).alias("t"), fingerprint_of(F.col("text")).alias("fp")))
    n = marked.count()
    keys = settle(marked.groupBy("fp", "i", "t").agg(F.count(F.lit(1)).alias("c")), n)
    first = F.min(F.struct(F.col("i").isNull().alias("no"), "i", "t"))
    linked = settle(groups(settle(keys.groupBy("fp").agg(first.alias("least"), F.count(F.lit(1)).alias("n")), n), n, radius), n)
    keepers = linked.groupBy("root").agg(F.min("least").alias("k"), F.count(F.lit(1)).alias("_n"))
    found = meet(linked, keepers, "root", "_n").select("fp", "n", "k")
    judged = settle(meet(keys, found, "fp", "n").select("i", "t", "c", (F.col("i").eqNullSafe(F.col("k.i")) & (F.col("t") == F.col("k.t"))).alias("kept")), n)
    drops, repeats = judged.where("not kept").select("i", "t"), judged.where("kept and c > 1").select("i", "t")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d"))  # no name can clash
    same = F.col("_d.doc_id").eqNullSafe(F.col("i")) & (_text_key(F.col("_d.text")) == F.col("t"))
    kept = rows.join(_few(drops), same, "left_anti")
    repeats = _few(repeats)
    if not repeats.limit(1).count():
        return kept.select("_d.*")
    again = kept.join(repeats, same).groupBy("i", "t").agg(F.first("_d").alias("_d"))
    return kept.join(repeats, same, "left_anti").select("_d.*").unionByName(again.select("_d.*"))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _few(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if there are at most ``BROADCAST_DROPS``; more meet the documents by a shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_DROPS + 1).count() <= BROADCAST_DROPS else keys
