"""Benchmark decontamination by seed hashing, on DataFrame functions alone.

Words are hashed. An item is cut into blocks so short that any aligned window that is
similar enough holds one more block than it has unequal words: at least one block is
then equal as a whole, and its hash is a seed. Runs of the training texts whose hash is
one of the benchmark's are joined to the benchmark's blocks, and around each hit the
words of both sides are compared: an overlap counts if at least ``SIMILARITY`` of an
aligned window of ``WINDOW`` words (of the whole item, if shorter) are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, settle

SIMILARITY, WINDOW = 0.8, 24
#: Items of fewer words are not sought: one or two words that stand in a text are no sign of a leak.
SHORTEST = 3
#: Hashes that one pass over the words of the training texts looks for. For a larger benchmark, the
#: texts are read and cut into words once and their word hashes written; each block then reads those.
BLOCK = 100_000
#: Leaking documents (16 bytes each) whose keys are broadcast at most; more meet the documents by a shuffle.
BROADCAST_LEAKS = 500_000


def words(text: Column) -> Column:
    """Hashes of the lower-case words: runs of letters and digits."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w))


def block_words(n: int, similarity: float = SIMILARITY) -> int:
    """Words of the blocks of an item of ``n`` words.

    A window may hold k unequal words, so it must hold k + 1 whole blocks. An item shorter than
    the window is the window itself; in a longer one, a window may begin inside a block.
    """
    size = min(n, WINDOW)
    k = size - next(m for m in range(size + 1) if m >= similarity * size)
    return max(1, size // (k + 1) if n < WINDOW else (size + 1) // (k + 2))


def _seed(w: Column, at: Column, span: int) -> Column:
    return F.xxhash64(F.lit(span), *(F.get(w, at + o) for o in range(span)))


def _around(w: Column, at: Column) -> Column:
    return F.transform(F.sequence(F.lit(-WINDOW), F.lit(WINDOW - 1)), lambda r: F.get(w, at + r))


def _none(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    kinds = [docs.select("doc_id").schema[0].dataType.simpleString(), benchmark.select("item_id").schema[0].dataType.simpleString()]
    return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, _text long, item_id {kinds[1]}, matched int, compared int")


def item_classes(benchmark: DataFrame) -> DataFrame:
    """item_id, class_item_id: the smallest id of the items of the same words, which stands for them all in ``overlaps``."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w"))
    return items.join(items.groupBy("w").agg(F.min("item_id").alias("class_item_id")), "w").select("item_id", "class_item_id")


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """doc_id, _text (hash of the text), item_id, matched, compared: each text and the benchmark items that it leaks.

    matched of compared words are equal in the best window. Null texts count as empty and
    leak nothing, as do items of fewer than ``shortest`` words. Repeated rows are one; so are
    repeated items of one id (the better overlap counts). Items of the same words are one
    item, that with the smallest id (``item_classes`` has the others). Null item ids take
    part; a null doc_id is kept. Empty tables give an empty result. Other columns are ignored.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= max(1, shortest))
    items = settle(items.groupBy("w").agg(F.min("item_id").alias("item_id")).withColumn("n", F.size("w")), benchmark.count())
    lengths = [r["n"] for r in items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()]  # at most WINDOW values
    spans: dict[int, list[int]] = {}
    for n in sorted(lengths):
        spans.setdefault(block_words(n, similarity), []).append(n)
    seeds = None
    for span, sizes in spans.items():
        own = items.where(F.least("n", F.lit(WINDOW)).isin(sizes))
        part = own.select("item_id", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - span, F.lit(span))).alias("q")).select(
            "item_id", F.lit(span).alias("span"), F.col("n").alias("item_n"), "q", _seed(F.col("w"), F.col("q"), span).alias("h"), _around(F.col("w"), F.col("q")).alias("item_w"))
        seeds = part if seeds is None else seeds.unionByName(part)
    if seeds is None:
        return _none(docs, benchmark)
    seeds = settle(seeds.distinct(), items.agg(F.sum("n")).first()[0])
    n = seeds.select("h").distinct().count()
    blocks, found = max(1, -(-n // block) * (2 if n > block else 1)), None
    texts = gathered(docs).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), words(F.col("text")).alias("w"))
    if blocks > 1:
        texts = settle(texts)
    for b in range(blocks):
        mine = seeds if blocks == 1 else seeds.where(F.pmod(F.col("h"), F.lit(blocks)) == b)
        hashes: dict[int, list[int]] = {}
        for r in mine.select("span", "h").distinct().collect():  # about ``block`` numbers at most
            hashes.setdefault(r["span"], []).append(r["h"])
        if not hashes:
            continue
        parts = []
        for span in sorted(hashes):
            known = ",".join(f"{h}L" if h > -(2**63) else f"({h + 1}L - 1L)" for h in sorted(hashes[span]))
            hash_sql = f"xxhash64({span}, " + ", ".join(f"get(w, i + {o})" for o in range(span)) + ")"
            parts.append(f"transform(filter(if(size(w) >= {span}, sequence(0, size(w) - {span}), cast(array() as array<int>)), i -> {hash_sql} IN ({known})), i -> struct(i AS p, {hash_sql} AS h))")
        hits = texts.select("doc_id", "_text", "w", F.expr(f"concat({', '.join(parts)})").alias("hits"))
        # explode_outer, for a filter on the hits would be pushed below the words and compute them again at every position.
        at = hits.select("doc_id", "_text", F.explode_outer(F.transform("hits", lambda x: F.struct(x["h"].alias("h"), _around(F.col("w"), x["p"]).alias("doc_w")))).alias("x")).select(
            "doc_id", "_text", "x.h", "x.doc_w").where("h is not null")
        # A block has about ``block`` hashes; its rows are sent whole only if few items share them.
        pairs = at.join(F.broadcast(mine.drop("span")) if mine.count() <= 2 * block else mine.drop("span"), "h")
        equal = F.zip_with("doc_w", "item_w", lambda a, c: F.when(c.isNotNull() & a.eqNullSafe(c), 1).otherwise(0))
        size = F.least(F.col("item_n"), F.lit(WINDOW))
        # A window starts at most size - 1 words before the hit, no later than it, and stays inside the item.
        first, last = F.greatest(1 - F.col("size"), -F.col("q")), F.least(F.lit(0), F.col("item_n") - F.col("q") - F.col("size"))
        best = F.array_max(F.transform(F.sequence("first", "last"), lambda s: F.aggregate(F.slice("equal", s + WINDOW + 1, F.col("size")), F.lit(0), lambda x, y: x + y)))
        checked = pairs.select("doc_id", "_text", "item_id", "item_n", "q", equal.alias("equal"), size.alias("size"))
        checked = checked.where(F.aggregate("equal", F.lit(0), lambda x, y: x + y) >= F.lit(similarity) * F.col("size"))
        checked = checked.withColumn("first", first).withColumn("last", last).where("first <= last")
        checked = checked.select("doc_id", "_text", "item_id", F.col("size").alias("compared"), best.alias("matched")).where(F.col("matched") >= F.lit(similarity) * F.col("compared"))
        found = checked if found is None else found.unionByName(checked)
    if found is None:
        return _none(docs, benchmark)
    return found.groupBy("doc_id", "_text", "item_id").agg(F.max(F.struct("matched", "compared")).alias("m")).select("doc_id", "_text", "item_id", "m.matched", "m.compared")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, compared: the pairs of a document and a benchmark item that it leaks (see ``overlaps``)."""
    return overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "compared")).alias("m")).select("doc_id", "item_id", "m.matched", "m.compared")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that leak a benchmark item (see ``overlaps``).

    Null, empty and repeated texts without a leak stay, every row of them; a document leaks by
    its doc_id and text, so rows of one id are judged apart. Empty tables: no documents give
    none, no benchmark keeps all. Columns of any name are kept.
    """
    docs = gathered(docs)
    leaks = settle(overlaps(docs, benchmark).select(F.col("doc_id").alias("_i"), F.col("_text").alias("_t")).distinct(), docs.count())
    few = leaks.count() <= BROADCAST_LEAKS
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d"))
    same = F.col("_d.doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64(F.coalesce("_d.text", F.lit(""))) == F.col("_t"))
    return rows.join(F.broadcast(leaks) if few else leaks, same, "left_anti").select("_d.*")
