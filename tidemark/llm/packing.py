"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces (token ids by ``tokenizers`` and an end id); whole pieces of the
limit's length are sequences of their own. The others are dealt to cells of bounded
size. A chromosome is a packing, that is a list of bins. Crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold duplicates
of injected items, exchanges items of the bins left for displaced ones that fill them
better, and best-fits the rest; mutation dissolves the emptiest bins. Each cell is evolved by several islands, which pass their elite on to the next
island of the cell after each epoch. Cells whose packing meets the lower bound are
proven best and evolve no further. What the cells leave badly filled is dealt to new
cells of the same size and packed again, until one cell holds it or the bound for all
of it is met; if a level leaves more than half of what it got, only the worse half of
its bins goes on. No task ever sees more than one cell.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, settle

LIMIT, CELL, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2048, 4096, 2, 2, 6, 8
#: A bin below this share of the limit goes to the next level.
WELL_FILLED = 0.995
#: Bins of more items exchange single items only.
MOST_PAIRED = 8
#: Mean share of ``CELL`` pieces that the hash deals to a cell, so that none gets more.
LOAD = 0.75


def _byte_of() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids, as packed little-endian uint32 bytes, of a ``tokenizers`` file.

    A plain byte-level BPE whose ids follow its merges (checked here) gives the same ids
    from tiktoken's merge loop over the same file's vocabulary, in a third of the time.
    That is used for texts whose characters all lie below U+0250, where the Unicode tables
    of both agree; any other text, any that holds a special token, and any other kind of
    file go to ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        import json
        import re

        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.apart = re.compile("[\u0250-\U0010ffff]" + "".join("|" + re.escape(t) for t in special)).search
        model, pre, of = spec["model"], spec.get("pre_tokenizer") or {}, _byte_of()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or []]
        ids = [model["vocab"].get("".join(m), -1) for m in merges]
        plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
                 and not spec.get("normalizer") and ids == sorted(ids) and ids[:1] >= [256])
        if plain:
            import public_tokenizers
            import tiktoken

            ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """The file's own encoder, loaded for the first text that needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if self.fast is None or self.apart(text):
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return np.array(ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker: its tables take most of a second to build."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 for each piece of at most ``limit`` ids; uid numbers the rows of ``docs``."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    end = int(end_id).to_bytes(4, "little")
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for b in batches:
            row, out = [], []
            for r, text in enumerate(b.column(2)):
                ids = encoder.encode(text.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    m = (n - at) % limit or limit
                    row.append(r)
                    out.append((k, at, m, zlib.crc32(ids[4 * at : 4 * (at + m)])))
                    at, k = at + m, k + 1
            own = [b.column(i).take(pa.array(row, pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([x[i] for x in out], pa.int64()) for i in range(4))], names=names)

    rows = gathered(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"uid long, doc_id {kind}, piece long, start long, length long, ids_crc32 long")


# ---- the genetic algorithm over one cell; items are numbers, sizes their lengths ----


class Gaps:
    """Open bins by free room: a bit set of rooms in use finds the tightest that fits."""

    def __init__(self, limit: int) -> None:
        self.mask, self.by = 0, [[] for _ in range(limit + 1)]

    def put(self, room: int, b: int) -> None:
        self.by[room].append(b)
        self.mask |= 1 << room

    def take(self, size: int) -> int:
        """The bin with the least room of at least ``size``, or -1; removed."""
        rest = self.mask >> size
        if not rest:
            return -1
        room = size + (rest & -rest).bit_length() - 1
        b = self.by[room].pop()
        if not self.by[room]:
            self.mask &= ~(1 << room)
        return b


def best_fit(bins: list[list[int]], loose: list[int], sizes: list[int], limit: int) -> list[list[int]]:
    """Puts the loose items, largest first, each into the open bin that it fills most."""
    bins = [list(b) for b in bins]
    rooms, gaps = [limit - sum(sizes[i] for i in b) for b in bins], Gaps(limit)
    for k, r in enumerate(rooms):
        if r:
            gaps.put(r, k)
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        k = gaps.take(sizes[i])
        if k < 0:
            k = len(bins)
            bins.append([])
            rooms.append(limit)
        bins[k].append(i)
        rooms[k] -= sizes[i]
        if rooms[k]:
            gaps.put(rooms[k], k)
    return bins


def fitness(bins: list[list[int]], sizes: list[int], limit: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: higher is better."""
    return -len(bins), sum((sum(sizes[i] for i in b) / limit) ** 2 for b in bins)


def _tightest_pair(loose: list[tuple[int, int]], room: int) -> tuple[int, tuple[int, ...]]:
    """The largest sum, at most ``room``, of two of the (size, item) pairs in order of size, and their places; 0 without one."""
    a, b, best, at = 0, len(loose) - 1, 0, ()
    while a < b:
        total = loose[a][0] + loose[b][0]
        if total > room:
            b -= 1
            continue
        if total > best:
            best, at = total, (a, b)
            if total == room:
                break
        a += 1
    return best, at


def replace(bins: list[list[int]], loose: list[int], sizes: list[int], limit: int, rng: random.Random, passes: int = 2) -> list[list[int]]:
    """Fills bins better by giving up one or two items for one or two of the displaced ones, then best-fits what is displaced.

    A bin takes the exchange that fills it most; smaller items come free, and find room elsewhere.
    """
    bins = [list(b) for b in bins]
    fills, free = [sum(sizes[i] for i in b) for b in bins], sorted((sizes[i], i) for i in loose)
    for _ in range(passes):
        changed = False
        for k in rng.sample(range(len(bins)), len(bins)):
            own, room = bins[k], limit - fills[k]
            if not room or not free:
                continue
            gain, out, come = 0, (), ()
            pairs = combinations(own, 2) if len(own) <= MOST_PAIRED else ()
            for given in (*((i,) for i in own), *pairs):
                size = sum(sizes[i] for i in given)
                at = bisect_right(free, (room + size, len(sizes))) - 1
                if at >= 0 and free[at][0] - size > gain:
                    gain, out, come = free[at][0] - size, given, (at,)
                total, places = _tightest_pair(free, room + size)
                if total - size > gain:
                    gain, out, come = total - size, given, places
                if gain == room:
                    break
            if out:
                own += [free[x][1] for x in come]
                for x in sorted(come, reverse=True):
                    free.pop(x)
                for i in out:
                    own.remove(i)
                    insort(free, (sizes[i], i))
                fills[k], changed = fills[k] + gain, True
        if not changed:
            break
    return best_fit(bins, [i for _, i in free], sizes, limit)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], limit: int, rng: random.Random) -> list[list[int]]:
    """Injects well-filled bins of ``b`` into ``a``; bins of ``a`` that hold an injected item go, their other items are displaced (``replace``)."""
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    top = max(1, len(ranked) // 2)
    injected = [list(x) for x in rng.sample(ranked[:top], max(1, top // 2))]
    taken = {i for x in injected for i in x}
    kept, loose = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in taken]
    return replace(injected + kept, loose, sizes, limit, rng)


def mutate(bins: list[list[int]], sizes: list[int], limit: int, rng: random.Random) -> list[list[int]]:
    """Dissolves the emptiest bins and a few random ones."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(order[: max(1, len(bins) // 50)]) | set(rng.sample(order, min(len(order), 2 + len(order) // 20)))
    loose = [i for k in gone for i in bins[k]]
    return replace([b for k, b in enumerate(bins) if k not in gone], loose, sizes, limit, rng)


def lower_bound(sizes: list[int], limit: int) -> int:
    """Bins that any packing needs: by total, or by the items of which no two fit together (Martello and Toth)."""
    s = np.sort(np.asarray(sizes, dtype=np.int64))
    total, best = int(s.sum()), -(-int(s.sum()) // limit)
    above = np.concatenate([[0], np.cumsum(s)])
    for t in np.unique(s[s <= limit // 2]):
        big = len(s) - int(np.searchsorted(s, limit - t, side="right"))
        lo, mid, hi = (int(np.searchsorted(s, v, side=side)) for v, side in ((t, "left"), (limit // 2, "right"), (limit - t, "right")))
        between, small = hi - mid, int(above[mid] - above[lo])
        best = max(best, big + between + max(0, -(-(small - (between * limit - int(above[hi] - above[mid]))) // limit)))
    return max(best, len(s) - int(np.searchsorted(s, limit // 2, side="right")) if total else 0)


def evolve(sizes: list[int], limit: int, seed: int, elites: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best packing that one island finds from best-fit starts and the elites that migrated in."""
    rng, items = random.Random(seed), list(range(len(sizes)))
    first = best_fit([], items, sizes, limit)
    least = lower_bound(sizes, limit)
    pool = [first, *elites]
    if len(min(pool, key=len)) <= least:
        return max(pool, key=lambda p: fitness(p, sizes, limit))
    while len(pool) < population:
        pool.append(mutate(rng.choice(pool), sizes, limit, rng))
    score = partial(fitness, sizes=sizes, limit=limit)
    for _ in range(generations):
        pool.sort(key=score, reverse=True)
        if len(pool[0]) <= least:
            break
        a, b = pool[0], rng.choice(pool[1:])
        pool[population - 2 :] = [crossover(a, b, sizes, limit, rng), mutate(crossover(b, a, sizes, limit, rng), sizes, limit, rng)]
    return max(pool, key=score)


def _numbers(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(numbers) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        out.setdefault(int(k), []).append(i)
    return list(out.values())


def _level(rows: DataFrame, limit: int, seed: int, cells: int) -> DataFrame:
    """``rows`` (with cell) and _bin, _offset, _fill, _mean (fill of the cell's bins): the best packing that the islands of each cell find.

    A chromosome travels as one array per island and meets the rows of its cell by cogroup.
    """
    names = [f.name for f in rows.schema.fields]
    short = rows.select("cell", "uid", "piece", "length")
    kind = "cell long, island int, n int, fill double, proven boolean, numbers array<int>"

    elite_schema = pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("n", pa.int32()), ("fill", pa.float64()), ("proven", pa.bool_()), ("numbers", pa.list_(pa.int32()))])

    def order(own: pa.Table) -> pa.Table:
        return own.sort_by([("uid", "ascending"), ("piece", "ascending")])

    def elite_of(cell: int, island: int, bins: list[list[int]], sizes: list[int]) -> pa.Table:
        row = {"cell": cell, "island": island, "n": len(bins), "fill": fitness(bins, sizes, limit)[1], "proven": len(bins) <= lower_bound(sizes, limit), "numbers": _numbers(bins, len(sizes))}
        return pa.Table.from_pylist([row], schema=elite_schema)

    def first(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        sizes = order(own)["length"].to_pylist()
        return elite_of(key[0].as_py(), 0, best_fit([], list(range(len(sizes))), sizes, limit), sizes)

    def island(key: tuple[pa.Scalar, ...], own: pa.Table, elites: pa.Table) -> pa.Table:
        cell, number, sizes = key[0].as_py(), key[1].as_py(), order(own)["length"].to_pylist()
        return elite_of(cell, number, evolve(sizes, limit, seed + 7919 * cell + number, [_bins(e) for e in elites["numbers"].to_pylist()]), sizes)

    def lay(key: tuple[pa.Scalar, ...], own: pa.Table, best: pa.Table) -> pa.Table:
        own = order(own)
        bins, sizes = np.asarray(best["numbers"][0].as_py(), dtype=np.int64), own["length"].to_numpy()
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        by_bin, before = np.argsort(bins, kind="stable"), np.concatenate([[0], np.cumsum(fill)])
        offset = np.empty_like(sizes)
        offset[by_bin] = np.cumsum(sizes[by_bin]) - sizes[by_bin] - before[bins[by_bin]]
        added = {"_bin": bins, "_offset": offset, "_fill": fill[bins], "_mean": np.full(len(sizes), sizes.sum() / max(1, (fill > 0).sum()))}
        return pa.Table.from_arrays([*(own[n] for n in names), *(pa.array(v) for v in added.values())], names=[*names, *added])

    elite = settle(short.groupBy("cell").applyInArrow(first, kind), cells)
    for _ in range(EPOCHS):
        open_cells = elite.groupBy("cell").agg(F.max("proven").alias("p")).where(~F.col("p")).select("cell")
        if not open_cells.limit(1).count():
            break
        # Migration: each island starts from its own elite and that of its predecessor in the ring;
        # in the first epoch all islands start from the one best-fit packing.
        more = elite.join(open_cells, "cell", "left_semi")
        alone = more.groupBy("cell").agg(F.count(F.lit(1)).alias("k"))
        everywhere = F.array(*(F.lit(i) for i in range(ISLANDS)))
        to = F.when(F.col("k") == 1, everywhere).otherwise(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")))
        given = more.join(alone, "cell").select("cell", F.explode(to).alias("island"), "numbers")
        spread = short.join(open_cells, "cell", "left_semi").withColumn("island", F.explode(everywhere))
        better = spread.groupBy("cell", "island").cogroup(given.groupBy("cell", "island")).applyInArrow(island, kind)
        elite = settle(elite.join(open_cells, "cell", "left_anti").unionByName(better), cells * ISLANDS)
    best = elite.groupBy("cell").agg(F.max_by("numbers", F.struct(-F.col("n"), F.col("fill"), -F.col("island"))).alias("numbers"))
    kind = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "_bin long, _offset long, _fill long, _mean double"])
    return rows.groupBy("cell").cogroup(best.groupBy("cell")).applyInArrow(lay, kind)


def bound_of(parts: DataFrame, limit: int) -> int:
    """``lower_bound`` for a table, from how often each length occurs: at most ``limit`` rows reach the driver."""
    many = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    s, n = (np.array([r[k] for r in many], dtype=np.int64) for k in ("length", "n"))
    total, best = int((s * n).sum()), 0
    for t in [0, *sorted(x for x in s.tolist() if x <= limit // 2)]:
        big, mid = s > limit - t, (s > limit // 2) & (s <= limit - t)
        small = (s >= t) & (s <= limit // 2)
        room = int((n[mid] * (limit - s[mid])).sum())
        best = max(best, int(n[big].sum() + n[mid].sum()) + max(0, -(-(int((s[small] * n[small]).sum()) - room) // limit)))
    return max(best, -(-total // limit))


def pack(parts: DataFrame, limit: int = LIMIT, cell: int = CELL, seed: int = 17) -> DataFrame:
    """``parts`` with sequence_id and offset: at most ``limit`` ids a sequence, no gaps.

    Cells are numbered on over all levels, so a sequence id is the cell's number and the
    bin in it; sequences of one full piece have odd ids.
    """
    parts = settle(parts)
    full = parts.where(F.col("length") == limit).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    rest, out, names = parts.where(F.col("length") < limit), full, parts.columns
    first, level, before = 0, 0, None
    while True:
        n = rest.count()
        cells = 1 if n <= cell else -(-n // int(LOAD * cell))
        rows = rest.withColumn("cell", F.pmod(F.xxhash64("uid", "piece", F.lit(level)), F.lit(cells)))
        packed = settle(_level(rows, limit, seed + level, cells), n)
        placed = packed.select(*names, (2 * ((F.col("cell") + first) * 2**24 + F.col("_bin"))).alias("sequence_id"), F.col("_offset").alias("offset"), "_fill", "_mean")
        # The last level: one cell, or no better packing is possible.
        if cells == 1 or packed.where(F.col("_offset") == 0).count() <= bound_of(rest, limit):
            return out.unionByName(placed.drop("_fill", "_mean"))
        loose = F.col("_fill") < WELL_FILLED * limit
        if before is not None and n > before / 2:  # what remains fills bins no better: only bins below their cell's mean go on
            loose = loose & (F.col("_fill") < F.col("_mean"))
        out = out.unionByName(placed.where(~loose).drop("_fill", "_mean"))
        rest, before, first, level = packed.where(loose).select(*names), n, first + cells, level + 1


def packed_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null text counts as empty: one end id. Longer documents are cut so that only the
    first piece is shorter. Repeated rows are documents of their own; null doc_ids stay
    null. An empty table gives no rows; other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, limit), limit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
