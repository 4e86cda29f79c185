"""Versioned snapshots and the stored index."""

import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators.lexical import LexicalIndex
from tidemark.sources.snapshots import Conflict, SnapshotStore


def test_versions_conflicts_compaction(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.head() == 0 and store.manifest()["tables"] == {}
    row = lambda *x: spark.createDataFrame([(i, str(i)) for i in x], "k long, v string")
    keys = lambda name, v=None: sorted(r.k for r in store.read(name, v).collect())
    assert store.commit({"a": row(1, 2), "b": row(7)}) == 1
    assert store.commit({"a": row(3)}) == 2 and keys("a") == [1, 2, 3] and keys("a", 1) == [1, 2] and keys("b") == [7]
    # Two writers start from version 2: the second one's rows never show.
    other = SnapshotStore(spark, str(tmp_path / "s"))
    tables = dict(store.manifest(2)["tables"])
    assert store.commit({"a": row(4)}, expected=2) == 3
    with pytest.raises(Conflict):
        other.commit({"a": row(5)}, expected=2)
    with pytest.raises(Conflict):
        other._publish(2, tables)  # even one that has looked at the head before the other moved it
    assert keys("a") == [1, 2, 3, 4] and store.versions() == [1, 2, 3]
    assert store.compact("a") == 4 and keys("a") == [1, 2, 3, 4] and len(store.manifest()["tables"]["a"]["parts"]) == 1 and keys("a", 2) == [1, 2, 3]
    assert store.commit({"a": row(9)}, replace=("a",)) == 5 and keys("a") == [9] and keys("a", 4) == [1, 2, 3, 4]
    # The same rows again are the same part.
    assert store.commit({"a": row(9)}) == 6 and keys("a") == [9]
    with pytest.raises(ValueError):
        store.commit({"a": spark.range(1)})
    with pytest.raises(ValueError):
        store.read("c")
    assert store.vacuum(1) > 0 and store.versions() == [6] and keys("a") == [9]


def grams(text, low=2, high=5):
    t = " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())
    return Counter(t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1))


def exhaustive(docs, queries, k, allowed=lambda i: True):
    own = {i: grams(t) for i, t in docs}
    df = Counter(g for c in own.values() for g in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in own.items():
            total = sum(c.values())
            s = sum(n * (c[g] / total) * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in grams(text).items() if g in c)
            if allowed(i) and round(s, 9) > 0:
                scores.append((-round(s, 9), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_index_equals_an_exhaustive_search(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "ﬁne", "Straße", "delta　x", "zeta", "eta", "théta", "iota"]
    docs = [(i * 3, " ".join(rng.choices(words, weights=range(1, 11), k=rng.randrange(0, 30)))) for i in range(300)] + [(5000, None), (5001, ""), (5002, "x"), (9999, "alpha Beta"), (10_000, "alpha Beta")]
    queries = [(1, "alpha beta"), (2, "FINE strasse théta"), (3, "nothing like it: qqq"), (4, ""), (5, "iota zeta eta")]
    frame = spark.createDataFrame([(i, t, "even" if i % 2 == 0 else "odd") for i, t in docs], "id long, text string, parity string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    index = LexicalIndex(spark, str(tmp_path / "i"), ids=64, buckets=4)
    index.append(frame.where("id < 400"))
    first = index.append(frame.where("id >= 400"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    for k in (1, 3, 400):
        assert rows(index.search(q, k, first=1)) == exhaustive(docs, queries, k)
    assert rows(index.search(q, 5, eligible=F.col("parity") == "odd")) == exhaustive(docs, queries, 5, lambda i: i % 2)
    assert {r.term: r.df for r in index.frequencies().collect()} == Counter(g for _, t in docs for g in grams(t))
    # As of the first version the later documents are unknown.
    assert rows(index.search(q, 4, version=first - 1)) == exhaustive([d for d in docs if d[0] < 400], queries, 4)
    with pytest.raises(ValueError):
        index.append(frame.where("id = 3"))
    with pytest.raises(ValueError):
        index.append(frame.where("id = 5002").unionByName(frame.where("id = 5002")).withColumn("id", F.lit(-1).cast("long")))


def test_few_ranges_are_read(spark, tmp_path):
    """A query about one range leaves the others alone."""
    docs = spark.range(2000).select("id", F.when(F.col("id") == 777, "needle in a haystack").otherwise(F.concat(F.lit("straw number "), F.col("id").cast("string"))).alias("text"))
    index = LexicalIndex(spark, str(tmp_path / "i"), ids=100)
    index.append(docs)
    q = spark.createDataFrame([(1, "needle haystack")], "query_id long, text string")
    assert index.search(q, 1).first().id == 777


def test_postings_come_in_pieces(spark, tmp_path, monkeypatch):
    """A task holds a piece of a range at a time; what is found is the same."""
    from tidemark.operators import lexical

    monkeypatch.setattr(lexical, "PIECE", 60)
    docs = [(i, f"word{i % 5} and some more of the same {i}") for i in range(-20, 60)]
    index = LexicalIndex(spark, str(tmp_path / "i"), ids=1024, buckets=2)
    pieces = lexical.posting_rows(spark.createDataFrame([(i, 0, t) for i, t in docs], "at int, range long, text string").coalesce(1), 2, 5)
    assert pieces.where("term = 'and'").count() == len(docs) and pieces.agg(F.max("n")).first()[0] == 1
    index.append(spark.createDataFrame(docs, "id long, text string"))
    assert {r.term: r.df for r in index.frequencies().collect()} == Counter(g for _, t in docs for g in grams(t))
    queries = [(1, "word3 and")]
    got = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in index.search(spark.createDataFrame(queries, "query_id long, text string"), 5, first=1).collect())
    assert got == exhaustive(docs, queries, 5)


def test_pieces_count_every_ngram_of_any_alphabet():
    """N-grams as numbers, in so many characters that the shorter ones are numbered anew, equal n-grams as strings."""
    from tidemark.operators import lexical

    rng = random.Random(11)
    wide = [chr(rng.choice([0x4E00, 0x1F300, 0x60]) + rng.randrange(9000 if rng.random() < 0.9 else 20)) for _ in range(20_000)]
    texts = ["".join(rng.choices(wide, k=k)) for k in (4000, 1, 900, 2, 12_000)] + ["abab" * 80, "b", "".join(wide)]
    ids = [0, 3, 4, 700, 701, 4000, 4001, 4095]
    want = {(g, i): c for i, t in zip(ids, texts, strict=True) for g, c in lexical.counted(t, 1, 5).items()}
    got = {}
    for term, most, n, docs, bucket in lexical.piece_rows(texts, ids, 1, 5, 64):
        assert list(bucket) == sorted(bucket)
        for cut, m, c in ((docs, term, n), (docs.slice(3), term.slice(3), n[3:])):  # a slice of rows too
            at, tf = lexical.postings_of(cut, c)
            of = [t for t, k in zip(m.to_pylist(), c, strict=True) for _ in range(k)]
            got |= dict(zip(zip(of, at.tolist(), strict=True), tf.tolist(), strict=True))
        share = {}
        for t, i in want:
            share[t] = max(share.get(t, 0), want[t, i] / sum(max(0, len(texts[ids.index(i)]) - k + 1) for k in range(1, 6)))
        assert all(share[t] <= m <= share[t] * 1.01 for t, m in zip(term.to_pylist(), most.tolist(), strict=True))
    assert got == want


def test_a_stored_text_takes_little_disk(spark, tmp_path):
    """An index takes a few bytes for each character that it holds."""
    rng = random.Random(12)
    syllables = ["an", "the", "tion", "re", "ing", "on", "sh", "ou", " ", "er", "or", ". "]
    docs = [(i, "".join(rng.choices(syllables, k=1200))) for i in range(900)]
    LexicalIndex(spark, str(tmp_path / "i")).append(spark.createDataFrame(docs, "id long, text string"))
    held = sum(p.stat().st_size for p in (tmp_path / "i").rglob("*.parquet"))
    assert held < 0.8 * sum(len(t) for _, t in docs)


def test_documents_of_every_language_are_found(spark, tmp_path):
    """The stored search leaves no document out, whatever its language."""
    from tidemark.plans import QUERIES

    spark.createDataFrame([(1, "ganz genau derselbe satz", "de", "s"), (2, "ganz anderer satz", "en", "s"), (3, "ganz genau derselbe", None, "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, "ganz genau derselbe satz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.id for r in QUERIES["G03_stored_index_search"](spark, str(tmp_path)).orderBy("rank").collect()] == [1, 3, 2]
