"""Clusters over batches against a loop over items."""

import difflib
import hashlib
import random

import pytest

from tidemark.operators.clusterstore import ClusterStore


def plain(items, threshold, most):
    prior, exact, postings, out = [], {}, {}, {}
    for i, text in items:
        toks = text.split()
        runs = {tuple(toks[k : k + 3]) for k in range(len(toks) - 2)} if len(toks) >= 3 else {tuple(toks)}
        found = set()
        for run in sorted(runs, key=lambda r: len(postings.get(r, []))):
            found.update(postings.get(run, []))
            if len(found) >= most:
                break
        best = []
        for k in sorted(found)[-most:]:
            a, b = toks, prior[k][0].split()
            union = {*a} | {*b}
            sim = max(len({*a} & {*b}) / len(union) if union else 1.0, difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())
            if sim >= threshold:
                best.append((-sim, prior[k][1]))
        cluster = exact.get(text) or (min(best)[1] if best else "text-" + hashlib.sha256(text.encode()).hexdigest()[:16])
        out[i] = cluster
        exact.setdefault(text, cluster)
        for run in runs:
            postings.setdefault(run, []).append(len(prior))
        prior.append((text, cluster))
    return out


def made(n):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts).split()
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
        else:
            texts.append("common start of all " + " ".join(rng.choices(words, k=rng.randrange(4, 12))))
    return list(enumerate(texts))


def frame(spark, items):
    return spark.createDataFrame([(i, t, t.split()) for i, t in items], "id long, text string, toks array<string>")


def test_batches_give_what_one_run_gives(spark, tmp_path):
    items = made(120)
    want = plain(items, 0.7, 10_000)
    store = ClusterStore(spark, str(tmp_path / "s"), 0.7)
    for part in (items[:50], items[50:51], items[51:]):
        store.append(frame(spark, part))
    assert {r.id: r.cluster_id for r in store.clusters().collect()} == want
    assert len(set(want.values())) < 100 and store.clusters(1).count() == 50
    whole = ClusterStore(spark, str(tmp_path / "one"), 0.7)
    assert {r.id: r.cluster_id for r in whole.append(frame(spark, items)).collect()} == want


def test_the_bound(spark, tmp_path):
    """All items share a run: the latest ones count, the same in any batches."""
    items = [(i, f"a b c x{i} y{i // 9}") for i in range(40)]
    want = plain(items, 0.5, 4)
    one, two = ClusterStore(spark, str(tmp_path / "a"), 0.5, 4), ClusterStore(spark, str(tmp_path / "b"), 0.5, 4)
    one.append(frame(spark, items))
    two.append(frame(spark, items[:23]))
    two.append(frame(spark, items[23:]))
    assert {r.id: r.cluster_id for r in one.clusters().collect()} == want == {r.id: r.cluster_id for r in two.clusters().collect()}


def test_odd_batches(spark, tmp_path):
    store = ClusterStore(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([(1, None, None), (2, "", []), (3, "one", ["one"])], "id long, text string, toks array<string>"))
    got = {r.id: r.cluster_id for r in store.clusters().collect()}
    assert got[1] == got[2] != got[3]
    assert store.append(frame(spark, [])).count() == 0 and store.store.head() == 1
    with pytest.raises(ValueError):
        store.append(frame(spark, [(3, "late")]))
    with pytest.raises(ValueError):
        store.append(frame(spark, [(9, "twice"), (9, "twice")]))


def test_both_batches_are_cut_at_one_id(spark, monkeypatch):
    """Every turn is in one of the two batches: the middle is a value, found once, and the turns are read once."""
    from tidemark.operators import clusterstore
    from tidemark.plans import QUERIES

    plans, ids, append = [], [], clusterstore.ClusterStore.append

    def seen(self, items):
        plans.append(items._jdf.queryExecution().optimizedPlan().toString())
        ids.append({r.id for r in items.select("id").collect()})
        return append(self, items)

    monkeypatch.setattr(clusterstore.ClusterStore, "append", seen)
    got = QUERIES["M12_stored_batches"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("percentile" in p for p in plans)
    assert max(ids[0]) < min(ids[1]) and {r.id for r in got.collect()} == ids[0] | ids[1]
