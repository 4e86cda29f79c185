"""Chains of parents and the links of a freeze."""

import random

import pytest

from tidemark.operators import lineage


def plain_roots(parents):
    out = {}
    for k in parents:
        at, depth, seen = k, 0, {k}
        while parents[at] in parents:
            at, depth = parents[at], depth + 1
            if at in seen:
                break
            seen.add(at)
        out[k] = (None, None, "cyclic") if parents[at] in parents else (at, depth, "complete" if parents[at] is None else "broken")
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_roots(spark, monkeypatch, hot):
    monkeypatch.setattr(lineage, "HOT", hot)
    rng = random.Random(2)
    parents = {f"a{i}": f"a{i - 1}" if i else None for i in range(40)}  # one long chain
    parents |= {f"b{i}": "b0" if i else "gone" for i in range(30)}  # a root with many children that names a missing parent
    parents |= {"c0": "c2", "c1": "c0", "c2": "c1", "c3": "c0", "d": "d"}  # cycles
    parents |= {f"e{i}": rng.choice([None, "nowhere", *(f"e{j}" for j in range(i))]) for i in range(30)}
    df = spark.createDataFrame([*parents.items(), (None, "a1")], "k string, up string")
    assert {r.k: (r.root, r.depth, r.status) for r in lineage.roots(df, "k", "up").collect()} == plain_roots(parents)
    assert lineage.roots(df.limit(0), "k", "up").count() == 0


SCHEMA = "event_hash string, study long, seq long, kind string, actor string, proposal string, definition string, run string, result string, model string, approval string"
SOUND = [("h0", 1, 0, "proposed", "agent", "p", None, None, None, None, None), ("h1", 1, 1, "compiled", "system", "p", "d", None, None, None, None), ("h2", 1, 2, "approved", "human", None, "d", None, None, None, None),
         ("h3", 1, 3, "started", "system", None, "d", "r", None, None, None), ("h4", 1, 4, "completed", "system", None, None, "r", "s", "m", None), ("h5", 1, 5, "frozen", "human", "p", "d", None, "s", "m", "h2")]


def changed(row, **to):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return [tuple(to.get(n, v) for n, v in zip(names, r)) if r[0] == row else r for r in SOUND]


@pytest.mark.parametrize("log,broken", [
    (SOUND, set()), (changed("h5", actor="agent"), {"actor"}), (changed("h5", actor=None), {"actor"}), ([*SOUND, SOUND[1][:1] + (2,) + SOUND[1][2:]], set()), ([*SOUND, ("h5", 9, 0, "proposed", *[None] * 7)], {"event_hash"}),
    (SOUND[1:], {"proposal"}), (changed("h1", definition="other"), {"compile"}), (changed("h1", seq=9), {"compile"}), (changed("h2", actor="agent"), {"approval"}), (changed("h5", approval=None), {"approval"}), (changed("h2", study=2), {"approval"}),
    (changed("h4", seq=6), {"completion"}), ([*SOUND, ("h6", 1, 4, *SOUND[4][3:])], {"completion"}), (changed("h3", run="r9"), {"start"}), ([*SOUND, ("h7", 1, 2, *SOUND[3][3:])], {"start"}), (changed("h3", definition="x"), {"definition"}), (changed("h3", definition=None), {"definition"}),
    (SOUND[5:], {"proposal", "compile", "approval", "completion"})])
def test_freeze_violations(spark, log, broken):
    got = lineage.freeze_violations(spark.createDataFrame(log, SCHEMA)).collect()
    assert {r.rule for r in got} == broken and len(got) == len(broken) and {r.event_hash for r in got} <= {"h5"}


def test_one_join_a_round(spark, monkeypatch):
    """A chain of 33 events takes at most seven rounds of one join each, after the one that finds the parents."""
    calls, lookup = [], lineage.lookup
    monkeypatch.setattr(lineage, "lookup", lambda *a: calls.append(1) or lookup(*a))
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(33)], "k long, up long")
    assert {r.k: (r.root, r.depth) for r in lineage.roots(df, "k", "up").collect()} == {i: (0, i) for i in range(33)}
    assert len(calls) <= 8
