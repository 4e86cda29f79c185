"""Operators of the training-data subpackage against plain versions, and on awkward rows."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontam, licenses, lm, packing, pii, quality, sharding, simhash, topk, toxicity
from tidemark.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, _fp long, w string, score double"
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran sel tim pod vug".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(spark):
    rng = random.Random(1)
    long_text = prose(rng, 20_000)
    near = prose(rng, 80)
    texts = [None, "", " \t\n", "one", "x" * 30_000, "1" * 30_000, long_text, near, near, near.replace("baran", "zzz", 1), "日本語 テスト é",
             "you are an idiot and a moron.", "mail a@b.co or call +1 (555) 123-4567 from 10.0.0.1, card 4111 1111 1111 1111"]
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "w", 0.5) for i, t in enumerate(texts)] + [(7, near, "en", "s", len(near), "x", 1, "w", 0.5), (None, near, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, "")], "item_id long, text string")


# ---- exact top-k ----

def plain_topk(vectors, k):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i)
            out |= {(i, r + 1): (j, -x) for r, (x, j) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e5, 1e12])
def test_topk(spark, scale):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(0, scale, 8).round(2)]) for i in range(120)] + [(200, [0.0] * 8), (201, [0.0] * 8)]
    v += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    got = topk.exact_topk(df.where("vec_id % 50 = 0"), df, group_bytes=200).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == {k: (j, max(min(s, 2**63 - 1), -(2**63))) for k, (j, s) in plain_topk(v, 5).items()}


def test_topk_keeps_large_components(spark):
    v = [(0, [1.0, 1.0]), (1, [1e8, 1.0]), (2, [2.0, 1.0]), (3, [1e300, 1.0]), (4, [-1e307, -1e308]), (5, [-1e300, 0.0]), (50, [1e9, -1e9])]
    df = spark.createDataFrame([(i, x, "e") for i, x in v], "vec_id long, embedding array<double>, score string")
    got = topk.exact_topk(df.where("vec_id % 50 = 0"), df, k=6).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [3, 1, 2, 50, 5, 4] and [r.vec_id for r in got if r.query_id == 50] == [4, 3, 1, 2, 0, 5]
    assert [r.score for r in got][:2] == [2**63 - 1, 256 * 256 * (10**8 + 1)] and got[5].score == -(2**63)


def test_topk_ranks_many_blocks_and_ties(spark):
    rng = np.random.default_rng(3)
    v = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(5000)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(2)
    got = topk.exact_topk(df.where("vec_id % 500 = 0"), df).collect()
    m = np.array([x for _, x in v]) * 256
    for q in range(0, 5000, 500):
        s = m @ m[q]
        best = [int(i) for i in np.lexsort((np.arange(5000), -s)) if i != q][:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, int(s[i])) for i in best]


def test_topk_ties_repeats_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9)] * 2, "vec_id long, embedding array<float>")
    got = topk.exact_topk(df.where("vec_id = 0"), df).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
    assert topk.exact_topk(df.limit(0), df).count() == 0 and topk.exact_topk(df, df.limit(0)).count() == 0


# ---- sharding ----

def plain_shards(rows, limit):
    """Splits bucket by bucket."""
    def bits(i):
        return bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    out, todo = {}, [("", [(i, len((t or "").encode()), bits(i)) for i, t in rows])]
    while todo:
        p, own = todo.pop()
        if sum(b for _, b, _ in own) <= limit or len(own) == 1:
            out |= {i: (p, sum(b for _, b, _ in own)) for i, _, _ in own}
        else:
            for d in "01":
                if part := [x for x in own if x[2][len(p)] == d]:
                    todo.append((p + d, part))
    return out


def test_sharding(spark):
    rng = random.Random(3)
    rows = [(i, "a" * rng.choice([0, 10, 100, 900, 5000])) for i in range(300)]
    got = {r.doc_id: (r.shard, r.shard_bytes) for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 2000).collect()}
    assert got == plain_shards(rows, 2000)


def test_sharding_hot_keys(spark):
    rows = [(7, "a" * 100)] * 200 + [(8, "b" * (50 + i)) for i in range(100)] + [(None, None)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1000).collect()
    per = collections.Counter()
    for r in got:
        per[r.shard] += r.n_bytes
    assert len(got) == len(rows) and max(per.values()) <= 1000
    assert all(r.shard_bytes == per[r.shard] for r in got)


# ---- personal data ----

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    def luhn(d):
        return sum((2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if ok(k, m.group()))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_pii_base_spans(spark):
    rng = random.Random(4)
    parts = ["a@b.cd", "_e@f.g", "x@y", "1.2.3.4", "5.6.7.8.9.10.11.12", "999.1.1.1", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49 30", "é", "日", " ", ".", "-", "@", "+", "12", "+1..2"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + [None, "", "1.2.3.4 " * 700, "a" * 20_000 + "@", "9" * 20_000, "a@" + "b." * 5000 + "c"]
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id], r.spans, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(k + ":", want)) for k in PLAIN]


def test_pii_bootstrap_and_redaction(spark):
    rng = random.Random(5)
    seeds = [f"{prose(rng, 5)} account holder user{i}@mail.example.com {prose(rng, 4)}" for i in range(12)]
    new = [f"{prose(rng, 4)} account holder KX-{i}4827193 {prose(rng, 4)}" for i in range(3)] + [f"later KX-04827193 again {prose(rng, 3)}", f"order number 20260101{prose(rng, 3)}"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(seeds + new)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert all(got[i].n_added == 1 for i in (12, 13, 14, 15)) and got[16].n_added == 0
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert "[EMAIL]" in clean[0].text and "user0" not in clean[0].text and "[ID]" in clean[15].text and clean[16].text == new[4]
    assert all(r.n_chars == len(r.text) for r in clean.values())


def test_pii_long_identifiers_and_contexts(spark):
    rng = random.Random(16)
    odd = "w" * 300
    seeds = [f"{prose(rng, 3)} {odd} holder user{i}@mail.example.com {prose(rng, 2)}" for i in range(12)]
    letters, long = "K" * 60 + "4827193", "KX-" + "48271930" * 30
    more = [f"{odd} holder {letters} {prose(rng, 2)}", f"{prose(rng, 2)} {odd} holder {long}", f"{odd[:-1]} bearer 99887766"]
    df = spark.createDataFrame(list(enumerate(seeds + more)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert got[12].n_added == 1 and got[13].n_added == 1 and got[14].n_added == 0
    assert got[13].spans.endswith(f":{len(more[1])}")


def test_pii_found_identifiers_lead_to_patterns(spark):
    rng = random.Random(17)
    rows = [f"{prose(rng, 3)} account holder user{i}@mail.example.com {prose(rng, 2)}" for i in range(30)]
    known = [f"KX-{i}482719{i}" for i in range(12)]
    rows += [f"{prose(rng, 3)} account holder {k}" for k in known]  # found beside the seeds
    rows += [f"{prose(rng, 3)} claim filed {k} {prose(rng, 2)}" for k in known]  # these make a pattern of their own
    rows += [f"{prose(rng, 3)} claim filed ZZ-00918273 {prose(rng, 2)}"]
    got = {r.doc_id: r.n_added for r in pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i] == 1 for i in range(30, 55)) and not any(got[i] for i in range(30))


def test_pii_redaction_of_very_many_spans(spark):
    text = " é ".join(f"u{i}@a.bc, 10.0.0.{i % 256}" for i in range(5000))
    overlapping = "x 1.2.3.4@a.bc +1 555 123 4567 4111 1111 1111 1111 y"
    rows = [(1, text, len(text)), (2, overlapping, 1), (3, None, None), (4, "", 0), (4, "", 0)]
    got = sorted(map(tuple, pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()))
    want = " é ".join("[EMAIL], [IP]" for _ in range(5000))
    assert got[0] == (1, want, len(want)) and got[2:] == [(3, None, None), (4, "", 0), (4, "", 0)]
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in plain_pii(overlapping).split(",")):
        if int(a) >= at:
            out += [overlapping[at: int(a)], f"[{kind.upper()}]"]
        at = max(at, int(b))
    assert got[1][1] == "".join(out) + overlapping[at:]


# ---- toxicity and quality ----

def test_grammar_scores_matched_clauses():
    g = toxicity.Grammar([], ["blorf"])
    kinds = lambda t: {k for k, v in zip(toxicity.KINDS, g.features(t)) if v}
    assert kinds("You are an idiot.") == {"insult_targeted"} and kinds("idiot") == {"insult"} and kinds("blorfing here") == {"insult"}
    assert kinds("You are not an idiot") == {"insult_negated"} and kinds("He said: moron") == {"insult_reported"}
    assert kinds("I kill you") == {"threat_targeted"} and kinds("you and me. idiot") == {"insult"} and not kinds("idiots_ and killer") and not kinds(None)
    assert kinds("YOU!! ARE!! AN!! IDIOT!!") == {"insult_targeted"} and kinds("you id!!iot") == {"insult_targeted"}
    many = g.features("idiot moron scum loser trash kill, said you")
    assert many[toxicity.KINDS.index("insult_targeted")] == np.log1p(5) and many[toxicity.KINDS.index("threat_targeted")] == np.log1p(1) and np.count_nonzero(many) == 2


def test_grammar_reads_a_long_clause_whole():
    g = toxicity.Grammar([], [])
    kinds = lambda t: {k for k, v in zip(toxicity.KINDS, g.features(t)) if v}
    filler = "lorem " * 5000
    assert kinds(f"you {filler} idiot") == {"insult_targeted"} and kinds(f"idiot {filler} you") == {"insult_targeted"}
    assert kinds(f"said {filler} idiot") == {"insult_reported"} and kinds(f"you. {filler} idiot") == {"insult"}
    assert g.features(f"idiot {filler} {filler} moron you")[toxicity.KINDS.index("insult_targeted")] == np.log1p(2)


def training(spark, n=400):
    rng, rows, labs = random.Random(6), [], []
    for i in range(n):
        bad, low = i % 4 == 0, i % 3 == 0
        t = prose(rng, 90)
        if bad:
            t = t.replace(" ", f" snarg{rng.choice(WORDS)} ", 2)
        if low:
            t = " ".join(w + "$$$" for w in t.split())
        rows.append((i, t))
        labs.append((i, int(not low), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labs, "doc_id long, quality int, toxic int"), {i: (q, x) for i, q, x in labs}


def test_toxicity_learns_unseen_words(spark):
    docs, labs, want = training(spark)
    got = toxicity.score_toxicity(docs, labs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == want[r.doc_id][1] for r in got if r.held_out]) > 0.95
    kept = toxicity.reject_toxic(docs, labs)
    assert kept.columns == docs.columns and abs(kept.count() - 300) <= 8


def test_quality_held_out(spark):
    docs, labs, want = training(spark)
    got = quality.score_quality(docs, labs).collect()
    assert np.mean([r.predicted == want[r.doc_id][0] for r in got if r.held_out]) > 0.95


def test_quality_gradient():
    rng = np.random.default_rng(0)
    m, x, starts, y = quality.Attention(5), rng.normal(size=(9, 5)), np.array([0, 2, 6]), np.array([1.0, 0, 1])
    m.p = {k: rng.normal(0, 0.5, v.shape) for k, v in m.p.items()}
    loss = lambda: -np.mean([a * np.log(p) + (1 - a) * np.log(1 - p) for a, p in zip(y, m.forward(x, starts)["y"])])
    g = m.gradient(m.forward(x, starts), y, starts)
    for k in m.p:
        at = (0,) * m.p[k].ndim
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


# ---- licences ----

def test_licenses(spark):
    texts = ["Foo bar.\nReleased under the MIT License.", "RELEASED!! UNDER!! THE!! MIT!! LICENSE.", "the mit license is nice", None,
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
             "Licensed under CC BY-NC 4.0. Also:\nLicensed under the Apache License, Version 2.0."]
    got = {r.doc_id: (r.rules, r.licenses) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("mit-release", "MIT"), 1: ("mit-release", "MIT"), 2: ("", ""), 3: ("", ""), 4: ("mit-text", "MIT"), 5: ("apache-notice,cc-by-nc-notice", "Apache-2.0,CC-BY-NC-4.0")}
    assert all(any(a in s or a in s.replace("by nc", "by-nc") for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())


def test_licenses_behind_ornaments(spark):
    got = licenses.scan(spark.createDataFrame([(1, "Released under the MIT Lic!!ense."), (2, "Lic!!ense")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.rules for r in got} == {1: "mit-release", 2: ""}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""


def test_licenses_in_wrapped_files_and_short_forms(spark):
    def wrapped(text, width, prefix=""):
        return "\n".join(f"{prefix}{line}" for p in text.split("\n\n") for line in [*textwrap.wrap(p.strip(), width), ""])

    want = {}
    for text, rule, name in ((MIT, "mit-text", "MIT"), (APACHE, "apache-header", "Apache-2.0"), (BSD, "bsd-2-text", "BSD-2-Clause")):
        for width in (40, 72, 80):
            want |= {wrapped(text, width, prefix): (rule, name) for prefix in ("", "# ", "// ", " * ", "    ")}
            want["int x = 1;\r\n/*\r\n" + wrapped(text, width, " * ").replace("\n", "\r\n") + "*/"] = (rule, name)
    want |= {"This software is released under the MIT License.": ("mit-release", "MIT"), "Licensed under the MIT License (see LICENSE).": ("mit-notice", "MIT"),
             "Licensed under the Apache License 2.0.": ("apache-notice", "Apache-2.0"), "This project is licensed\nunder the MIT License": ("mit-project", "MIT"),
             "It was released. Under the MIT License": ("", ""), "Not released under the MIT License.": ("", ""), "released under the MIT License of old": ("", "")}
    got = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.rules, r.licenses) for r in got} == dict(enumerate(want.values()))


# ---- decontamination ----

def plain_leak(doc, item):
    """The best aligned window of min(24, item) words anywhere; whole search, no seeds."""
    d, it = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (doc, item))
    size, best = min(24, len(it)), 0
    if len(it) < 3:
        return False
    for shift in range(-len(it) + 1, len(d)):
        eq = [0 <= shift + j < len(d) and d[shift + j] == w for j, w in enumerate(it)]
        best = max([best, *(sum(eq[s: s + size]) for s in range(len(it) - size + 1))])
    return best >= 0.8 * size


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 15, 24, 5, 3, 60])] + [(6, None), (7, "one two"), (None, prose(rng, 20))]
    docs = []
    for k in range(60):
        words = prose(rng, 120).split()
        if k % 2:
            it = (rng.choice([t for _, t in items if t])).split()
            it = [("zzz" if rng.random() < (0.1 if k % 4 == 1 else 0.45) else w) for w in it]
            at = rng.randrange(len(words))
            words[at:at] = it
        docs.append((k, " ".join(words).title() if k % 3 else ", ".join(words)))
    docs += [(100, None), (101, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    want = {(i, j) for i, t in docs for j, u in items if plain_leak(t, u)}
    assert got <= want and len(got) >= 0.97 * len(want)  # seeds may miss an overlap that is broken everywhere
    kept = {r.doc_id for r in decontam.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_decontamination_is_exact_at_every_length(spark):
    rng = random.Random(19)
    items = [(n, prose(rng, n)) for n in [*range(3, 30), 60]]
    docs = []
    for n, text in items:
        for extra in (0, 1):  # as many substitutions as the rule accepts, spread in many ways, and one more
            for _ in range(12):
                it, at = text.split(), rng.randrange(max(1, n - 23))
                for j in rng.sample(range(min(n, 24)), min(n, 24) - -(-4 * min(n, 24) // 5) + extra):
                    it[at + j] = "zzz"
                it = it[at: at + 24]
                docs.append((len(docs), " ".join([*prose(rng, rng.randrange(3)).split(), *it, *prose(rng, rng.randrange(3)).split()])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == {(i, j) for i, t in docs for j, u in items if plain_leak(t, u)}


def test_decontamination_in_blocks_reads_the_texts_once(spark, tmp_path):
    rng = random.Random(20)
    items = [(i, prose(rng, 30)) for i in range(40)] + [(100, None), (3, "one two"), (50, "a b c d")]
    items += [(i + 60, t) for i, t in items[:5]] + items[:3]  # the same words under other ids, and repeated items
    docs = [(i, " ".join([prose(rng, 40), items[i % 40][1] if i % 2 else "", prose(rng, 20)])) for i in range(60)]
    docs += [(0, docs[1][1]), (1, docs[1][1]), (None, docs[3][1]), (70, "word " * 50_000 + items[7][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    d, b = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id long, text string")
    once, many = decontam.overlaps(d, b), decontam.overlaps(d, b, block=40)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, many.collect()), key=str) and once.count() > 30
    assert many._jdf.queryExecution().executedPlan().toString().count(str(tmp_path / "d")) == 0  # only its word hashes, written once
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert {(1, 1), (0, 1), (None, 3), (70, 7)} <= got and all(j < 60 for _, j in got)
    assert {r.class_item_id for r in decontam.item_classes(b).where("item_id in (60, 64)").collect()} == {0, 4}


# ---- packing ----

def test_encoder_and_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([0, 1, 50, 300, 900, 3000])) for _ in range(60)] + [None, "", "日本 é\t\n  x", "<|endoftext|> a", "".join(map(chr, range(0x250)))]
    got = packing.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and all(r.ids_crc32 == zlib.crc32(ids[r.start: r.start + r.length].tobytes()) for r in own)
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1


def test_genetic_operators_keep_every_item():
    rng = random.Random(9)
    sizes = [rng.randrange(1, 1500) for _ in range(300)]
    a, b = packing.best_fit([], list(range(300)), sizes, 2048), packing.best_fit([[i] for i in range(0, 300, 2)], list(range(1, 300, 2)), sizes, 2048)
    loose = a[0] + a[5]
    for child in (packing.crossover(a, b, sizes, 2048, rng), packing.mutate(a, sizes, 2048, rng), packing.evolve(sizes, 2048, 1, [b]), packing.replace([x for x in a if x not in (a[0], a[5])], loose, sizes, 2048, rng)):
        assert sorted(i for x in child for i in x) == list(range(300)) and max(sum(sizes[i] for i in x) for x in child) <= 2048
    assert packing.lower_bound([1025] * 4, 2048) == 4 and packing.lower_bound([1024] * 4, 2048) == 2 and packing.lower_bound([], 2048) == 0


def test_packing_levels(spark):
    rng = random.Random(10)
    rows = [(i, i, 0, 0, rng.randrange(600, 900), 0) for i in range(900)]
    parts = spark.createDataFrame(rows, "uid long, doc_id long, piece long, start long, length long, ids_crc32 long")
    got = packing.pack(parts, 2048, cell=100).collect()
    seqs = collections.Counter()
    for r in got:
        seqs[r.sequence_id] += r.length
    assert len(got) == 900 and len({r.uid for r in got}) == 900 and max(seqs.values()) <= 2048 and len(seqs) <= 500


@pytest.mark.parametrize("low,high,share", [(600, 900, 0.97), (400, 1000, 0.97)])
def test_genetic_packing_beats_best_fit(low, high, share):
    rng = random.Random(18)
    sizes = [rng.randrange(low, high) for _ in range(1500)]
    plain = len(packing.best_fit([], list(range(1500)), sizes, 2048))
    assert packing.lower_bound(sizes, 2048) <= len(packing.evolve(sizes, 2048, 1, [])) <= share * plain


@pytest.mark.parametrize("sizes,bins", [([1100] * 1200, 1200), ([1000, 600, 448] * 400, 440), ([700] * 1200, 600)])
def test_no_packing_cell_grows(spark, monkeypatch, sizes, bins):
    parts = spark.createDataFrame([(i, str(i), 0, 0, n, 0) for i, n in enumerate(sizes)], "uid long, doc_id string, piece long, start long, length long, ids_crc32 long")
    largest, level = [], packing._level
    monkeypatch.setattr(packing, "_level", lambda rows, *a: largest.append(max(r["count"] for r in rows.groupBy("cell").count().collect())) or level(rows, *a))
    got = packing.pack(parts, 2048, cell=100).collect()
    assert len(got) == len(sizes) and len({r.sequence_id for r in got}) <= bins
    assert max(largest) <= 100 and len(largest) <= 12
    assert packing.bound_of(parts, 2048) == packing.lower_bound(sizes, 2048) <= bins


def test_packing_keeps_any_kind_of_id(spark):
    got = packing.packed_documents(spark.createDataFrame([("a", "x y"), (None, "z"), ("a", "x y")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.length) for r in got) == [("", 2), ("a", 3), ("a", 3)]


# ---- language model ----

def test_lm_network_is_a_distribution_and_learns():
    rng = np.random.default_rng(1)
    c = np.zeros((lm.CLASSES,) * 3)
    c[rng.integers(0, 9, 500), rng.integers(0, 9, 500), rng.integers(0, 9, 500)] = rng.integers(1, 9, 500)
    net = lm.WindowNetwork().fit(c, steps=60)
    logp = net.table().reshape(c.shape)
    assert np.allclose(np.exp(logp).sum(1), 1, atol=1e-4)
    assert (c * logp).sum() > (c * np.log(1 / lm.CLASSES)).sum()


def plain_lm(rows, most):
    """The score of every (uid, text) word by word, from plain counts and the networks."""
    texts = {u: (t or "").lower().encode().split() for u, t in rows}
    counts = collections.Counter(w for t in texts.values() for w in t)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    if len(ranked) > most:  # all words of one count come in or stay out
        ranked = [w for w in ranked[:most] if counts[w] > counts[ranked[most]]]
    number = {w: i for i, w in enumerate(ranked)}
    cls = {w: number[w] if number.get(w, lm.TOP) < lm.TOP else lm.TOP + lm.Codes.hashed(w) % lm.HASHED for w in counts}
    seen = np.zeros((2,) + (lm.CLASSES,) * 3)
    near = lambda t, i: cls[t[i]] if 0 <= i < len(t) else lm.EDGE
    for t in texts.values():
        for i, w in enumerate(t):
            for k, reach in enumerate((1, 2)):
                seen[k, near(t, i - reach), cls[w], near(t, i + reach)] += 1
    often = seen[0].sum((0, 2))
    p = [np.exp(lm.WindowNetwork().fit(c).table()).reshape(c.shape) for c in seen]
    fit = [(c * np.log(q)).sum() / seen[0].sum() for c, q in zip(seen, p)]
    share = np.exp(fit) / np.exp(fit).sum()
    out = {}
    for u, t in texts.items():
        own, total, unseen = collections.Counter(t), 0.0, 0
        for i, w in enumerate(t):
            total += np.log(sum(s * q[near(t, i - r), cls[w], near(t, i + r)] for s, q, r in zip(share, p, (1, 2))))
            total += np.log((counts[w] if w in number else counts[w] - own[w] + 0.5) / often[cls[w]])
            unseen += w not in number and counts[w] == own[w]
        out[u] = (len(t), unseen, total)
    return out


@pytest.mark.parametrize("most", [200_000, 30])
def test_lm_scores_every_word(spark, most):
    rng = random.Random(14)
    texts = [prose(rng, rng.randrange(0, 40)) + " " + " ".join(f"rare{rng.randrange(400)}" for _ in range(rng.randrange(6))) for _ in range(150)]
    texts += [None, "", texts[0], texts[0], "ÉTÉ İstanbul Straße ΑΣ", "only " * 50]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, s double").repartition(3)
    got, want = {r.doc_id: r for r in lm.score_documents(df, most).collect()}, plain_lm(enumerate(texts), most)
    assert got.keys() == want.keys()
    for i, (n, unseen, total) in want.items():
        assert (got[i].n_tokens, got[i].n_unseen) == (n, unseen)
        assert abs(got[i].log_likelihood - total) < 1e-4 * max(1, abs(total)) and (got[i].mean_log_likelihood is None) == (n == 0)


def test_lm_tells_texts_of_one_class_apart(spark):
    rng = random.Random(15)
    texts = [prose(rng, 30) for _ in range(40)] + ["common zebra"] * 9 + ["common yak"]
    got = {r.doc_id: r.log_likelihood for r in lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 60).collect()}
    assert got[40] > got[49]


# ---- near-duplicates ----

def plain_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i: i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limit", [2048, 8])
def test_simhash_components(spark, limit, monkeypatch):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(3, 60)) for _ in range(60)]
    for t in texts[:20]:
        texts += [" ".join(w if rng.random() > 0.03 else "qq" for w in t.split()) for _ in range(8)] + [t.upper()]
    texts += [None, "", " ", "a", "A"]
    docs = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    if limit == 8:
        original = simhash.near_links
        monkeypatch.setattr(simhash, "near_links", lambda f, radius=4: original(f, radius, 8))
        monkeypatch.setattr(simhash, "TREE_NODES", 100)  # several blocks of broadcast trees
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i * 3 + 1: plain_fp(t) for i, t in enumerate(texts)}
    root = {i: i for i in fps}
    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    kept = simhash.deduplicate(docs)
    assert {r.doc_id for r in kept.collect()} == set(root.values())


def test_simhash_hot_groups(spark, monkeypatch):
    """A large group of exact copies, a large group of near copies, repeated rows: with hot keys joined where they are, and without."""
    rng = random.Random(21)
    base, near = prose(rng, 60), prose(rng, 400).split()
    texts = [base] * 400 + [" ".join("qq" if j == i else w for j, w in enumerate(near)) for i in range(300)] + [prose(rng, 30) for _ in range(50)]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(3, base, "k"), (0, base, "k"), (0, base, "k"), (None, base, "k"), (None, None, "k"), (None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hot string").repartition(5)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    kept = sorted(map(tuple, simhash.deduplicate(df).collect()), key=str)
    monkeypatch.setattr("tidemark.llm.common.HOT", 20)
    monkeypatch.setattr(simhash, "BROADCAST_DROPS", 5)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == got
    assert sorted(map(tuple, simhash.deduplicate(df).collect()), key=str) == kept
    fps = {plain_fp(t): i for i, t in reversed(list(enumerate(texts)))}
    assert len(got) == len(rows) and {r[2] for r in got if r[0] is not None and r[0] < 400} == {0}
    assert (0, base, "k") in kept and kept.count((0, base, "k")) == 1 and sum(r[0] is None for r in kept) == 1 and len(kept) <= len(fps) + 1


@pytest.mark.parametrize("blocks,agree", simhash.schemes(4))
def test_every_near_pair_shares_a_shard(spark, blocks, agree):
    rng = random.Random(12)
    rows = []
    for _ in range(200):
        v = rng.getrandbits(64)
        w = v
        for b in rng.sample(range(64), rng.randrange(5)):
            w ^= 1 << b
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (v, w)))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.where(~F.arrays_overlap(simhash._keys(F.col("a"), blocks, agree), simhash._keys(F.col("b"), blocks, agree))).count() == 0


def test_bk_tree():
    rng = random.Random(13)
    values = [rng.getrandbits(10) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.near(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


# ---- awkward rows, empty tables ----

OPS = {
    "sharding": lambda s, d: sharding.assign(d), "pii": lambda s, d: pii.report(d), "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)), "licenses": lambda s, d: licenses.scan(d),
    "quality": lambda s, d: quality.score_quality(d, labels(s)), "packing": lambda s, d: packing.packed_documents(d).where("piece = 0"), "lm": lambda s, d: lm.score_documents(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_awkward_and_empty(spark, name):
    d = awkward(spark)
    assert OPS[name](spark, d).count() == d.count()
    assert OPS[name](spark, empty(spark)).count() == 0


STAGES = {"toxicity": lambda s, d: toxicity.reject_toxic(d, labels(s)), "simhash": lambda s, d: simhash.deduplicate(d), "decontam": lambda s, d: decontam.decontaminate(d, bench(s)), "pii": lambda s, d: pii.redact(d)}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns(spark, name):
    d = awkward(spark)
    out = STAGES[name](spark, d)
    assert out.columns == d.columns and out.count() <= d.count()
    assert {r.doc_id for r in out.collect()} >= {4, 6}
    assert STAGES[name](spark, empty(spark)).count() == 0


def test_empty_labels_and_benchmark(spark):
    d = awkward(spark)
    assert toxicity.score_toxicity(d, labels(spark).limit(0)).where("predicted = 1").select("doc_id").collect()[0].doc_id == 11
    assert {r.score for r in quality.score_quality(d, labels(spark).limit(0)).collect()} == {0.5}
    assert decontam.contaminated(d, bench(spark).limit(0)).count() == 0 and decontam.contaminated(empty(spark), bench(spark)).count() == 0


def test_held_out(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
