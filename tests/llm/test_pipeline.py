"""The pipeline's rows against a plain version of every stage, on the smallest tables."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_llm_operators import plain_fp, plain_leak, plain_pii

SF = "/root/testdata/sf0.001"


def test_on_empty_and_awkward_tables(spark, tmp_path):
    import corpus_pipeline as cp
    from test_llm_operators import awkward, bench, empty, labels

    for name, docs in (("empty", empty(spark)), ("odd", awkward(spark).withColumn("uid", F.lit(1)).withColumn("_hot", F.lit(True)))):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        labels(spark).limit(0 if name == "empty" else 99).write.parquet(f"{at}/labels.parquet")
        bench(spark).write.parquet(f"{at}/benchmark.parquet")
        rows = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, rows, at)
            assert out.columns == docs.columns and out.schema == rows.schema
        got = cp.run(spark, at).collect()
        assert bool(got) == (name == "odd") and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
        if got:
            assert {4, 5, 6} <= {r.doc_id for r in got} and sum(r.length for r in got if r.doc_id == 6) > 20_000


def test_stages_against_plain_versions(spark):
    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import toxicity

    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "personal_data", "best_fit_packing"]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = {r.doc_id: r.text for r in docs.collect()}
    grammar, w = toxicity.train(docs, labels)
    now = {i: t for i, t in now.items() if grammar.features(t) @ w[:-1] + w[-1] < 0}
    fps, root = {i: plain_fp(t) for i, t in now.items()}, {i: i for i in now}
    for a in sorted(now):
        for b in sorted(now):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    now = {i: t for i, t in now.items() if root[i] == i}
    now = {i: t for i, t in now.items() if not any(plain_leak(t, u) for u in items)}

    def redacted(t):
        out, at = [], 0
        for s in filter(None, plain_pii(t).split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out += [t[at: int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        return "".join(out) + t[at:] if out else t
    now = {i: redacted(t) for i, t in now.items()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in now.items()}

    got = cp.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    for r in got:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start: r.start + r.length].tobytes())
    assert not any(re.search(r"@[a-z0-9]+\.example", t) for t in now.values())
