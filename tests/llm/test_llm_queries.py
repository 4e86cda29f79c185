"""The registered queries of the training-data subpackage: by name, against their SQL, on the plain tables and on awkward ones."""

import duckdb
import pytest
from test_llm_operators import awkward, bench, labels

from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark", "embeddings", "pages")
#: Columns that every result has.
COLUMNS = {
    "op1_exact_topk": {"query_id", "rank", "vec_id", "score"}, "op2_extendible_sharding": {"doc_id", "shard", "depth", "shard_bytes"}, "op3_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op5_license_scan": {"doc_id", "rules", "licenses"}, "op6_quality": {"doc_id", "held_out", "score", "predicted"},
    "op7_decontamination": {"doc_id", "item_id", "matched", "compared"}, "op8_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op9_lm_scoring": {"doc_id", "log_likelihood"},
    "op10_simhash_dedup": {"doc_id", "fingerprint", "component_id"}, "op11_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op13_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Awkward rows as tables of their own: nulls, empty and very long texts, repeated rows and ids, clashing columns."""
    at = tmp_path_factory.mktemp("odd")
    notices = [(100, "Released under the MIT Lic!!ense."), (101, "x;\n# Licensed under the\n# Apache License, Version 2.0. Bye"), (102, "a: Licensed under CC BY 4.0;b\x01\x02"), (103, "this work is licensed under CC BY-NC 4.0")]
    more = spark.createDataFrame(notices, "doc_id long, text string")
    awkward(spark).unionByName(more, allowMissingColumns=True).write.parquet(str(at / "documents.parquet"))
    labels(spark).write.parquet(str(at / "labels.parquet"))
    bench(spark).write.parquet(str(at / "benchmark.parquet"))
    vectors = [(0, [1.0, 2.0]), (50, [0.5, -1e9]), (50, [0.5, -1e9]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, [1e10, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0])]
    vectors = [(i, v, "c", 0 if i is None else i % 3) for i, v in vectors] + [(49, [1.5, 2.0], None, 1), (70, [0.5, 1.0], None, 9), (71, [0.5, 1.0], None, None), (72, [0.4, 1.0], None, 1), (73, [0.9, 1.0], None, 0), (73, [0.8, 1.0], None, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string, label int").write.parquet(str(at / "embeddings.parquet"))
    pages = [(1, "u", "a", 3), (1, "u", "a", 3), (2, None, "a", 4), (None, "u", None, 5), (3, "\r\nx", "", 6), (4, "u", "WARC/1.1\r\n\r\n", 7), (None, None, "b", None), (5, "u", "z" * 200_000, 8)]
    spark.createDataFrame(pages, "page_id long, url string, html string, payload_bytes long").write.parquet(str(at / "pages.parquet"))
    return str(at)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet(['{sf}/{t}.parquet{'' if sf == SF else '/*.parquet'}'])")
    return con


def rows(df):
    return sorted((tuple(r) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("tables", ["plain", "odd"])
def test_query_by_name(spark, odd, name, tables):
    sf = SF if tables == "plain" else odd
    got = QUERIES[name](spark, sf).toPandas()
    assert COLUMNS[name] <= set(got.columns)
    if name in ORACLES and not (tables == "odd" and name == "op2_extendible_sharding"):  # its SQL tells repeated ids apart by nothing
        want = connect(sf).execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    if "doc_id" in got.columns and name not in ("op7_decontamination", "op8_best_fit_packing"):
        assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_the_sharding_query_splits(spark):
    assert QUERIES["op2_extendible_sharding"](spark, "/root/testdata/sf0.01").select("shard").distinct().count() > 1
