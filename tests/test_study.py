from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import study
from tidemark.operators.quality import QualityError
from tidemark.sources import synthetic


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("study"))
    p = synthetic.price_paths(spark, 8, 60, 3)
    b = p.select(F.concat(F.lit("A"), "asset").alias("asset_id"), F.date_add(F.lit(date(2024, 1, 1)), F.col("session").cast("int")).alias("session_date"), "open", "high", "low", "close",
                 (10_000 + F.col("session") * 10).alias("volume"), F.lit(1.0).alias("return_adjustment_factor"))
    b.write.csv(f"{at}/bars.csv", header=True)
    spark.range(8).select(F.concat(F.lit("A"), "id").alias("asset_id"), F.when(F.col("id") < 4, "x").otherwise("y").alias("sector"), F.lit("true").alias("short_available")).write.csv(f"{at}/assets.csv", header=True)
    return at


def test_a_study_runs_to_its_report_and_resumes(spark, files):
    c = study.Config(f"{files}/assets.csv", f"{files}/bars.csv", f"{files}/out", horizon=2, top_k=3)
    assert study.needed("train") == ["bars", "features", "labels", "train"]
    assert study.run_to_stage(spark, c, "train").count() == 60 * len(study.FEATURES)
    r = study.run_to_stage(spark, c).collect()
    assert len(r) == 1 and r[0].periods > 0 and r[0].max_drawdown <= 0 and r[0].dates == 58
    periods = spark.read.parquet(f"{files}/out/backtest")
    assert periods.where("gross_exposure > 0.9 + 1e-9 OR max_participation_rate > 0.05 + 1e-9").count() == 0
    m = study.manifest(spark, c)
    assert list(m["stages"]) == list(study.STAGES) and m["stages"]["bars"]["rows"] == 480
    with pytest.raises(ValueError, match="other settings"):
        study.run_to_stage(spark, study.Config(c.assets, c.bars, c.out, horizon=1))


def test_no_label_is_learned_before_it_is_known(spark, files):
    c = study.Config(f"{files}/assets.csv", f"{files}/bars.csv", f"{files}/out2", horizon=2, min_train_rows=1)
    t = study.run_to_stage(spark, c, "train")
    first = F.unix_date(F.lit(date(2024, 1, 1))).cast("long")
    # A label of session s ends at s + 2 and counts from s + 3 on: 8 assets a session.
    got = {x.d: x.n for x in t.where("feature = 'return_1d'").select((F.col("decision") - first).alias("d"), "n").collect()}
    assert [got[d] for d in range(5)] == [0, 0, 0, 8, 16]


def test_bad_settings_and_bars(spark, files):
    with pytest.raises(ValueError, match="horizon, bars overlaps out"):
        study.Config("/a", "/b/out/x", "/b/out", horizon=0).check()
    with pytest.raises(ValueError, match="unknown stage"):
        study.needed("nothing")
    twice = f"{files}/twice.csv"
    b = spark.read.csv(f"{files}/bars.csv", header=True)
    b.unionByName(b.limit(1)).write.csv(twice, header=True)
    with pytest.raises(QualityError, match="repeated bars"):
        study.run_to_stage(spark, study.Config(f"{files}/assets.csv", twice, f"{files}/out3"), "bars")
