"""A study from record files to a report: ordered stages, each written as Parquet and read by the next."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.costs import CostModel
from .operators import market, models, portfolio, quality
from .sources import readers, stores

FEATURES = ["return_1d", "return_5d", "momentum_20d", "abnormal_volume_20d", "realized_volatility_20d", "high_low_spread_estimate", "amihud_illiquidity_20d"]


@dataclass(frozen=True)
class Config:
    assets: str
    bars: str
    out: str
    horizon: int = 1
    top_k: int = 5
    min_train_rows: int = 20
    equity: float = 1_000_000.0
    periods_per_year: float = 252.0
    features: tuple[str, ...] = tuple(FEATURES)
    limits: portfolio.Limits = field(default_factory=portfolio.Limits)
    costs: CostModel = field(default_factory=CostModel)

    def check(self) -> None:
        """ValueError for settings that cannot work, and for an output folder that holds an input or lies in one."""
        wrong = [n for n in ("horizon", "top_k", "min_train_rows", "equity", "periods_per_year") if getattr(self, n) <= 0]
        wrong += [] if self.features else ["features"]
        for n in ("assets", "bars"):
            a, b = f"{getattr(self, n).rstrip('/')}/", f"{self.out.rstrip('/')}/"
            if a.startswith(b) or b.startswith(a):
                wrong.append(f"{n} overlaps out")
        if wrong:
            raise ValueError("configuration: " + ", ".join(wrong))


Read = Callable[[str], DataFrame]


def bars(spark: SparkSession, c: Config, read: Read) -> DataFrame:
    """Daily bars of known assets with session numbers; a repeated or an unknown (asset, session) raises QualityError."""
    b = readers.bars(spark, c.bars).select("asset_id", F.coalesce("session_date", F.to_date("ts")).alias("ts"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"),
                                           F.col("return_adjustment_factor").alias("factor"))
    quality.assert_empty(quality.duplicates(b, ["asset_id", "ts"]), "repeated bars")
    quality.assert_empty(quality.unknown_references(b, readers.assets(spark, c.assets), "asset_id"), "bars of unknown assets")
    sessions = b.select("ts").distinct().withColumn("seq", F.row_number().over(Window.orderBy("ts")).cast("long"))  # one row per session
    return b.join(sessions, "ts")


def features(spark: SparkSession, c: Config, read: Read) -> DataFrame:
    b = read("bars")
    wanted = dict.fromkeys(["asset_id", "ts", "seq", "close", *c.features, "dollar_volume", "realized_volatility_20d"])
    whole = market.volatility(market.liquidity(market.returns(b)))  # one window a asset for all of them
    return whole.select(*(n for n in wanted if n in whole.columns))


def labels(spark: SparkSession, c: Config, read: Read) -> DataFrame:
    l = market.forward_labels(read("bars"), c.horizon)
    return l.select("asset_id", "ts", "forward_return", "forward_volatility", "label_start", "label_end", "expected_end_seq", "missing_reason")


def _rows(read: Read) -> DataFrame:
    l = read("labels").select("asset_id", "ts", F.col("forward_return").alias("y"), F.unix_date("label_end").cast("long").alias("avail"))
    return read("features").withColumn("decision", F.unix_date("ts").cast("long")).join(l, ["asset_id", "ts"])


def train(spark: SparkSession, c: Config, read: Read) -> DataFrame:
    return models.walk_forward(_rows(read), list(c.features), c.min_train_rows)


def predict(spark: SparkSession, c: Config, read: Read) -> DataFrame:
    return models.predict(_rows(read), read("train"), list(c.features), ["asset_id", "ts"])


def evaluate(spark: SparkSession, c: Config, read: Read) -> DataFrame:
    known = read("predict").join(read("labels").where("forward_return is not null").select("asset_id", "ts", F.col("forward_return").alias("y")), ["asset_id", "ts"])
    return models.evaluate(known.withColumn("segment", F.lit("all")), "segment", "ts")


def backtest(spark: SparkSession, c: Config, read: Read) -> DataFrame:
    """Periods of the constrained top-k portfolio, every ``horizon``-th session."""
    master = readers.assets(spark, c.assets).select("asset_id", "sector")
    l = read("labels").where("forward_return is not null").select("asset_id", "ts", "forward_return", "label_start", "label_end")
    rows = read("predict").join(l, ["asset_id", "ts"]).join(read("features").select("asset_id", "ts", "seq", "close", "dollar_volume", F.col("realized_volatility_20d").alias("volatility")), ["asset_id", "ts"])
    rows = rows.where(F.pmod("seq", F.lit(c.horizon)) == 0).join(master, "asset_id", "left").withColumn("beta", F.lit(1.0))
    rows = rows.withColumn("holding_days", F.greatest(F.lit(1.0), F.datediff("label_end", "label_start").cast("double")))
    book = portfolio.constrain(portfolio.top_k(rows, c.top_k, ["ts"], c.limits), ["ts"], c.limits, c.equity)
    return portfolio.equity_curve(portfolio.periods(book, ["ts"], c.costs), "ts")


def report(spark: SparkSession, c: Config, read: Read) -> DataFrame:
    """One row: the summary of the replay beside the figures of the predictions."""
    of = read("evaluate").select(F.lit(1).alias("_k"), "dates", "mean_ic", F.col("hit_rate").alias("prediction_hit_rate"), "mse")
    s = portfolio.summary(read("backtest").drop("equity", "peak", "drawdown"), "ts", c.periods_per_year).withColumn("_k", F.lit(1))
    return s.join(of, "_k").drop("_k")


#: Stages in order, with the stages that each reads.
STAGES: dict[str, tuple[Callable[[SparkSession, Config, Read], DataFrame], tuple[str, ...]]] = {
    "bars": (bars, ()), "features": (features, ("bars",)), "labels": (labels, ("bars",)), "train": (train, ("features", "labels")), "predict": (predict, ("features", "labels", "train")),
    "evaluate": (evaluate, ("predict", "labels")), "backtest": (backtest, ("predict", "labels", "features")), "report": (report, ("backtest", "evaluate")),
}


def needed(stage: str) -> list[str]:
    """``stage`` and all it depends on, in order."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    wanted, todo = set(), [stage]
    while todo:
        s = todo.pop()
        wanted.add(s)
        todo += STAGES[s][1]
    return [s for s in STAGES if s in wanted]


def run_to_stage(spark: SparkSession, config: Config, stage: str = "report") -> DataFrame:
    """Runs ``stage`` and what it needs; every result stays below ``config.out``, with a manifest of settings and row counts.

    A stage whose folder is complete is not run again, so a broken study goes on where it
    stopped; a folder of a run with other settings raises ValueError.
    """
    config.check()
    settings = stores.canonical_json(asdict(config))
    told = f"{config.out}/settings"
    if _exists(spark, told):
        if spark.read.text(told, wholetext=True).first()[0].strip() != settings:
            raise ValueError("the output folder belongs to a study with other settings")
    else:
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.text(told)
    read = lambda s: spark.read.parquet(f"{config.out}/{s}")
    for s in needed(stage):
        if not _exists(spark, f"{config.out}/{s}/_SUCCESS"):
            STAGES[s][0](spark, config, read).write.mode("overwrite").parquet(f"{config.out}/{s}")
    return read(stage)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, config: Config) -> dict:
    """Settings, and rows and digest of every finished stage."""
    done = {s: stores.table_digest(spark.read.parquet(f"{config.out}/{s}")) for s in STAGES if _exists(spark, f"{config.out}/{s}/_SUCCESS")}
    return {"settings": json.loads(stores.canonical_json(asdict(config))), "stages": {s: {"rows": n, "digest": d} for s, (n, d) in done.items()}}


def main(argv: list[str]) -> str:
    """``python -m tidemark.study config.json [stage]``: runs the study and returns the report text."""
    from .session import session

    with open(argv[0]) as f:
        config = Config(**{k: tuple(v) if k == "features" else portfolio.Limits(**v) if k == "limits" else CostModel(**v) if k == "costs" else v for k, v in json.load(f).items()})
    spark = session()
    out = run_to_stage(spark, config, argv[1] if len(argv) > 1 else "report")
    if len(argv) > 1 and argv[1] != "report":
        return f"{argv[1]}: {out.count()} rows\n"
    return stores.report("Study", out.first().asDict(), spark.read.parquet(f"{config.out}/backtest").orderBy("ts"))


if __name__ == "__main__":
    import sys

    print(main(sys.argv[1:]))
