"""Sinks and stores: partitioned Parquet, append-only feature store, content-addressed blobs, model registry, JSON, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import path_component


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 0, mode: str = "errorifexists") -> None:
    """Hive-partitioned zstd Parquet with safe folder names; nested values are kept as JSON text.

    Rows of one folder are brought together as far as tasks stay of one size: large folders
    are written by several tasks, small ones share one. ``rows_per_file`` bounds the rows of a
    file for readers that need it (0: files as large as their task).
    """
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    df = df.withColumns({c: path_component(F.col(c).cast("string")) for c in by})
    df.hint("rebalance", *by).write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy(*by).parquet(path)


class FeatureStore:
    """Append-only Parquet rows keyed by asset, decision, horizon and version; a stored key is never written again."""

    KEY = ("asset_id", "asof_ts", "horizon", "feature_set_version")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, version: str | None = None, assets: list[str] | None = None, start=None, end=None) -> DataFrame:
        df = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        if version is not None:
            df = df.where(F.col("feature_set_version") == version)
        if assets:
            df = df.where(F.col("asset_id").isin(assets))
        if start is not None:
            df = df.where(F.col("asof_ts") >= F.lit(start))
        return df.where(F.col("asof_ts") <= F.lit(end)) if end is not None else df

    def append(self, rows: DataFrame) -> None:
        key = list(self.KEY)
        if rows.groupBy(*key).count().where("count > 1").limit(1).count():
            raise ValueError("duplicate keys in the appended rows")
        try:
            stored = self.read().select(*key)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = None
        if stored is not None and rows.join(stored, key, "left_semi").limit(1).count():
            raise ValueError("keys are stored already")
        rows.withColumn("year", F.year("asof_ts")).write.mode("append").option("compression", "zstd").partitionBy("feature_set_version", "year").parquet(self.path)


def blob_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sha256, path, length of every file below ``path``: the content-addressed view of raw files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", "length")


def tree_digest(manifest: DataFrame, root: str) -> str:
    """One sha256 over relative names and file hashes in name order (a manifest is a small table)."""
    rel = F.substring_index("path", root.rstrip("/") + "/", -1)
    rows = manifest.select(F.concat_ws(":", F.length(rel), rel, "sha256").alias("x"), rel.alias("r"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]), "\n"), 256)).first()[0]


def save_model(snapshots: DataFrame, path: str, version: str) -> None:
    """Long table of snapshots (asof_ts, family, feature, mean, scale, weight) below its version; never overwritten."""
    snapshots.write.mode("errorifexists").parquet(f"{path}/model_version={path_safe(version)}")


def path_safe(value: str) -> str:
    import re

    return re.sub("[^A-Za-z0-9._-]+", "_", value)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, no non-finite numbers."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def strict_json(text: str):
    """A JSON value; a repeated key, NaN or Infinity raises ValueError."""
    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key in JSON")
        return dict(pairs)

    def finite(name: str):
        raise ValueError(f"not a JSON number: {name}")

    return json.loads(text, object_pairs_hook=unique, parse_constant=finite)


def report(title: str, metrics: dict, periods: DataFrame | None = None, limit: int = 1000) -> str:
    """A Markdown report: flattened metrics, then one line per period (a bounded, collected table)."""
    lines = [f"# {title}", ""]

    def walk(prefix: str, value) -> None:
        if isinstance(value, dict):
            for k in sorted(value):
                walk(f"{prefix}.{k}" if prefix else str(k), value[k])
        else:
            lines.append(f"- {prefix}: {value}")

    walk("", metrics)
    if periods is not None:
        lines += ["", "| " + " | ".join(periods.columns) + " |", "|" + "---|" * len(periods.columns)]
        lines += ["| " + " | ".join(str(v) for v in row) + " |" for row in periods.limit(limit).collect()]
    return "\n".join(lines) + "\n"


def content_addressed(df: DataFrame, column: str, key: str) -> DataFrame:
    """sha256, length, first (smallest key), copies: one row per distinct content; null contents are left out."""
    c = F.col(column)
    rows = df.where(c.isNotNull()).select(F.sha2(c, 256).alias("sha256"), F.length(c).cast("long").alias("length"), F.col(key).alias("_k"))
    return rows.groupBy("sha256", "length").agg(F.min("_k").alias("first"), F.count(F.lit(1)).alias("copies"))


def load_model(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/model_version={path_safe(version)}")


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest): the sum of the row hashes, so neither order nor files matter."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0))).first()
    return n, str(total)


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the named tables below ``path`` with a manifest (name, rows, digest) and returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    lines = []
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{path}/{path_safe(name)}")
        lines.append((name, *table_digest(spark.read.parquet(f"{path}/{path_safe(name)}"))))
    manifest = spark.createDataFrame(lines, "name string, rows long, digest string")  # one row per table
    manifest.coalesce(1).write.parquet(f"{path}/manifest.parquet")
    return spark.read.parquet(f"{path}/manifest.parquet")


def load_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle; ValueError if one is not what its manifest says."""
    out = {}
    for m in spark.read.parquet(f"{path}/manifest.parquet").collect():
        df = spark.read.parquet(f"{path}/{path_safe(m['name'])}")
        if table_digest(df) != (m["rows"], m["digest"]):
            raise ValueError(f"changed table: {m['name']}")
        out[m["name"]] = df
    return out
