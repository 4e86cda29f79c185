"""Record readers: CSV, JSON, JSON lines and Parquet, with filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .. import schemas


def read_records(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """By suffix: .csv (header), .json (an array or one object), .jsonl/.ndjson, .parquet or a folder of it. Any other: ValueError.

    With ``multi_line`` false, CSV values hold no line breaks, and large files are read in splits.
    """
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
    kind = suffix[2].lower() if suffix[1] else "parquet"
    reader = spark.read
    if kind == "csv":
        return _typed(reader.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"'), schema)
    if schema and kind in ("json", "jsonl", "ndjson"):
        reader = reader.schema(schema)
    if kind == "json":
        return reader.json(path, multiLine=True)
    if kind in ("jsonl", "ndjson"):
        return reader.json(path)
    if kind == "parquet":
        return reader.option("recursiveFileLookup", "false").parquet(path)
    raise ValueError(f"unsupported record format: {path}")


def _typed(df: DataFrame, schema: str | None) -> DataFrame:
    """Strings to the schema's types; blank is null, malformed values raise under ANSI rules."""
    if not schema:
        return df
    fields = StructType.fromDDL(schema).fields
    out = []
    for f in fields:
        c = F.nullif(F.trim(F.col(f.name)), F.lit("")) if f.name in df.columns else F.lit(None)
        if f.dataType.simpleString() == "boolean":
            low = F.lower(c.cast("string"))
            c = F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
        elif not isinstance(f.dataType, StringType) and f.dataType.simpleString().startswith(("array", "map", "struct")):
            c = F.from_json(c.cast("string"), f.dataType)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def filtered(df: DataFrame, equals: dict[str, list] | None = None, time_field: str | None = None, start: str | None = None, end: str | None = None,
             select: list[str] | None = None, distinct_sorted: str | None = None, limit: int | None = None) -> DataFrame:
    """Equality or membership (as text), inclusive time range, projection, distinct and sorted by one field, then the first rows."""
    for name, values in (equals or {}).items():
        df = df.where(F.col(name).cast("string").isin([str(v) for v in values]))
    if time_field and start is not None:
        df = df.where(F.col(time_field) >= F.lit(start).cast(df.schema[time_field].dataType))
    if time_field and end is not None:
        df = df.where(F.col(time_field) <= F.lit(end).cast(df.schema[time_field].dataType))
    if select:
        df = df.select(*select)
    if distinct_sorted:
        df = df.dropDuplicates([distinct_sorted]).orderBy(distinct_sorted)
    return df.limit(limit) if limit is not None else df


def decision_times(df: DataFrame, session: Column, available: Column) -> DataFrame:
    """session, decision (latest availability in the session), increasing (strictly later than the one before)."""
    d = df.groupBy(session.alias("session")).agg(F.max(available).alias("decision"))
    before = F.lag("decision").over(Window.orderBy("session"))  # one row per session: small after the aggregation
    return d.withColumn("increasing", F.coalesce(F.col("decision") > before, F.lit(True)))


def assets(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.ASSETS).withColumn("hard_to_borrow", F.coalesce("hard_to_borrow", ~F.col("short_available")))


def bars(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.BARS)


def text_items(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.TEXT_ITEMS)


ENTITIES = "array<struct<asset_id:string,symbol:string,name:string,relevance:double,mention_type:string,confidence:double>>"


def normalized_items(records: DataFrame) -> DataFrame:
    """Text records with entities as an array (JSON text is read), identifiers replaced by their hashes, and defaults filled in.

    Hashes that a record brings stay; else the author's trimmed, case-folded identifier (of
    author_id, author_handle, author the first there), the URL and the parent's id are hashed.
    The raw identifiers are dropped.
    """
    there = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in records.columns), F.lit(None).cast("string"))
    entities = F.lit(None) if "entities" not in records.columns else F.col("entities") if records.schema["entities"].dataType.typeName() == "array" else F.from_json("entities", ENTITIES)
    author = there("author_id", "author_handle", "author")
    text = F.concat(F.coalesce(there("title"), F.lit("")), F.lit("\n"), F.coalesce(there("body"), F.lit("")))
    out = records.withColumns({
        "entities": F.coalesce(entities, F.array()).cast(ENTITIES), "author_hash": F.coalesce(there("author_hash"), F.sha2(F.lower(author), 256)), "url_hash": F.coalesce(there("url_hash"), F.sha2(there("url"), 256)),
        "parent_item_id_hash": F.coalesce(there("parent_item_id_hash"), F.sha2(there("parent_item_id"), 256)), "canonical_text_hash": F.coalesce(there("canonical_text_hash"), F.sha2(F.lower(text), 256)),
        "relationship_type": F.coalesce(there("relationship_type"), F.lit("original")), "content_status": F.coalesce(there("content_status"), F.lit("unknown")),
        "retention_permitted": F.coalesce(there("retention_permitted").try_cast("boolean"), F.lit(True))})
    return out.drop("author_id", "author_handle", "author", "url", "parent_item_id")


def fundamentals(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.FUNDAMENTALS)


def earnings(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.EARNINGS)


def actions(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.ACTIONS)


def merged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of differing schemas as one: missing columns null, null types promoted, int and float to double; other conflicts raise TypeError."""
    frames = [spark.read.parquet(p) for p in paths]
    kinds: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            old = kinds.get(name, "void")
            if old in ("void", kind) or kind == "void":
                kinds[name] = kind if old == "void" else old
            elif {old, kind} <= {"int", "bigint", "float", "double"}:
                kinds[name] = "double" if {"float", "double"} & {old, kind} else "bigint"
            else:
                raise TypeError(f"column {name}: {old} and {kind}")
    out = None
    for df in frames:
        df = df.select(*(F.col(n).cast(k) if k != "void" else F.col(n) for n, k in kinds.items() if n in df.columns))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def day_bounds(start: str | None, end: str | None) -> tuple[str | None, str | None]:
    """Dates become the first and the last microsecond of their day; full timestamps stay."""
    first = f"{start} 00:00:00" if start and len(start) == 10 else start
    last = f"{end} 23:59:59.999999" if end and len(end) == 10 else end
    return first, last
