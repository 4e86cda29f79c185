"""Tables written to the folder that all executors share, to cut lineage safely."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of its own for a local session, and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Removes all tables that this application has written; results not yet stored elsewhere are gone with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    at, schema = f"{scratch(spark)}/{uuid.uuid4().hex}", df.schema
    df.write.parquet(at)
    return spark.read.schema(schema).parquet(at)
