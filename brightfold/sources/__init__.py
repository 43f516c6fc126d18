"""Sources: the star-schema tables, text lines and label lists as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as rows of one line; partitions follow the files' blocks, so size doesn't matter."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def save(df: DataFrame, path: str) -> None:
    """The sink: Parquet, as Spark partitions it."""
    df.write.mode("overwrite").parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where a session on one machine names none, one of its own is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc.getCheckpointDir()
