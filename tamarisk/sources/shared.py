"""Intermediate results as written tables in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a folder of the single process; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = "file://" + os.path.join(os.getcwd(), "spark-warehouse", "shared")
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return base.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Written once and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamarisk/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
