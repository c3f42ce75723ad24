"""Parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.session import ship_package


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder of parquet tables (one file or one folder of files each)."""
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
