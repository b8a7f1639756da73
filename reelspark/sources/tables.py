"""Reading the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_runtime_conf


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Column pruning and filter pushdown happen at the scan."""
    apply_runtime_conf(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
