"""Helpers that the corpus operators share: shared storage, lineage cuts, ASCII folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.storage import cut, shared_dir

__all__ = ["ascii_lower", "cores", "cut", "shared_dir", "table"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does just that to pure ASCII, and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
