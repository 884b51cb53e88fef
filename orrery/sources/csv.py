"""LOAD CSV: rows of a delimited file as maps (with headers) or lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import values as V


def csv_rows(spark: SparkSession, path: str, headers: bool, sep: str = ",") -> tuple[DataFrame, tuple]:
    df = spark.read.csv(path.removeprefix("file://") if path.startswith("file:///") else path, header=headers, sep=sep, inferSchema=False)
    if headers:
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), ("map", tuple((c, V.STRING) for c in df.columns))
    return df.select(F.array(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), V.list_of(V.STRING)
