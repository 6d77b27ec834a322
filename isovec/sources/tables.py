"""Reading and writing corpora of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_codes(df: DataFrame, vector: str, bounds: DataFrame, path: str) -> None:
    """Writes ``df`` with ``code_int8`` and ``code_int1`` of a vector column, for
    scans that read the codes alone. ``bounds`` is one row from ``vector_bounds_agg``."""
    beside = df.crossJoin(F.broadcast(bounds.limit(1)))
    (beside.withColumn("code_int8", codes.quantize_int8(F.col(vector), F.col("bounds")))
     .withColumn("code_int1", codes.quantize_int1(F.col(vector), F.col("bounds"))).write.parquet(path))
