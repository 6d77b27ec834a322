"""Streams of vectors: codes and distances are stateless, so they run on a
stream as they do on a table; rankings are taken per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metric
from ..operators import search


def with_distance(stream: DataFrame, vector: str, query: list[float], name: str) -> DataFrame:
    """``stream`` with the distance of each vector from a fixed query."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    return stream.withColumn("distance", metric.distance(name, F.col(vector), asked))


def nearest_per_batch(stream: DataFrame, key: str, vector: str, query: list[float], k: int, name: str,
                      sink: Callable[[DataFrame, int], None]):
    """A stream writer that hands the k nearest of every micro-batch to ``sink``."""
    asked = F.array(*(F.lit(float(x)) for x in query))

    def each(batch: DataFrame, number: int) -> None:
        sink(search.nearest(batch.withColumn("_asked", asked), key, vector, "_asked", k, name), number)

    return stream.writeStream.foreachBatch(each)
