"""Search and fitting over frames of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import embed, metric as metrics
from ..functions.exact import SAME_LENGTH, fail, has_null

MAX_K = 10_000


def checked_k(k: int) -> int:
    if k <= 0:
        raise ValueError(f"k must be greater than zero, got {k}")
    if k > MAX_K:
        raise ValueError(f"k of knn_agg must be less than or equal to {MAX_K}; found {k}")
    return k


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ranked(df: DataFrame, key, vector, query, k: int, metric: str, group_by: tuple[str, ...], bounds) -> DataFrame:
    """``group_by``, ``rank``, ``_key``, ``_distance`` of the first k rows of every group: near first, then NaN, then rows
    without a distance, ties by key. The distance is computed once a row; what has none is left to the caller to drop."""
    name = metrics.resolve(metric)
    x, y = _column(vector), _column(query)
    binary = isinstance(df.select(x).schema[0].dataType, T.BinaryType)
    rows = df.select(*group_by, _column(key).alias("_key"),
                     metrics.distance(name, x, y, None if bounds is None else _column(bounds), binary).alias("_distance"))
    near = F.col("_distance").desc() if metrics.higher_is_closer(name) else F.col("_distance").asc()
    order = [F.isnull("_distance"), F.isnan("_distance"), near]
    if not isinstance(rows.schema["_key"].dataType, T.MapType):
        order.append(F.col("_key").asc_nulls_last())
    if not group_by:
        rows = rows.orderBy(*order).limit(checked_k(k))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group_by).orderBy(*order))).where(F.col("rank") <= checked_k(k))


def nearest(df: DataFrame, key, vector, query, k: int, metric: str, group_by: tuple[str, ...] = (), bounds=None) -> DataFrame:
    """Rows ``group_by``, ``rank`` (from 1), ``key``, ``distance`` of the k nearest of every group.

    Grouped, the rank limit is applied in every task before the shuffle and again
    after it, for k up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1,000
    unless the session sets it); without groups the plan is a top-k with no shuffle at all.
    """
    found = _ranked(df, key, vector, query, k, metric, group_by, bounds).where("_distance IS NOT NULL")
    return found.select(*group_by, "rank", F.col("_key").alias("key"), F.col("_distance").alias("distance"))


def knn_agg(df: DataFrame, key, vector, query, k: int, metric: str, group_by: tuple[str, ...] = (), bounds=None) -> DataFrame:
    """One row per group with ``neighbours``: array<struct<key, distance>>, nearest first; null where nothing qualifies.

    A group in which nothing does is told by its rows without a distance, which rank last."""
    found = _ranked(df, key, vector, query, k, metric, group_by, bounds)
    one = F.when(F.col("_distance").isNotNull(), F.struct("rank", F.col("_key").alias("key"), F.col("_distance").alias("distance")))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda n: F.struct(n["key"], n["distance"]))
    neighbours = F.when(F.count("_distance") > 0, listed).alias("neighbours")
    return found.groupBy(*group_by).agg(neighbours) if group_by else found.agg(neighbours)


def vector_bounds_agg(df: DataFrame, vector, group_by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group with ``bounds``: the middle of every component's range, and the widest range over 255.

    Rows with a null component are skipped, but tell that there is their group;
    empty vectors have no offsets and scale 0. Minima and maxima are combined
    before the shuffle, a row per group and component from each task.
    """
    x = _column(vector)
    rows = df.select(*group_by, x.cast("array<double>").alias("_x"))
    usable = F.when(F.col("_x").isNotNull() & ~has_null(F.col("_x")), F.col("_x"))
    sides = rows.select(*group_by, usable.alias("_x")).select(
        *group_by, F.when(F.col("_x").isNotNull(), F.size("_x")).alias("_n"), F.posexplode_outer("_x").alias("_i", "_v")).groupBy(*group_by, "_i").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min("_n").alias("_short"), F.max("_n").alias("_long"))
    kind = "struct<offsets:array<double>,scale:double>"
    middle = F.when(F.col("_i").isNotNull(), F.struct("_i", ((F.col("_lo") + F.col("_hi")) / 2).alias("m")))
    offsets = F.transform(F.array_sort(F.collect_list(middle)), lambda p: p["m"])
    fitted = F.struct(offsets.alias("offsets"), F.coalesce(F.max(F.col("_hi") - F.col("_lo")) / 255, F.lit(0.0)).alias("scale"))
    bounds = F.when(F.count("_long") == 0, None).when(F.min("_short") != F.max("_long"), fail(SAME_LENGTH).cast(kind)).otherwise(fitted)
    return (sides.groupBy(*group_by) if group_by else sides).agg(bounds.alias("bounds"))


def knn_rerank(df: DataFrame, key: str, code, query_code, vector, query, k: int, oversample: int, metric: str, code_metric: str | None = None,
               bounds=None) -> DataFrame:
    """``rank``, ``key``, ``distance``: a shortlist of ``k * oversample`` on codes, ranked anew on the exact vectors.

    The shortlist, ``MAX_K`` rows at most, is the broadcast side of the join back.
    """
    short = nearest(df, key, code, query_code, min(MAX_K, k * oversample), code_metric or metric, (), bounds).select(F.col("key").alias(key))
    return nearest(df.join(F.broadcast(short), key, "left_semi"), key, vector, query, k, metric)


def to_vector(df: DataFrame, text: str, dimension, algorithm="word", width: str = "float", into: str = "vector") -> DataFrame:
    """``df`` with the text's embedding: signed token counts by hash, scaled to length 1; zeros without a token, null for null.

    It works row by row, on a stream as on a table: nothing is shuffled. Tokens are cut and hashed inside Catalyst, and one
    vectorised function adds them up. Dimension and algorithm are constants or columns. (The array of one element keeps the
    higher-order functions out of the Python function's arguments, where Spark does not evaluate nested ones.)
    """
    rows = df.select("*", F.explode(F.array(embed.slots(F.col(text), dimension, algorithm))).alias("_slots"))
    return rows.withColumn(into, embed.dense(F.col("_slots"), dimension, width)).drop("_slots")
