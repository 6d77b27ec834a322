"""What the operators share: reading tables, column isolation and shared scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Fixed by the word definition of the contracts: the six ASCII white-space characters.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
WHITE_SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Isolated:
    """A frame whose columns are renamed by position, so that columns which the
    operator adds cannot clash with the caller's, whatever their names or repeats.

    ``self[name]`` is the first column of that name (case-insensitive);
    ``restore`` drops what the operator added and gives back the first names.
    """

    def __init__(self, df: DataFrame):
        ship(df.sparkSession)
        self.names = df.columns
        self.inner = [f"_in{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.inner)

    def __getitem__(self, name: str) -> Column:
        lowered = [x.lower() for x in self.names]
        if name.lower() not in lowered:
            raise ValueError(f"the input has no column {name!r}")
        return F.col(self.inner[lowered.index(name.lower())])

    def restore(self, df: DataFrame) -> DataFrame:
        return df.select(*self.inner).toDF(*self.names)

    def replaced(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """``restore`` with one column's value replaced."""
        target = self.inner[[x.lower() for x in self.names].index(name.lower())]
        return df.select(*(value.alias(c) if c == target else F.col(c) for c in self.inner)).toDF(*self.names)


def words(text: Column) -> Column:
    """The words of a text; none for null and for white space only."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


_kept: dict[Hashable, Any] = {}


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by a worker from task to task until another key is asked for.

    Workers serve one operator after the other. One that kept something of each would hold all of it at once."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Forgets what the worker keeps, and gives its free memory back to the system."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@lru_cache(maxsize=8)
def _own_root(application: str) -> str:
    root = tempfile.mkdtemp(prefix="isovec-scratch-")
    atexit.register(shutil.rmtree, root, True)
    return root


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A temporary one serves only where
    there is no cluster: there every executor runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        root = _own_root(spark.sparkContext.applicationId)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/isovec-{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes scratch files that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the files of a query's shuffles go when the query ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, label: str, path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Cuts lineage: writes the frame once to the shared folder and reads it back.

    The files survive the loss of any executor. They are compressed, unlike
    those of ``checkpoint()``. The shuffle files that the table was made from go
    as soon as it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    with _cleaning(spark):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
