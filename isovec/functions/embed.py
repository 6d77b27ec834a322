"""Text embedding by feature hashing: tokens, and what each adds to the vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .exact import bind, fail

ALGORITHMS = ("word", "char_3gram", "char_4gram", "char_5gram")
LARGEST = 65536
#: Fixed value: hashes to 0 under Spark's seed 42, so that what follows it is hashed with seed 0.
SEED_ZERO = -365884300664092260


def resolve(algorithm: str, dimension: int) -> str:
    found = algorithm.lower() if isinstance(algorithm, str) else None
    if found not in ALGORITHMS:
        raise ValueError(f"Unknown embedding algorithm '{algorithm}', expected one of: [{', '.join(ALGORITHMS)}]")
    if not 1 <= dimension <= LARGEST:
        raise ValueError(f"Vector dimension must be between 1 and {LARGEST}, got {dimension}")
    return found


def prepared(text: Column) -> Column:
    """Valid UTF-8 in lower case, each code point on its own."""
    return F.lower(F.translate(F.make_valid_utf8(text), "Σİ", "σi"))


def tokens(text: Column, algorithm: str) -> Column:
    low = prepared(text)
    if algorithm == "word":
        return F.regexp_extract_all(low, F.lit("[\\p{L}\\p{Nd}]+"), F.lit(0))
    n = int(algorithm[5])
    # Code points first: a substring by position would read the text from its start each time.
    return bind(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), lambda points: F.when(
        F.size(points) >= n, F.transform(F.sequence(F.lit(0), F.size(points) - n), lambda i: F.concat(*(F.get(points, i + k) for k in range(n))))
    ).otherwise(F.array().cast("array<string>")))


def slot(token: Column, dimension: int | Column) -> Column:
    """``struct<i: int, sign: double>``: the component that the token adds to, and its sign."""
    h = F.xxhash64(F.lit(SEED_ZERO), token)
    return F.struct(F.shiftright(F.shiftrightunsigned(h, 32) * (F.lit(dimension) if isinstance(dimension, int) else dimension), 32).cast("int").alias("i"),
                    F.when(F.shiftright(h, 31).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0).alias("sign"))


def _scattered(kind: pa.DataType):
    def run(signed: pa.Array, dimension: pa.Array) -> pa.Array:
        """Dense vectors of length 1 from each row's slots, a number ``2 * component + (1 if negative)`` a token."""
        held = signed.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(held, dimension.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        ends = np.cumsum(sizes)
        tokens = signed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        slots = signed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(ends - sizes, tokens) + (slots >> 1)
        dense = np.bincount(at, 1.0 - 2.0 * (slots & 1), int(sizes.sum())).astype(np.float64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        square = np.bincount(row, dense * dense, len(sizes))
        dense *= np.divide(1.0, np.sqrt(square), out=np.zeros(len(sizes)), where=square > 0)[row]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(~held, False))
        return pa.ListArray.from_arrays(offsets, pa.array(dense).cast(kind))

    return run


def slots(text: Column, dimension: int | Column, algorithm: str | Column = "word") -> Column:
    """What each token adds: array<int> of ``2 * component + (1 if negative)``; null where an argument is.

    Dimension and algorithm are checked when the call is made, or by row where they are columns."""
    if isinstance(dimension, int):
        resolve(algorithm if isinstance(algorithm, str) else "word", dimension)
    size = F.lit(dimension) if isinstance(dimension, int) else dimension
    if isinstance(algorithm, str):
        cut, known = tokens(text, resolve(algorithm, 1)), F.lit(True)
    else:
        low = F.lower(algorithm)
        wrong = fail(F.concat(F.lit("Unknown embedding algorithm '"), algorithm, F.lit(f"', expected one of: [{', '.join(ALGORITHMS)}]")))
        cut = F.when(~low.isin(*ALGORITHMS), wrong.cast("array<string>"))
        for n in ALGORITHMS:
            cut = cut.when(low == n, tokens(text, n))
        known = algorithm.isNotNull()

    def signed(w: Column) -> Column:
        s = slot(w, size)
        return s["i"] * 2 + F.when(s["sign"] < 0, 1).otherwise(0)

    beyond = fail(F.concat(F.lit(f"Vector dimension must be between 1 and {LARGEST}, got "), size)).cast("array<int>")
    return F.when(text.isNull() | size.isNull() | ~known, None).when((size < 1) | (size > LARGEST), beyond).otherwise(F.transform(cut, signed))


def dense(found: Column, dimension: int | Column, width: str = "float") -> Column:
    """The vector of a column of ``slots``, scaled to length 1; zeros without a token, null for null. One vectorised function."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)
    kind = pa.float32() if width == "float" else pa.float64()
    return F.arrow_udf(_scattered(kind), f"array<{width}>")(found, (F.lit(dimension) if isinstance(dimension, int) else dimension).cast("int"))
