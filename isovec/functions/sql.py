"""The SQL surface: the functions under their names, for ``spark.sql``.

One name serves vectors of float and double, one-byte codes (with bounds as third
argument) and one-bit codes, so the functions are told apart by the Arrow types
they get and work on whole batches with NumPy. Column builders
(``functions.exact``, ``functions.codes``) stay inside Catalyst and are the choice
where no SQL text is involved.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from ..shipping import ship
from . import embed
from .codes import NOT_BINARY
from .exact import NO_MAGNITUDE, SAME_LENGTH

METRICS = ("euclidean_distance", "euclidean_squared_distance", "manhattan_distance", "dot_product", "cosine_similarity", "cosine_distance")


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as doubles; a null component is told by an object array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [None] * len(column)
    if column.flatten().null_count == 0:
        flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in column)])
        return [flat[offsets[k]:offsets[k + 1]] if x.is_valid else None for k, x in enumerate(column)]
    return [None if x is None else (np.array(x, object) if None in x else np.array(x, np.float64)) for x in column.to_pylist()]


def _cosine(x: np.ndarray, y: np.ndarray, rescue: bool) -> float:
    with np.errstate(all="ignore"):
        d, product = x @ y, (x @ x) * (y @ y)
        if not rescue:
            if x @ x == 0 or y @ y == 0:
                raise ValueError(NO_MAGNITUDE)
            return float(d / np.sqrt(product))
        if np.isfinite(product) and product != 0 and np.isfinite(d):
            return float(d / np.sqrt(product))
        m, n = np.abs(x).max(initial=0), np.abs(y).max(initial=0)
        if m == 0 or n == 0:
            raise ValueError(NO_MAGNITUDE)
        if not (np.isfinite(m) and np.isfinite(n)):
            return float("nan")
        x, y = x / m, y / n
        return float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))


def _of(name: str, x: np.ndarray, y: np.ndarray, rescue: bool = True) -> float:
    if name == "dot_product":
        return float(x @ y)
    if name.startswith("cosine"):
        s = _cosine(x, y, rescue)
        return 1 - s if name == "cosine_distance" else s
    d = x - y
    if name == "manhattan_distance":
        return float(np.abs(d).sum())
    return float(d @ d) if name == "euclidean_squared_distance" else float(np.sqrt(d @ d))


def _bits(code: bytes) -> tuple[int, int]:
    """The dimension, and the used bits as one number."""
    size = int.from_bytes(code[:4], "big")
    if len(code) < 4 or size >= 1 << 31 or len(code) - 4 < -(-size // 8):
        raise ValueError(NOT_BINARY)
    return size, int.from_bytes(code[4:4 + -(-size // 8)], "little") & ((1 << size) - 1)


def _hamming(x: bytes, y: bytes) -> tuple[int, int]:
    (n, a), (m, b) = _bits(x), _bits(y)
    if n != m:
        raise ValueError(SAME_LENGTH)
    return n, (a ^ b).bit_count()


def _binary(name: str, x: bytes, y: bytes) -> float:
    n, h = _hamming(x, y)
    if name.startswith("cosine"):
        if n == 0:
            raise ValueError(NO_MAGNITUDE)
        return (n - 2 * h) / n if name == "cosine_similarity" else 1 - (n - 2 * h) / n
    return {"euclidean_distance": 2 * h**0.5, "euclidean_squared_distance": 4.0 * h, "manhattan_distance": 2.0 * h, "dot_product": float(n - 2 * h)}[name]


def _fits(x: np.ndarray, offsets: np.ndarray) -> None:
    if len(x) != len(offsets):
        raise ValueError(f"The vector has {len(x)} components but the quantisation bounds were fitted on {len(offsets)}")


def _metric(name: str):
    def run(*args: pa.Array) -> pa.Array:
        if pa.types.is_binary(args[0].type) or pa.types.is_large_binary(args[0].type):
            pairs = zip(args[0].to_pylist(), args[1].to_pylist(), strict=True)
            return pa.array([None if x is None or y is None else _binary(name, x, y) for x, y in pairs], pa.float64())
        bounds = args[2].to_pylist() if len(args) > 2 else [()] * len(args[0])
        out = []
        for x, y, b in zip(_vectors(args[0]), _vectors(args[1]), bounds, strict=True):
            if x is None or y is None or b is None:
                out.append(None)
                continue
            if len(x) != len(y):
                raise ValueError(SAME_LENGTH)
            if b:
                _fits(x, b["offsets"])
            if x.dtype == object or y.dtype == object:
                out.append(None)
            elif not b:
                out.append(_of(name, x, y))
            elif name in ("dot_product", "cosine_similarity", "cosine_distance"):
                o = np.array(b["offsets"])
                out.append(_of(name, o + x * b["scale"], o + y * b["scale"], False))
            else:
                out.append(_of(name, x, y) * (b["scale"] ** 2 if "squared" in name else abs(b["scale"])))
        return pa.array(out, pa.float64())

    return run


def _hamming_distance(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else _hamming(a, b)[1] for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int64())


def _norm_of(x: np.ndarray) -> float:
    with np.errstate(all="ignore"):
        s = x @ x
        if s == 0 or np.isinf(s):
            m = np.abs(x).max(initial=0)
            return float(m if m == 0 or not np.isfinite(m) else m * np.sqrt((x / m) @ (x / m)))
        return float(np.sqrt(s))


def _l2_norm(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None or v.dtype == object else _norm_of(v) for v in _vectors(x)], pa.float64())


def _normalize(x: pa.Array) -> pa.Array:
    out = []
    for v in _vectors(x):
        if v is None or v.dtype == object:
            out.append(None)
            continue
        n = _norm_of(v)
        if n == 0:
            raise ValueError(NO_MAGNITUDE)
        out.append(v / n)
    return pa.array(out, pa.list_(pa.float64()))


def _quantized(encode):
    def rows(x: pa.Array, bounds: pa.Array) -> list:
        out = []
        for v, b in zip(_vectors(x), bounds.to_pylist(), strict=True):
            if v is None or b is None:
                out.append(None)
                continue
            _fits(v, b["offsets"])
            out.append(None if v.dtype == object else encode(v, np.array(b["offsets"], np.float64), b["scale"]))
        return out

    return rows


def _int8(v: np.ndarray, offsets: np.ndarray, scale: float) -> np.ndarray:
    q = np.nan_to_num(np.clip((v - offsets) / scale, -1000, 1000)) if scale else np.zeros(len(v))
    whole = np.floor(q)
    return np.clip(whole + (q - whole >= 0.5), -128, 127).astype(np.int8)


def _int1(v: np.ndarray, offsets: np.ndarray, scale: float) -> bytes:
    return len(v).to_bytes(4, "big") + np.packbits(v >= offsets, bitorder="little").tobytes()


def _tokens(text: str, algorithm: str) -> list[str]:
    low = "".join(c.lower() if len(c.lower()) == 1 else {"İ": "i"}.get(c, c) for c in text)
    if algorithm == "word":
        return re.findall(r"\w+", "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in low))
    n = int(algorithm[5])
    return [low[k:k + n] for k in range(len(low) - n + 1)]


def _embedding(kind: pa.DataType):
    def run(text: pa.Array, dimension: pa.Array, algorithm: pa.Array) -> pa.Array:
        out = []
        for t, n, a in zip(text.to_pylist(), dimension.to_pylist(), algorithm.to_pylist(), strict=True):
            if t is None or n is None or a is None:
                out.append(None)
                continue
            v = np.zeros(n) if 1 <= n <= embed.LARGEST else None
            for token in _tokens(t, embed.resolve(a, n)):
                h = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))
                v[(h >> 32) * n >> 32] += -1 if h >> 31 & 1 else 1
            s = v @ v
            out.append(v * (1 / np.sqrt(s)) if s else v)
        return pa.array(out, pa.list_(pa.float64())).cast(pa.list_(kind))

    return run


def register(spark: SparkSession) -> None:
    """Registers every function and alias as a temporary function of the session."""
    ship(spark)

    def add(names: tuple[str, ...], function, kind: str) -> None:
        for name in names:
            spark.udf.register(name, arrow_udf(function, kind))

    for name in METRICS:
        add((name,), _metric(name), "double")
    add(("hamming_distance",), _hamming_distance, "bigint")
    add(("l2_norm",), _l2_norm, "double")
    add(("normalize_vector",), _normalize, "array<double>")

    def tiny(x: pa.Array, bounds: pa.Array) -> pa.Array:
        return pa.array(_quantized(_int8)(x, bounds), pa.list_(pa.int8()))

    def binary(x: pa.Array, bounds: pa.Array) -> pa.Array:
        return pa.array(_quantized(_int1)(x, bounds), pa.binary())

    add(("quantize_vector_tinyint", "quantize_vector_int8"), tiny, "array<tinyint>")
    add(("quantize_vector_varbinary", "quantize_vector_binary", "quantize_vector_int1"), binary, "binary")
    add(("to_vector_real", "to_vector_fp32"), _embedding(pa.float32()), "array<float>")
    add(("to_vector_double", "to_vector_fp64"), _embedding(pa.float64()), "array<double>")
