"""Metric names. Only ``dot_product`` is higher for nearer vectors."""

from __future__ import annotations

from pyspark.sql import Column

from . import codes, exact

NAMES = ("euclidean", "euclidean_squared", "cosine", "dot_product", "manhattan")
_FUNCTION = {"euclidean": "euclidean_distance", "euclidean_squared": "euclidean_squared_distance", "cosine": "cosine_distance",
             "dot_product": "dot_product", "manhattan": "manhattan_distance"}


def resolve(name: str) -> str:
    found = name.lower() if isinstance(name, str) else None
    if found not in NAMES:
        raise ValueError(f"Unknown metric '{name}', expected one of: [{', '.join(NAMES)}]")
    return found


def higher_is_closer(name: str) -> bool:
    return resolve(name) == "dot_product"


def distance(name: str, x: Column, y: Column, bounds: Column | None = None, binary: bool = False) -> Column:
    """The metric on exact vectors, on one-byte codes (with ``bounds``) or on one-bit codes (``binary``)."""
    function = _FUNCTION[resolve(name)]
    if binary:
        return getattr(codes, f"int1_{function}")(x, y)
    if bounds is not None:
        return getattr(codes, f"int8_{function}")(x, y, bounds)
    return getattr(exact, function)(x, y)
