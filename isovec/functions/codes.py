"""One-byte and one-bit quantisation, and the metrics on codes, as Catalyst expressions.

Bounds are ``struct<offsets: array<double>, scale: double>``. A one-byte code is an
array of tinyint. A one-bit code is binary: the dimension in four bytes, most
significant first, then the bits, least significant first, padded with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import INFINITY, NO_MAGNITUDE, SAME_LENGTH, _dot, bind, doubles, fail, has_null, paired

NOT_BINARY = "The value is not a binary vector"


def _rounded(q: Column) -> Column:
    """Half up; what is no number is 0, and what lies far outside is cut before it is cast."""
    near = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), q))
    whole = F.floor(near).cast("double")
    return F.when(F.isnan(q), F.lit(0.0)).otherwise(whole + F.when(near - whole >= 0.5, 1.0).otherwise(0.0))


def _fitted(x: Column, bounds: Column) -> tuple[Column, Column]:
    message = F.concat(F.lit("The vector has "), F.size(x), F.lit(" components but the quantisation bounds were fitted on "),
                       F.size(bounds["offsets"]))
    return F.size(x) != F.size(bounds["offsets"]), fail(message)


def _encoded(x: Column, bounds: Column, kind: str, value: Column) -> Column:
    wrong, error = _fitted(x, bounds)
    return F.when(x.isNull() | bounds.isNull(), None).when(wrong, error.cast(kind)).when(has_null(x), None).otherwise(value)


def quantize_int8(x: Column, bounds: Column) -> Column:
    def code(v: Column, o: Column) -> Column:
        q = F.when(bounds["scale"] == 0, F.lit(0.0)).otherwise((v - o) / bounds["scale"])
        return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), _rounded(q))).cast("tinyint")

    return _encoded(x, bounds, "array<tinyint>", F.zip_with(doubles(x), bounds["offsets"], code))


def dequantize_int8(code: Column, bounds: Column) -> Column:
    return F.zip_with(code, bounds["offsets"], lambda c, o: o + c.cast("double") * bounds["scale"])


def quantize_int1(x: Column, bounds: Column) -> Column:
    bits = F.zip_with(doubles(x), bounds["offsets"], lambda v, o: F.when((v >= o) & ~F.isnan(v) & ~F.isnan(o), 1).otherwise(0))

    def packed(b: Column) -> Column:
        octet = lambda j: sum((F.shiftleft(F.coalesce(F.get(b, j * 8 + i), F.lit(0)), i) for i in range(1, 8)),
                              F.coalesce(F.get(b, j * 8), F.lit(0)))
        octets = F.when(F.size(b) == 0, F.lit("")).otherwise(F.array_join(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(b) - 1) / 8).cast("int")), lambda j: F.lpad(F.hex(octet(j)), 2, "0")), ""))
        return F.unhex(F.concat(F.lpad(F.hex(F.size(b)), 8, "0"), octets))

    return _encoded(x, bounds, "binary", bind(bits, packed))


def _integers(x: Column, y: Column, each) -> Column:
    """A sum over differences of codes, in 64 bits."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: each(a.cast("bigint") - b.cast("bigint"))), F.lit(0).cast("bigint"), lambda s, v: s + v)


def _on_codes(x: Column, y: Column, bounds: Column, value: Column) -> Column:
    return F.when(bounds.isNull(), None).otherwise(paired(x, y, value, _fitted(x, bounds)))


def int8_euclidean_squared_distance(x: Column, y: Column, bounds: Column) -> Column:
    return _on_codes(x, y, bounds, bounds["scale"] * bounds["scale"] * _integers(x, y, lambda d: d * d))


def int8_euclidean_distance(x: Column, y: Column, bounds: Column) -> Column:
    return _on_codes(x, y, bounds, F.abs(bounds["scale"]) * F.sqrt(_integers(x, y, lambda d: d * d).cast("double")))


def int8_manhattan_distance(x: Column, y: Column, bounds: Column) -> Column:
    return _on_codes(x, y, bounds, F.abs(bounds["scale"]) * _integers(x, y, F.abs))


def int8_dot_product(x: Column, y: Column, bounds: Column) -> Column:
    return _on_codes(x, y, bounds, _dot(dequantize_int8(x, bounds), dequantize_int8(y, bounds)))


def int8_cosine_similarity(x: Column, y: Column, bounds: Column) -> Column:
    """An error where a vector decodes to zeros; what bounds of extreme scale give is passed on."""

    def of(s: Column) -> Column:
        product = s["x"] * s["y"]
        lost = F.when(s["d"] == 0, float("nan")).otherwise(F.signum(s["d"]) * INFINITY)  # each magnitude counts, their product is too small
        return (F.when((s["x"] == 0) | (s["y"] == 0), fail(NO_MAGNITUDE).cast("double")).when(product == 0, lost)
                .otherwise(s["d"] / F.sqrt(product)))

    u, v = dequantize_int8(x, bounds), dequantize_int8(y, bounds)
    return _on_codes(x, y, bounds, bind(F.struct(_dot(u, v).alias("d"), _dot(u, u).alias("x"), _dot(v, v).alias("y")), of))


def int8_cosine_distance(x: Column, y: Column, bounds: Column) -> Column:
    return 1 - int8_cosine_similarity(x, y, bounds)


def _number(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def dimension(code: Column) -> Column:
    """The dimension of a one-bit code; an error where the value is none. A longer payload is tolerated."""
    claimed = _number(F.substring(code, 1, 4))
    bad = F.octet_length(code) < 4
    return (F.when(code.isNull(), None).when(bad, fail(NOT_BINARY).cast("bigint"))
            .otherwise(bind(claimed, lambda d: F.when((d >= 1 << 31) | (F.octet_length(code) - 4 < F.ceil(d / 8)),
                                                      fail(NOT_BINARY).cast("bigint")).otherwise(d))))


def hamming_distance(x: Column, y: Column) -> Column:
    """Differing components, as bigint. Seven bytes at a time fit a signed number; padding is not counted."""

    def of(d: Column) -> Column:
        octets = F.ceil(d["x"] / 8).cast("int")

        def part(j: Column) -> Column:
            size = F.least(F.lit(7), octets - j * 7)
            piece = lambda c: _number(c.substr(F.lit(5) + j * 7, size))
            return F.bit_count(piece(x).bitwiseXOR(piece(y))).cast("bigint")

        last = lambda c: _number(c.substr(F.lit(4) + octets, F.lit(1)))
        used = (d["x"] % 8).cast("int")
        padding = F.when(used == 0, F.lit(0)).otherwise(F.bit_count(F.floor(last(x).bitwiseXOR(last(y)) / F.pow(F.lit(2), used))))
        every = F.aggregate(F.transform(F.sequence(F.lit(0), F.floor((octets - 1) / 7).cast("int")), part),
                            F.lit(0).cast("bigint"), lambda a, b: a + b)
        return (F.when(d["x"] != d["y"], fail(SAME_LENGTH).cast("bigint")).when(d["x"] == 0, F.lit(0).cast("bigint"))
                .otherwise(every - padding.cast("bigint")))

    both = F.struct(dimension(x).alias("x"), dimension(y).alias("y"))
    return F.when(x.isNull() | y.isNull(), None).otherwise(bind(both, of))


def int1_euclidean_distance(x: Column, y: Column) -> Column:
    return 2 * F.sqrt(hamming_distance(x, y).cast("double"))


def int1_euclidean_squared_distance(x: Column, y: Column) -> Column:
    return 4.0 * hamming_distance(x, y)


def int1_manhattan_distance(x: Column, y: Column) -> Column:
    return 2.0 * hamming_distance(x, y)


def int1_dot_product(x: Column, y: Column) -> Column:
    return dimension(x) - 2.0 * hamming_distance(x, y)


def int1_cosine_similarity(x: Column, y: Column) -> Column:
    def of(s: Column) -> Column:
        return F.when(s["h"].isNull(), None).when(s["d"] == 0, fail(NO_MAGNITUDE).cast("double")).otherwise((s["d"] - 2.0 * s["h"]) / s["d"])

    return bind(F.struct(hamming_distance(x, y).alias("h"), dimension(x).alias("d")), of)


def int1_cosine_distance(x: Column, y: Column) -> Column:
    return 1 - int1_cosine_similarity(x, y)
