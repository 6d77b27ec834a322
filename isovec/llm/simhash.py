"""SimHash near-duplicates (operator 9) with pigeonring filtering.

A bit of a text's fingerprint is 1 if more than half of its word shingles have it
set in their XXH64. Two fingerprints link at ``BUDGET`` or fewer differing bits.

Pigeonring: the 64 bits form a ring of ``SEGMENTS`` segments. If two fingerprints
differ in at most ``BUDGET`` bits, some segment starts a chain in which, for every
length, the first segments together differ in at most ``length * BUDGET /
SEGMENTS`` bits. As long as that is below 1 the segments are equal, so that the
first ``EXACT`` segments of a chain are a join key; the rest of the chain is
checked before the full distance.

Only distinct fingerprints are compared, so that copies cost nothing. A key held
by more than ``CROWD`` of them is not joined with itself: each of its
fingerprints emits the 65 values within one bit of it. Two lie within two bits
exactly if they share such a value, so that linking each to the least holder of
every value it emits joins the same components, with linear work.

Edge cases: null texts and texts without words have fingerprint 0 and link like
any other; very long texts are hashed whole; every row gives a row, also of a
null or repeated id; rows of null id get the component of their fingerprint, null
if none there has an id; an empty table gives an empty result; further columns of the input, also of clashing names, are
ignored by ``near_duplicates`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Isolated, lower_ascii, materialise, words
from .graph import connected_components

SHINGLE = 3
BUDGET = 2
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
EXACT = (SEGMENTS - 1) // BUDGET  # the longest chain whose budget is below 1
CROWD = 64


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def hashes(text: Column, size: int = SHINGLE) -> tuple[Column, Column]:
    """The words of a text, and from a column ``s_words`` the hashes of its shingles."""
    n = F.size("s_words")
    joined = F.transform(F.sequence(F.lit(0), n - size),
                         lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("s_words", i + k) for k in range(size)))))
    return words(lower_ascii(text)), (
        F.when(n >= size, joined).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", "s_words"))))
        .otherwise(F.array().cast("array<bigint>")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (a long) of every row.

    The bits are counted in one aggregation, all of whose sums are 64-bit
    integers, combined before the shuffle; a text's words never leave its task.
    Rows of one id and text in a partition of the input are counted together:
    all sums are then multiples of one text's, and give the same bits.
    """
    box = Isolated(docs)
    split, shingled = hashes(box["text"])
    rows = (box.df.select(box["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(box["text"], F.lit(""))).alias("s_text"),
                          F.spark_partition_id().alias("s_part"), split.alias("s_words"))
            .select("doc_id", "s_text", "s_part", F.posexplode_outer(shingled).alias("at", "h")))
    sums = rows.groupBy("doc_id", "s_text", "s_part").agg(
        F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("copies"), F.count("h").alias("n"), *(F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)))
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit(_signed(1 << b)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return (sums.select("doc_id", reduce(Column.bitwiseOR, bits).alias("fp"), "copies")
            .select("doc_id", "fp", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "fp"))


def _turned(fp: Column, segment: Column) -> Column:
    """The ring turned so that the segment comes first, in the lowest bits."""
    low = segment * WIDTH
    return F.when(segment == 0, fp).otherwise(
        F.expr("shiftrightunsigned(fp, CAST(s * %d AS INT)) | shiftleft(fp, CAST(64 - s * %d AS INT))" % (WIDTH, WIDTH)))


def links(distinct: DataFrame) -> DataFrame:
    """``a``, ``b``: links that connect just what all pairs within the budget would; ``distinct`` has ``fp``."""
    mask = (1 << WIDTH * EXACT) - 1
    ring = (distinct.select("fp", F.explode(F.array(*(F.lit(i) for i in range(SEGMENTS)))).alias("s"))
            .withColumn("turned", _turned(F.col("fp"), F.col("s")))
            .withColumn("key", F.col("turned").bitwiseAND(F.lit(mask)) + F.col("s") * F.lit(1 << 56)))
    held = ring.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(ring.join(held, "key").select("key", "fp", "turned", "n"), "simhash-keys")

    cold = shared.where(F.col("n") <= CROWD)
    x, y = cold.select("key", F.col("fp").alias("a"), F.col("turned").alias("ta")), cold.select("key", F.col("fp").alias("b"), F.col("turned").alias("tb"))
    differ = F.col("ta").bitwiseXOR(F.col("tb"))
    chain = reduce(Column.__and__, (
        F.bit_count(differ.bitwiseAND(F.lit((1 << WIDTH * length) - 1))) <= length * BUDGET // SEGMENTS for length in range(EXACT + 1, SEGMENTS)))
    close = x.join(y, (x["key"] == y["key"]) & (F.col("a") > F.col("b")) & chain & (F.bit_count(differ) <= BUDGET)).select("a", "b")

    balls = shared.where(F.col("n") > CROWD).select("fp").distinct().select(
        "fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in range(64)))).alias("point"))
    least = balls.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    crowded = balls.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return close.union(crowded)


def components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row."""
    held = materialise(fingerprints(docs), "simhash")
    distinct = held.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp")), "simhash-links")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialise(rooted.join(named, "root").select("fp", "component_id"), "simhash-components")
    return held.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that give their component its id, and all without an id."""
    box = Isolated(docs)
    gone = components(docs).where("doc_id <> component_id").select("doc_id")
    return box.restore(box.df.join(gone, box["doc_id"] == gone["doc_id"], "left_anti"))
