"""Document fingerprints (operator 4) by consistent weighted sampling.

A text's terms are its words, weighted by how often they occur. For each of
``SAMPLES`` samples every term draws, from its hash alone, ``r`` and ``c`` from
Gamma(2, 1) and ``b`` from the unit interval; with weight ``w`` it takes the step
``t = floor(ln w / r + b)`` and the value ``c * exp(-r * (t - b + 1))``. The least
value is the sample. Two texts have it in common with the probability of their
generalised Jaccard similarity, sum of lesser weights by sum of greater ones.
The value depends on the term and its step only, so that it names the sample.

All of it is built-in expressions. Texts are shuffled once, by id; the terms of a
text stay in its task, where they are counted and reduced to the samples. The
next document's share is cut to the characters needed before it is shuffled.
The order of ids is found in ``BLOCKS`` ranges of about equal counts, each of
which orders its own ids; the driver sees the first id of each range.

Edge cases: a null text counts as empty; a text without words has the
fingerprint of zeros, like any other such text (1) and unlike all others (0); a
row of null id has no next document, that is an empty one; of several rows of an
id, each gets a row and the one of the least digest is what the preceding document
sees; long texts are taken whole, their words counted by hash aggregation, which spills; a single document is its own next; an empty table gives an empty result;
further columns of the input, also of clashing names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Isolated, materialise, words

SAMPLES = 64
BLOCKS = 256
NAMES = [f"v{k}" for k in range(SAMPLES)]


def _unit(bits: Column, width: int) -> Column:
    return (bits.cast("double") + 0.5) / float(1 << width)


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """The term's value in sample ``k``, as ``c * exp(-r * (t - b + 1))``, which orders like its logarithm.

    21 bits make each of the two uniforms of r, 22 that of b, 32 those of c."""
    one = F.xxhash64(term, F.lit(k))
    two = F.xxhash64(one)
    r = -F.ln(_unit(F.shiftrightunsigned(one, 43), 21) * _unit(F.shiftrightunsigned(one, 22).bitwiseAND(F.lit((1 << 21) - 1)), 21))
    b = _unit(one.bitwiseAND(F.lit((1 << 22) - 1)), 22)
    c = -F.ln(_unit(F.shiftrightunsigned(two, 32), 32) * _unit(two.bitwiseAND(F.lit((1 << 32) - 1)), 32))
    return c * F.exp(-r * (F.floor(log_weight / r + b) - b + 1))


def signatures(texts: DataFrame, key: list[str], sides: tuple[str, str]) -> DataFrame:
    """``key``, ``side`` (0, 1) and the sample values of each of the two text columns ``sides``; no row where there is no word.

    A term of equal weight in both, such as the words that an edit leaves, draws its samples once (side 2 until the end).
    If ``texts`` is partitioned by a part of ``key``, nothing is shuffled."""
    terms = texts.select(*key, F.inline(F.array(*(F.struct(F.lit(i).alias("side"), words(F.col(c)).alias("ws")) for i, c in enumerate(sides)))))
    counted = (terms.select(*key, "side", F.explode("ws").alias("w")).select(*key, "side", F.xxhash64("w").alias("term"))
               .groupBy(*key, "term").agg(F.sum(1 - F.col("side")).alias("m"), F.sum("side").alias("n")))

    def weighed(side: int, weight: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.ln(F.col(weight).cast("double")).alias("lw"))

    m, n = F.col("m"), F.col("n")
    drawn = counted.select(*key, "term", F.inline(F.when(m == n, F.array(weighed(2, "m"))).when(n == 0, F.array(weighed(0, "m")))
                                                  .when(m == 0, F.array(weighed(1, "n"))).otherwise(F.array(weighed(0, "m"), weighed(1, "n")))))
    least = drawn.groupBy(*key, "side").agg(*(F.min(sample_value(F.col("term"), F.col("lw"), k)).alias(NAMES[k]) for k in range(SAMPLES)))
    both = F.when(F.col("side") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array("side"))
    return least.select(*key, F.explode(both).alias("to"), *NAMES).groupBy(*key, F.col("to").alias("side")).agg(*(F.min(n).alias(n) for n in NAMES))


def _mark(text: str) -> Column:
    """Names one of the rows of an id by what it holds, which holds however often and in whatever order it is read."""
    return F.xxhash64(text)


def ordered(known: DataFrame) -> DataFrame:
    """``doc_id``, ``uid``, ``half``, ``next_id``, ``next_uid``: each id, the mark of its row and of the next document's, ids descending."""
    ids = materialise(known.groupBy("doc_id").agg(F.min(_mark("text")).alias("uid"), F.max(F.floor(F.length("text") / 2)).cast("int").alias("half")),
                      "fingerprint-ids")
    cuts = ids.agg(F.percentile_approx("doc_id", [k / BLOCKS for k in range(1, BLOCKS)])).first()[0] or []
    block = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    dealt = ids.withColumn("block", block)
    first = {r["block"]: r["head"] for r in dealt.groupBy("block").agg(F.max(F.struct("doc_id", "uid")).alias("head")).collect()}
    falling = sorted(first, reverse=True)
    after = {b: first[falling[(k + 1) % len(falling)]] for k, b in enumerate(falling)}
    if not after:
        return ids.select("*", F.col("doc_id").alias("next_id"), F.col("uid").alias("next_uid"))
    follow = F.lead(F.struct("doc_id", "uid")).over(Window.partitionBy("block").orderBy(F.col("doc_id").desc()))

    def wrapped(field: str) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for b, head in after.items() for x in (b, head[field]))), F.col("block")).cast("long")

    seen = dealt.withColumn("follow", follow)
    return materialise(seen.select("doc_id", "uid", "half", F.coalesce("follow.doc_id", wrapped("doc_id")).alias("next_id"),
                                   F.coalesce("follow.uid", wrapped("uid")).alias("next_uid")), "fingerprint-order")


def edited(text: Column, head: Column) -> Column:
    """The last half, rounded down, replaced by as many characters of ``head``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(head, F.lit(1), half))


def _hex(codes: str) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), "")


def _likeness(a: str, b: str) -> Column:
    return reduce(Column.__add__, (F.when(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), 1).otherwise(0) for k in range(SAMPLES))) / float(SAMPLES)


def _described(paired: DataFrame) -> DataFrame:
    """``doc_id``, ``mark``, ``n_chars``, ``edited_sha256``, ``own``, ``changed`` (codes) of rows with ``text`` and ``head``."""
    both = paired.select("doc_id", "uid", "text", edited(F.col("text"), F.col("head")).alias("edit"))
    found = signatures(both, ["doc_id", "uid"], ("text", "edit"))
    facts = both.select("doc_id", "uid", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), _mark("text").alias("mark"))
    # The lower 32 bits, as an array a side: a column a sample and side would be more than Spark compiles.
    coded = found.select("doc_id", "uid", "side", F.array(*(
        F.shiftright(F.shiftleft(F.xxhash64(n), 32), 32).cast("int") for n in NAMES)).alias("codes"))
    sides = coded.groupBy("doc_id", "uid").agg(*(F.max(F.when(F.col("side") == i, F.col("codes"))).alias(p) for i, p in enumerate(("own", "changed"))))
    none = F.array(*[F.lit(0)] * SAMPLES)
    return facts.join(sides, ["doc_id", "uid"], "left").select("doc_id", "mark", "n_chars", "edited_sha256", *(F.coalesce(p, none).alias(p) for p in ("own", "changed")))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    box = Isolated(docs)
    rows = box.df.select(box["doc_id"].cast("long").alias("doc_id"), F.coalesce(box["text"], F.lit("")).alias("text"),
                         F.monotonically_increasing_id().alias("uid"))
    known = rows.where("doc_id IS NOT NULL")
    order = ordered(known)
    wanted = order.select(F.col("doc_id").alias("to_id"), "half", F.col("next_id").alias("doc_id"), "next_uid")
    # The row is chosen by a difference, which keeps the id the only join key, and uid (never
    # negative) is looked at, so that this side reads the very shuffle of texts that the next join reads.
    seen = F.when(F.col("uid") < 0, F.col("next_uid")).otherwise(_mark("text"))
    heads = (known.join(wanted, "doc_id").where(seen - F.col("next_uid") == 0)
             .select("to_id", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head")).groupBy("to_id").agg(F.min("head").alias("head")))
    paired = known.join(heads, known["doc_id"] == heads["to_id"], "left").select("doc_id", "uid", "text", F.coalesce("head", F.lit("")).alias("head"))
    # The ids of the null rows lie in no order, and their rows are few or none: they go their own way.
    lone = rows.where("doc_id IS NULL").select("doc_id", "uid", "text", F.lit("").alias("head"))
    held = materialise(_described(paired), "fingerprints")
    alone = _described(lone.withColumn("doc_id", F.lit(0).cast("long"))).withColumn("doc_id", F.lit(None).cast("long"))
    following = order.join(held.select(F.col("doc_id").alias("next_id"), F.col("mark").alias("next_uid"), F.col("own").alias("next_own"))
                           .dropDuplicates(["next_id", "next_uid"]), ["next_id", "next_uid"]).select("doc_id", "next_own")
    none = F.array(*[F.lit(0)] * SAMPLES)
    whole = held.join(following, "doc_id", "left").union(alone.withColumn("next_own", none))
    return whole.select("doc_id", "n_chars", "edited_sha256", _hex("own").alias("fingerprint"), _hex("changed").alias("edited_fingerprint"),
                        _likeness("own", "changed").alias("near_edited"), _likeness("own", "next_own").alias("near_next"))
