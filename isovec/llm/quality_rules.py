"""Quality rules (operator 5): a threshold table compiled into one Spark projection.

Every metric is an expression over the document's own arrays: no shuffle, no
user functions. A rule bounds the percentage ``100 * numerator / denominator``
from below, above or both; it is compared by cross-multiplication in integers,
so that Spark and any SQL engine agree to the bit.

Edge cases: a null text counts as an empty one; an empty text has no words and
fails the base rule; every row is judged alone, so repeated rows and repeated
ids get equal verdicts; an empty table gives an empty result; further columns of
the input, also of clashing names, pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Isolated, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from or an at a "
    "der die das und ist den von zu mit sich des auf für nicht ein eine als auch dem "
    "de la que el en los del las un una por con para se su no es al lo y "
    "le les et du une est dans pour qui sur au ce il elle"
).split()


class Rule(NamedTuple):
    """``low <= 100 * numerator / denominator <= high``; a missing bound is open."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The production table. Metrics are the columns of ``metrics``; ``one`` is 1.
RULES = (
    Rule("length_words", "n_words", "one", 2000, None),
    Rule("word_length", "word_chars", "n_words", 250, 1000),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 10),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 3, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)


def sql_of(rule: Rule) -> str:
    """The rule as a boolean SQL expression, the same in Spark and DuckDB."""
    parts = []
    if rule.low is not None:
        parts.append(f"100 * {rule.numerator} >= {rule.low} * {rule.denominator}")
    if rule.high is not None:
        parts.append(f"100 * {rule.numerator} <= {rule.high} * {rule.denominator}")
    return "(" + " AND ".join(parts or ["true"]) + ")"


def verdict_sql(rules=RULES) -> str:
    return " AND ".join(sql_of(r) for r in rules) or "true"


BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def _long(column: Column) -> Column:
    return column.cast("long")


def metrics(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts which the rules use."""
    source = F.coalesce(text, F.lit(""))
    step = df.select(*keep, source.alias("q_text"), words(text).alias("q_words"),
                     F.filter(F.split(source, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("q_lines"))
    step = step.withColumn("q_hashes", F.transform("q_words", lambda w: F.xxhash64(w)))
    # A window's hash is built from those of its halves and quarters. A text without
    # an equal pair of four-word runs has no equal windows and stops there. Equal windows
    # have equal hashes; at 64 bits, a text of 10^6 words has others with odds of 1 in 3 * 10^7.
    none = F.array().cast("array<bigint>")

    def paired(of: str, gap: int, length: int) -> Column:
        return F.when(F.size("q_words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("q_words") - length),
            lambda i: F.xxhash64(F.get(of, i), F.get(of, i + gap)))).otherwise(none)

    step = step.withColumn("q_two", paired("q_hashes", 1, WINDOW // 4))
    step = step.withColumn("q_four", paired("q_two", WINDOW // 4, WINDOW // 2))
    step = step.withColumn("q_windows", F.when(
        F.size(F.array_distinct("q_four")) < F.size("q_four"), paired("q_four", WINDOW // 2, WINDOW)).otherwise(none))
    step = step.withColumn("q_sorted", F.when(
        F.size(F.array_distinct("q_windows")) < F.size("q_windows"),
        F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn("q_starts", F.when(F.col("q_sorted").isNotNull(), F.sort_array(F.filter(
        F.transform("q_sorted", lambda x, j: F.when(
            (F.get("q_sorted", j - 1)["h"] == x["h"]) | (F.get("q_sorted", j + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull()))))
    # Sorted window starts cover as many words as lie before the next start, WINDOW at most.
    step = step.withColumn("q_repeat", F.coalesce(F.aggregate(
        F.transform("q_starts", lambda p, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get("q_starts", j + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b), F.lit(0)))
    return step.select(
        *keep,
        _long(F.size("q_words")).alias("n_words"),
        _long(F.length(F.array_join("q_words", ""))).alias("word_chars"),
        _long(F.regexp_count("q_text", F.lit(SYMBOLS))).alias("n_symbols"),
        _long(F.size("q_lines") - F.size(F.array_distinct("q_lines"))).alias("n_dup_lines"),
        _long(F.col("q_repeat")).alias("n_repeat_words"),
        _long(F.regexp_count("q_text", F.lit("!"))).alias("n_exclamations"),
        _long(F.size(F.filter("q_words", lambda w: w.isin(*STOP_WORDS)))).alias("n_stop_words"),
        _long(F.size("q_lines")).alias("n_lines"),
        _long(F.size(F.filter("q_lines", lambda x: x.rlike("^[\\x20\\x09]*[-*•]")))).alias("n_bullet_lines"),
        _long(F.lit(1)).alias("one"),
        F.monotonically_increasing_id().alias("q_row"),
    )


def judge(df: DataFrame, text: Column, keep: list[str], rules=RULES) -> DataFrame:
    """``metrics`` with ``base_failed`` and ``kept``."""
    counted = metrics(df, text, keep).withColumn("base_failed", F.expr(BASE_FAILED))
    return counted.withColumn("kept", ~F.col("base_failed") & F.expr(verdict_sql(rules)))


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: ``doc_id``, the contract's counts, ``base_failed`` and ``kept``."""
    box = Isolated(docs)
    inner = box.df.select(box["doc_id"].alias("doc_id"), box["text"].alias("q_in"))
    return judge(inner, F.col("q_in"), ["doc_id"], rules).drop("one", "q_row")


def filter_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with."""
    box = Isolated(docs)
    judged = judge(box.df, box["text"], box.inner, rules)
    # The row number keeps the optimiser from moving the filter, and a copy of all metrics, below them.
    return box.restore(judged.where("kept AND q_row >= 0"))


METRICS_SQL = f"""
q_words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM {{source}}),
q_windows AS (SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS k FROM q_words, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)),
q_repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM q_windows) WHERE c > 1),
q_covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM q_repeated, range(0, {WINDOW}) AS r(j) GROUP BY doc_id),
q_metrics AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_exclamations,
         CAST(len(list_filter(ws, lambda w: list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], w))) AS BIGINT) AS n_stop_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
         CAST(1 AS BIGINT) AS one
  FROM q_words w LEFT JOIN q_covered c USING (doc_id)),
q_base AS (SELECT *, {BASE_FAILED} AS base_failed FROM q_metrics),
q_judged AS (SELECT *, NOT base_failed AND {verdict_sql()} AS kept FROM q_base)
"""

ORACLE_SQL = f"WITH {METRICS_SQL.replace('{source}', 'documents').strip()} SELECT * EXCLUDE (one) FROM q_judged"
