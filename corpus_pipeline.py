"""A filtering and packing pipeline over ``documents``, one operator a stage.

Each stage gets what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``; the last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isovec.llm import language_id, line_dedup, packing, quality_rules, simhash
from isovec.llm.common import materialise, table
from isovec.llm.queries import tokenizer_path


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the threshold table rejects go."""
    return quality_rules.filter_documents(docs)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose language is unknown or undecided go."""
    return language_id.filter_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of near-equal lines one stays; documents without any line left go."""
    return line_dedup.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group stays."""
    return simhash.filter_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents' pieces in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_by_rules),
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: SQL has neither the automata, nor MinHash, nor XXH64, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, writing and rereading each result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
