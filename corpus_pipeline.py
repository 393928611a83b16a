"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peoplelens.llm import decontaminate, language, line_dedup, near_texts, packing
from peoplelens.llm.common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told; fitted on the labelled languages of this stage's own input."""
    return language.accepted(docs, language.fit(docs.filter("lang IS NOT NULL")))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop boilerplate lines. ``n_chars`` follows the text; every document stays."""
    kept = line_dedup.drop_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, the one with the smallest id: texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more, and all that such pairs join. SimHash links (op6) are tried first, then what two bits cannot reach; whole sets
    confirm both. Repeated and absent ids make no difference to that."""
    return near_texts.keep_one(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of words packed into bins: one row per piece of a document."""
    return packing.pack(docs, packing.word_count(F.col("text")))


STAGES = [
    ("language", identify_language),
    ("line_dedup", remove_boilerplate),
    ("near_dedup", remove_near_duplicates),
    ("decontaminate", remove_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Language ID, similar sets and packing cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
