"""Documents to tokens: language, exact and near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and is written to the
shared folder before the next reads it.

Defined results: a document with null, empty or wordless text has no language and goes in the first stage; of rows with
equal text the one with the largest id stays, of rows with equal text and id one; a null id is smaller than any other, and the rows of a near-duplicate group
whose id is the smallest stay; an empty table gives no rows; other columns pass through to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm import decontaminate, exact_dedup, langid
from wireloom.llm import near_copies as near_copies_of
from wireloom.llm.common import ready, stage, unused
from wireloom.llm.queries import token_digests

#: A document whose most frequent language covers less of its letters has no language; letters of words that no
#: learned language makes likely count as covered by none.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without letters, in unlearned scripts, of unlikely words or without a leading language go."""
    name = unused(docs, "_found")
    found = docs.withColumn(name, langid.labelled(docs, langid.fit_on_rest(docs)))
    stays = found.where((F.col(f"{name}.lang") != langid.UNDETERMINED) & (F.col(f"{name}.score") >= LEAST_SHARE))
    return stays.drop(name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.survivors(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by SimHash and Golay keys at a five-word similarity of 0.8, the one with the smallest id."""
    return near_copies_of.representatives(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return token_digests(docs)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: Language models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
