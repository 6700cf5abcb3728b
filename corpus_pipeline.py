"""A corpus pipeline of five stages over ``documents``.

Each stage gets what its predecessor kept, as a table. The first four return the columns of documents, further ones
whatever their names included; the last one the tokens' digests.

Defined cases, in every stage: a null text counts as an empty one. It is not toxic; empty and white-space texts are exact
copies of each other, and near copies of nothing; they mix as one token and encode to none. Texts are read whole. A
document without an id is judged by its text like others in the toxicity stage, never goes as a copy of another, and draws
by the empty string in the mix. A row whose doc_id repeats goes or stays with its twin, also where their texts differ:
the copy stages drop ids. Ties go to the smaller id. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, minmax_dedup, mixing
from tidemark.llm import toxicity as tox
from tidemark.llm.common import table, written
from tidemark.llm.queries import vocabulary


def without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs less those whose verdict is not kept."""
    gone = verdicts.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tox.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, exact_dedup.exact_groups(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, minmax_dedup.near_groups(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("minmax_dedup", near), ("mixing", mix), ("bpe", tokens)]

#: Learned scores and min-max signatures are beyond SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
