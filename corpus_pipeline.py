"""A training corpus in five stages: toxicity, quality rules, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` applies them to ``documents``;
between stages the rows are written as Parquet in the checkpoint folder and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hushframe.session import checkpoint_dir
from llm import jaccard, packing, quality, substrings, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model predicts toxic go; it learns from the labels of the documents at hand."""
    return toxicity.keep(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the repetition coverage rejects go."""
    return quality.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id stays."""
    return jaccard.keep_one(docs)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds are cut out of the texts; every document stays."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the texts and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("quality rules", poor_out),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", passages_out),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A learned model and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
