"""A training corpus from ``documents``: quality, near duplicates, benchmark items, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet into the shared checkpoint folder and reads it again as the next stage's ``docs``. A stage's
files go once the next one's are written, the last ones' when the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.decontamination import clean_documents
from quarry.llm.mixing import mix_documents
from quarry.llm.ngram_join import keep_one
from quarry.llm.quality_rules import keep_good
from quarry.llm.sharding import shard_documents
from quarry.session import remove, scratch, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets with a similarity of 0.8 or more."""
    return keep_one(docs, k=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A budget of as many words as there are, no source more than twice; files hold whole blocks of the mixture."""
    return mix_documents(docs, entropy_share=0.97, max_repetition=2.0)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, shards=16)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: The stages draw and place documents by hashes that DuckDB lacks; a test holds ``run`` against plain loops over all documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        path = scratch(spark, "corpus")
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
