"""From raw documents to balanced shards: five stages, each written and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and, but
for the last, returns rows with the columns of documents: it filters them or,
in mixing, repeats them. The last returns where each row goes. Nulls, empty
texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from molsift.llm.common import read_table
from molsift.llm.decontaminate import keep_clean
from molsift.llm.jaccard_join import keep_one
from molsift.llm.mixing import mix_documents
from molsift.llm.quality_model import keep_good
from molsift.llm.sharding import shard
from molsift.session import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps."""
    return keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix of sources takes them."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shard(docs)


STAGES = [("quality_classifier", quality_classifier), ("ngram_jaccard_join", ngram_jaccard_join),
          ("benchmark_decontamination", benchmark_decontamination), ("source_mixing", source_mixing), ("sharding", sharding)]

#: Models, components and alignments have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
