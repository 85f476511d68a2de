"""A corpus pipeline of five operators: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; a document that the mix takes twice is two rows.

Nulls are allowed in every column: a null text is an empty one, a null doc_id is a document by
itself, a null source is a source. Rows that repeat are judged alike by the quality and the
decontamination stage, and are one group in the near-dedup stage, of which one row stays. Texts of any
length are taken whole. Ties are settled by doc_id, then by the row's content. An empty table gives
empty results, and further columns of documents pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laminae.llm import hilbert, stages
from laminae.llm.durable import remove_table, write_table
from laminae.llm.tables import table

SHARDS = 8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the regularised quadratic discriminant rejects go."""
    return stages.keep_quality(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word shingles, similarity 0.8) the smallest doc_id stays."""
    return stages.keep_one_of_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of 10 words with a benchmark item go."""
    return stages.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as systematic sampling to the sources' targets takes them."""
    return stages.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows along a Hilbert curve in 8 shards of equal counts, with ``hilbert, shard, slot``."""
    return hilbert.document_shards(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharding),
]

#: Trained scores and a curve order are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's table goes when the next one's is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        before, path = path, write_table(stage(spark, docs, sf_dir))
        docs = spark.read.parquet(path)
        if before is not None:
            remove_table(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
