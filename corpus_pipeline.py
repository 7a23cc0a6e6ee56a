"""A corpus pipeline of five stages over ``documents``, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``; the last adds ``size``, ``shard`` and ``slot``.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables; what each does with them
stands with it. Further columns travel along, whatever their names: those of ``size``, ``shard`` and ``slot`` are replaced by
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontamination, mixing, ngram_jaccard, oracles, quality_rules, sharding
from weftline.llm.shared import new_path, read, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go; repeated rows go or stay alike."""
    return quality_rules.with_verdict(docs).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a Jaccard similarity of 0.8 or more link: that with the
    smallest id, and of rows that share it any one. Texts without words link with nothing and all stay; a null id counts as
    the hash of its text. Ids are whole numbers."""
    small_batches(spark)
    return ngram_jaccard.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null texts have none and stay; repeated rows go or stay alike."""
    small_batches(spark)
    found = decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"), remove="documents")
    return found.where("not contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is one of its own; null texts have no words and are
    taken as their source's whole repetitions say; repeated rows are taken alike, but for those at a source's cut."""
    small_batches(spark)
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot, in order of id, nulls first. Null texts count 8 bytes; repeated rows are rows of
    their own."""
    small_batches(spark)
    return sharding.shard(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_free), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = oracles.PIPELINE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
