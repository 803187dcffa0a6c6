"""The corpus pipeline: quality rules, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of documents. run() writes each stage's rows as Parquet to the shared
folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, mixing, quality, sharding
from lodestone.llm.common import discard, put_back, set_aside, spool, table, words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the posterior rejects go."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; columns named like the mix's own come through as they are."""
    docs, own = set_aside(docs)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    mixed = mixing.mix(docs, words(F.col("text")), lambda size: mixing.quality_weight(F.col("text"), size), keep=rest).filter("copies > 0")
    mixed = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
    return put_back(mixed, own)


def uniform_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with shard and slot; columns that already have these names become shard_in and slot_in."""
    return sharding.hypergeometric_shuffle(docs, 24)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("uniform sharding", uniform_sharding),
]
#: Quality, near duplicates and sharding rest on models, hashes and draws that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
