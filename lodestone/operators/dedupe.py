"""Keep-first rules and the merge of repeated codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key by order, the other rows); a null key is a key."""
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").drop("_n")


def merge_first_known(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: of each column, the first value by order that isn't null."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
