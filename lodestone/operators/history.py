"""Versions of keyed records over time: changes are merged into intervals, and facts find the version of their day.

A history has (key, attributes, effective_from, effective_to, is_current); an interval holds from its first day up to, not
including, effective_to, which is null for the version that still holds. The intervals of a key don't overlap and leave no gap after its first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import record_hash

INTERVAL = ("effective_from", "effective_to", "is_current")


def merge_changes(history: DataFrame, changes: DataFrame, key: str, stamp: str, attributes: Sequence[str], order: str) -> DataFrame:
    """history after changes (key, attributes, stamp: the day from which they hold, order).

    A change that says what its key's version says anyway does nothing; another one closes that version and opens its own. A late one,
    of a day before the last version, takes its place among the versions by its day. Of several changes of a day the last by order counts, and it replaces
    a version of the same day. Changes without a key or a day are not of use. Only keys that have changes are worked out anew.
    """
    said = changes.filter(F.col(key).isNotNull() & F.col(stamp).isNotNull()).select(key, *attributes, F.col(stamp).cast("date").alias("effective_from"), F.lit(1).alias("_new"), F.col(order).alias("_order"))
    touched = said.select(key).distinct()
    held = history.join(touched, key, "left_semi").select(key, *attributes, "effective_from", F.lit(0).alias("_new"), F.lit(None).cast(said.schema["_order"].dataType).alias("_order"))
    digest = record_hash(attributes)
    day = W.partitionBy(key, "effective_from").orderBy(F.desc("_new"), F.desc_nulls_last("_order"), F.desc("_digest"))
    x = held.unionByName(said).withColumn("_digest", digest).withColumn("_n", F.row_number().over(day)).filter("_n = 1")
    line = W.partitionBy(key).orderBy("effective_from")
    x = x.withColumn("_before", F.lag("_digest").over(line)).filter("NOT (_digest <=> _before)")
    x = x.withColumn("effective_to", F.lead("effective_from").over(line)).withColumn("is_current", F.col("effective_to").isNull())
    rest = history.join(touched, key, "left_anti").select(key, *attributes, *INTERVAL)
    return rest.unionByName(x.select(key, *attributes, *INTERVAL))


def version_name(key: str) -> Column:
    """A version's natural key, for a registry: later merges may close or split its interval, but its key and first day stay."""
    return F.concat_ws("@", F.col(key), F.col("effective_from").cast("string"))


def lookup_as_of(facts: DataFrame, column: str, day: str, versions: DataFrame, key: str, surrogate: str, alias: str, unknown: int = -1) -> DataFrame:
    """facts with the surrogate key of the version that held on its day as alias; unknown for a null, for an unheard-of key and for a day before its first version. A fact stays one row, as intervals of a key don't overlap."""
    found = versions.select(F.col(key).alias("_key"), F.col("effective_from").alias("_a"), F.col("effective_to").alias("_b"), F.col(surrogate).alias("_surrogate"))
    at = F.col(day).cast("date")
    holds = (facts[column] == F.col("_key")) & (at >= F.col("_a")) & (F.col("_b").isNull() | (at < F.col("_b")))
    return facts.join(found, holds, "left").withColumn(alias, F.coalesce("_surrogate", F.lit(unknown))).drop("_key", "_a", "_b", "_surrogate")
