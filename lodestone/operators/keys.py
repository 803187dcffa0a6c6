"""Surrogate keys that never change, unknown members, and key lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from ..sources.stored import stored

UNKNOWN_KEY, UNKNOWN_NAME = -1, "UNKNOWN"


def assign_keys(natural: DataFrame, registry: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """registry (name, surrogate_key) with keys for the new values of natural, numbered in order after the largest."""
    top = registry.agg(F.coalesce(F.greatest(F.max("surrogate_key"), F.lit(0)), F.lit(0)).alias("_top"))
    return registry.select(name, "surrogate_key").unionByName(new_keys(natural, registry, name, top, parts))


def new_keys(natural: DataFrame, registry: DataFrame, name: str, top: DataFrame, parts: int | None = None) -> DataFrame:
    """(name, surrogate_key) of the values of natural that registry lacks, numbered in order after top (one row, _top).

    New values are split into ranges by their order and stored with their range, so that counting and
    numbering see the same ranges; they are counted per range, and numbered inside each: no task gets them all.
    """
    new = natural.select(name).filter(F.col(name).isNotNull()).distinct().join(registry, name, "left_anti")
    parts = parts or int(natural.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(new.repartitionByRange(parts, name).withColumn("_part", F.spark_partition_id()), "keys")
    counts = ranged.groupBy("_part").count()
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    number = F.row_number().over(W.partitionBy("_part").orderBy(name))
    keyed = ranged.join(F.broadcast(offsets), "_part").crossJoin(F.broadcast(top))
    return keyed.select(name, (F.col("_top") + F.col("_from") + number).cast("int").alias("surrogate_key"))


class LastingKeys:
    """Registries that outlive a run: below root, a ledger of commits for each dimension; a commit names the folders that hold its keys, and the largest of them.

    Of two writers that number new values at once, one gets the commit; the other sees that, and numbers what is still
    missing after the keys that the first gave out. No key is ever given twice, or changed.
    """

    def __init__(self, spark: SparkSession, root: str, compact: int = 16) -> None:
        self.spark, self.root, self.compact = spark, root.rstrip("/"), compact

    def _ledger(self, dimension: str) -> Ledger:
        return Ledger(self.spark, f"{self.root}/{dimension}")

    def _read(self, ledger: Ledger, folders: Sequence[str], name: str) -> DataFrame:
        schema = f"`{name}` string, surrogate_key int"
        return self.spark.read.schema(schema).parquet(*[f"{ledger.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, dimension: str, name: str) -> DataFrame:
        """(name, surrogate_key) as of the last commit."""
        ledger = self._ledger(dimension)
        return self._read(ledger, ledger.last().get("keys", []), name)

    def extend(self, dimension: str, natural: DataFrame, name: str, tries: int = 8, on_write: Callable[[], None] = lambda: None) -> DataFrame:
        """The registry with keys for all values of natural, committed. on_write is called between writing and committing."""
        ledger = self._ledger(dimension)
        natural = natural.select(F.col(name).cast("string").alias(name))
        for left in reversed(range(tries)):
            last = ledger.last()
            folders, top = last.get("keys", []), last.get("top", 0)
            held = self._read(ledger, folders, name)
            folder = ledger.folder("keys")
            new_keys(natural, held, name, self.spark.range(1).select(F.lit(top).alias("_top"))).write.parquet(f"{ledger.root}/{folder}")
            found = self._read(ledger, [folder], name).agg(F.max("surrogate_key")).first()[0]
            if found is None:
                return held
            folders = [*folders, folder]
            if len(folders) > self.compact:
                merged = ledger.folder("keys")
                self._read(ledger, folders, name).write.parquet(f"{ledger.root}/{merged}")
                folders = [merged]
            on_write()
            try:
                ledger.commit(last["number"] + 1, {"keys": folders, "top": found})
            except FileExistsError:
                if not left:
                    raise
                continue
            return self._read(ledger, folders, name)
        raise AssertionError("tries must be 1 or more")


def with_unknown(dim: DataFrame, key: str, name: str) -> DataFrame:
    """dim and one row for what is unknown."""
    row = dim.sparkSession.range(1).select(*[
        F.lit(UNKNOWN_KEY).cast(f.dataType).alias(f.name) if f.name == key
        else F.lit(UNKNOWN_NAME).alias(f.name) if f.name == name
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in dim.schema
    ])
    return dim.unionByName(row)


def lookup(df: DataFrame, column: str, dim: DataFrame, name: str, key: str, alias: str, keep_null: bool = False) -> DataFrame:
    """df with dim's key for column as alias: unknown where there is none; null stays null if keep_null."""
    found = dim.select(F.col(name).alias("_name"), F.col(key).alias("_key"))
    value: Column = F.coalesce("_key", F.lit(UNKNOWN_KEY))
    if keep_null:
        value = F.when(F.col(column).isNotNull(), value)
    return df.join(found, df[column] == F.col("_name"), "left").withColumn(alias, value.cast("int")).drop("_name", "_key")
