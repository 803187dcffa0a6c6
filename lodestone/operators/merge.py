"""Upsert and append rules between a stored state and a batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold


def latest_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], compare: str, order: str) -> DataFrame:
    """The row of each key with the greatest compare; ties go to incoming, then to the later row."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rank = W.partitionBy(*keys).orderBy(F.col(compare).desc_nulls_last(), F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n", "_new")


def insert_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of source, one a key, whose key the target lacks."""
    return source.dropDuplicates(list(keys)).join(target, list(keys), "left_anti")


def insert_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: source_rows, inserted, skipped (repeats of a key in source, and keys that the target has)."""
    have = target.select(*keys).distinct().withColumn("_have", F.lit(True))
    x = source.groupBy(*keys).agg(F.count("*").alias("_n")).join(have, list(keys), "left")
    new = F.coalesce(F.count_if(F.col("_have").isNull()), F.lit(0))
    return x.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("source_rows"), new.alias("inserted")).withColumn("skipped", F.col("source_rows") - F.col("inserted"))


def append_immutable(published: DataFrame, batch: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """batch with its disposition: appended, unchanged, or immutability_conflict with what is published (or came first)."""
    first = W.partitionBy(*keys).orderBy(order)
    old = published.select(*keys, F.col(value).alias("_old"))
    x = batch.join(old, list(keys), "left").withColumns({"_n": F.row_number().over(first), "_first": F.first(value).over(first)})
    known = F.coalesce("_old", "_first")
    fresh = F.col("_old").isNull() & (F.col("_n") == 1)
    return x.withColumn(
        "disposition", F.when(fresh, "appended").when(F.col(value).eqNullSafe(known), "unchanged").otherwise("immutability_conflict")
    ).drop("_old", "_n", "_first")


def _freshness(now: tuple, stamp, digest: str | None) -> str:
    at, held = now
    if held is None:
        return "inserted"
    if held == digest:
        return "unchanged"
    if at is None or stamp is None or at == stamp:
        return "upsert_conflict"
    return "updated" if stamp > at else "stale_skipped"


def freshness(now: Column, stamp: Column, digest: Column) -> Column:
    """inserted if the key is absent; unchanged if the digest is the same; otherwise updated by a newer stamp, stale_skipped by an older one, upsert_conflict by an equal or missing one."""
    at, held = now["at"], now["held"]
    odd = at.isNull() | stamp.isNull() | (at == stamp)
    return F.when(held.isNull(), "inserted").when(F.coalesce(held == digest, F.lit(False)), "unchanged").when(odd, "upsert_conflict").when(stamp > at, "updated").otherwise("stale_skipped")


def fresh_upsert_rows(state: DataFrame, batch: DataFrame, key: str, stamp: str, digest: str, order: str, **limits: int) -> DataFrame:
    """(key, order, disposition, stamp, digest, is_last): a row for each of the batch's, judged by freshness() in order, and at a key's end one with what it holds by then.

    In window functions (see folds); a key that doesn't settle in these goes through one task in order.
    """
    x = _with_state(state, batch, key, stamp, digest, order)
    by = ("_new", order, stamp, digest)
    becomes = F.struct(F.col(stamp).alias("at"), F.col(digest).alias("held"))
    chunk = F.floor(F.col(order).cast("double") / 1_000_000) if isinstance(x.schema[order].dataType, T.NumericType) else None
    done, rest = fold(x, key, by, becomes, lambda now: freshness(now, F.col(stamp), F.col(digest)), ("inserted", "updated"), F.col(stamp), None, chunk, **limits)
    said = done.filter("NOT _given").select(key, order, F.col("_said").alias("disposition"), stamp, digest, F.lit(False).alias("is_last"))
    last = done.filter("_changed").groupBy(key).agg(F.max(F.struct(*by)).alias("e"))
    out = said.unionByName(last.select(key, F.lit(None).cast(x.schema[order].dataType).alias(order), F.lit(None).cast("string").alias("disposition"), F.col("e")[stamp].alias(stamp), F.col("e")[digest].alias(digest), F.lit(True).alias("is_last")))
    return out if rest is None else out.unionByName(_upsert_in_order(rest, key, stamp, digest, order))


def _with_state(state: DataFrame, batch: DataFrame, key: str, stamp: str, digest: str, order: str) -> DataFrame:
    new = batch.select(key, F.lit(1).alias("_new"), order, stamp, digest)
    old = state.select(key, F.lit(0).alias("_new"), F.lit(None).cast(new.schema[order].dataType).alias(order), F.col(stamp).cast(new.schema[stamp].dataType).alias(stamp), digest)
    return old.unionByName(new).withColumn("_given", F.col("_new") == 0)


def _upsert_in_order(rows: DataFrame, key: str, stamp: str, digest: str, order: str) -> DataFrame:
    """fresh_upsert_rows of rows as _with_state gives them, each key's passing through one task; only what the key holds is kept."""
    rows = rows.drop("_given")
    kinds = {n: rows.schema[n].dataType for n in (key, order, stamp, digest)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, now, shape = False, None, (None, None), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (shape.field(key).type, shape.field(order).type, pa.string(), shape.field(stamp).type, shape.field(digest).type, pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, order, "disposition", stamp, digest, "is_last"])

        for b in batches:
            shape, done = b.schema, []
            for k, is_new, o, s, d in zip(*(b.column(c).to_pylist() for c in (key, "_new", order, stamp, digest)), strict=True):
                if not begun or k != at:
                    if begun:
                        done.append((at, None, None, *now, True))
                    begun, at, now = True, k, (None, None)
                if not is_new:
                    now = s, d
                    continue
                say = _freshness(now, s, d)
                if say in ("inserted", "updated"):
                    now = s, d
                done.append((k, o, say, s, d, False))
            yield out(done)
        if begun:
            yield out([(at, None, None, *now, True)])

    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(order, kinds[order]), T.StructField("disposition", T.StringType()), T.StructField(stamp, kinds[stamp]), T.StructField(digest, kinds[digest]), T.StructField("is_last", T.BooleanType())])
    return rows.repartition(F.col(key)).sortWithinPartitions(key, "_new", order, stamp, digest).mapInArrow(run, schema)


def fresh_upsert(state: DataFrame, batch: DataFrame, key: str, stamp: str, digest: str, order: str) -> DataFrame:
    """fresh_upsert_rows as one row a key of the batch: (key, dispositions in batch order, stamp, digest). Holds a key's dispositions in one row."""
    x = fresh_upsert_rows(state, batch, key, stamp, digest, order)
    log = F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_last"), F.struct(order, "disposition")))), lambda r: r["disposition"])
    last = F.max(F.when(F.col("is_last"), F.struct(stamp, digest)))
    out = x.groupBy(key).agg(log.alias("dispositions"), last.alias("_last")).filter(F.size("dispositions") > 0)
    return out.select(key, "dispositions", F.col("_last")[stamp].alias(stamp), F.col("_last")[digest].alias(digest))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that a full load no longer has."""
    return old.select(key).join(new.select(key), key, "left_anti")


def versions(changes: DataFrame, key: str, stamp: str) -> DataFrame:
    """changes with effective_from, effective_to and is_current."""
    later = F.lead(stamp).over(W.partitionBy(key).orderBy(stamp))
    return changes.withColumns({"effective_from": F.col(stamp), "effective_to": later}).withColumn("is_current", F.col("effective_to").isNull())
