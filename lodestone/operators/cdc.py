"""Change data capture: envelopes, offsets, and keyed folds of change events into current state.

A key's events are applied in the order of their offsets, not of their log positions: an event
that changes nothing does not move the stored position, and conflicts are judged as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .folds import fold

ENVELOPE = """payload struct<op:string,before:string,after:string,
 source:struct<connector:string,name:string,db:string,schema:string,table:string,lsn:bigint,ts_ms:bigint,snapshot:string>,
 transaction:struct<id:string,total_order:bigint,data_collection_order:bigint>>"""
STATE = "struct<lsn:bigint,deleted:boolean,digest:string,record:string>"


def parse_envelope(df: DataFrame, value: str = "value", topic: str = "topic", key: str | None = None) -> DataFrame:
    """Operation, images, position and origin of raw messages; `problem` says why a message can't be used. A null value is a tombstone (t); a key that isn't JSON is a problem too."""
    x = df.withColumn("_b", F.from_json(value, ENVELOPE)["payload"])
    b = F.col("_b")
    op = F.when(F.col(value).isNull(), "t").otherwise(b["op"])
    bad_key = F.lit(False) if key is None else F.col(key).isNotNull() & F.get_json_object(key, "$").isNull()
    problem = (
        F.when(bad_key, "malformed_key").when(F.col(value).isNull(), None)
        .when(F.get_json_object(value, "$").isNull(), "malformed_json")
        .when(b.isNull(), "missing_payload")
        .when(b["op"].isNull(), "missing_op")
        .when(~b["op"].isin("r", "c", "u", "d"), "unknown_op")
        .when((b["op"] == "d") & b["before"].isNull(), "missing_payload_for_operation")
        .when((b["op"] != "d") & b["after"].isNull(), "missing_payload_for_operation")
    )
    source = b["source"]
    return x.withColumns({
        "event_key": F.lit(None).cast("string") if key is None else F.coalesce(F.get_json_object(key, "$.payload"), F.col(key)),
        "operation": op, "before": b["before"], "after": b["after"], "source_lsn": source["lsn"], "source_timestamp_ms": source["ts_ms"],
        "snapshot_indicator": F.nullif(source["snapshot"], F.lit("false")), "source_connector": source["connector"], "source_name": source["name"], "source_database": source["db"], "source_schema": source["schema"],
        "source_table": F.element_at(F.split(topic, r"\."), -1), "transaction_id": b["transaction"]["id"], "transaction_total_order": b["transaction"]["total_order"],
        "transaction_data_collection_order": b["transaction"]["data_collection_order"], "problem": problem,
    }).drop("_b")


BRONZE = (
    "source_topic", "kafka_partition", "kafka_offset", "event_key", "operation", "before", "after", "source_connector", "source_name", "source_schema", "source_table", "source_database", "source_lsn", "source_timestamp_ms",
    "snapshot_indicator", "transaction_id", "transaction_total_order", "transaction_data_collection_order", "cdc_received_at_utc",
)


def bronze_records(parsed: DataFrame) -> DataFrame:
    """The record that is kept of each usable message, with the time it was received."""
    return parsed.filter("problem IS NULL").withColumn("cdc_received_at_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).select(*BRONZE)


def unseen(events: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Events after their (topic, partition)'s checkpoint."""
    seen = checkpoint.select("source_topic", "kafka_partition", F.col("kafka_offset").alias("_seen"))
    x = events.join(seen, ["source_topic", "kafka_partition"], "left")
    return x.filter(F.col("_seen").isNull() | (F.col("kafka_offset") > F.col("_seen"))).drop("_seen")


def advance(checkpoint: DataFrame, events: DataFrame) -> DataFrame:
    """The largest offset of each (topic, partition)."""
    both = checkpoint.unionByName(events.select("source_topic", "kafka_partition", "kafka_offset"))
    return both.groupBy("source_topic", "kafka_partition").agg(F.max("kafka_offset").alias("kafka_offset"))


def judge(now: tuple, op: str | None, lsn: int | None, digest: str | None) -> str:
    """Disposition of an event in a state (lsn, deleted, digest, record); unknown positions and digests compare as in SQL."""
    at, gone, held, _ = now
    none, newer = at is None, at is not None and lsn is not None and lsn > at
    same = held is not None and held == digest
    if op == "d":
        return "deleted" if none or newer else "stale_skipped"
    if none:
        return "inserted"
    if gone and not newer and lsn is not None:
        return "stale_skipped"
    if gone:
        return "inserted" if op == "c" else "conflict_update_after_delete"
    if newer:
        return "unchanged" if same else "updated"
    if lsn == at:
        return "unchanged" if same else "conflict_same_lsn"
    return "stale_skipped"


def transition(now: Column, op: Column, lsn: Column, digest: Column) -> Column:
    """Disposition of an event in a state (lsn, deleted, digest), which is null at first."""
    at, gone = now["lsn"], F.coalesce(now["deleted"], F.lit(False))
    none, newer, same = at.isNull(), F.coalesce(lsn > at, F.lit(False)), F.coalesce(now["digest"] == digest, F.lit(False))
    return (
        F.when(op == "d", F.when(none | newer, "deleted").otherwise("stale_skipped"))
        .when(none, "inserted")
        .when(gone & ~newer & lsn.isNotNull(), "stale_skipped")
        .when(gone, F.when(op == "c", "inserted").otherwise("conflict_update_after_delete"))
        .when(newer, F.when(same, "unchanged").otherwise("updated"))
        .when(lsn == at, F.when(same, "unchanged").otherwise("conflict_same_lsn"))
        .otherwise("stale_skipped")
    )


ORDER = ("_new", "kafka_offset", "operation", "source_lsn", "digest", "record")
CHANGES = ("inserted", "updated", "deleted")


def fold_rows(events: DataFrame, key: str, state: DataFrame | None = None, **limits: int) -> DataFrame:
    """(key, kafka_offset, disposition, state, is_last): a row an event other than a tombstone of (key, kafka_offset, operation, source_lsn, digest, record), and at a key's end a row with its state and is_last. state: a stored one (key, state).
    Events that are stored and numbered (_row) are not written again.

    In window functions (see folds); a key whose late events take more rounds than those, by limits, goes through one task in order.
    """
    x = _with_state(events, key, state)
    deleted = F.when(F.col("_given"), F.col("_deleted")).otherwise(F.col("operation") == "d")
    dead = F.col("operation") == "d"
    becomes = F.struct(F.col("source_lsn").alias("lsn"), deleted.alias("deleted"), F.when(~F.coalesce(dead, F.lit(False)), F.col("digest")).alias("digest"))
    opens = F.when(F.col("_given"), ~F.coalesce("_deleted", F.lit(False))).when(F.col("operation").isin("c", "d"), F.col("operation") == "c")
    say = lambda now: transition(now, F.col("operation"), F.col("source_lsn"), F.col("digest"))
    done, rest = fold(x, key, ORDER, becomes, say, CHANGES, F.col("source_lsn"), opens, F.expr("kafka_offset div 1000000"), **limits)
    none = F.lit(None)
    said = done.filter("_new").select(key, "kafka_offset", F.col("_said").alias("disposition"), none.cast(STATE).alias("state"), F.lit(False).alias("is_last"))
    # the last changing row of a key holds its state
    last = done.filter("_changed").groupBy(key).agg(F.max(F.struct(*ORDER, deleted.alias("deleted"))).alias("e"))
    gone = F.col("e.operation").eqNullSafe(F.lit("d"))
    held = F.struct(F.col("e.source_lsn").alias("lsn"), F.col("e.deleted").alias("deleted"), F.when(~gone, F.col("e.digest")).alias("digest"), F.when(~gone, F.col("e.record")).alias("record"))
    out = said.unionByName(last.select(key, none.cast("long").alias("kafka_offset"), none.cast("string").alias("disposition"), held.alias("state"), F.lit(True).alias("is_last")))
    return out if rest is None else out.unionByName(stored(_in_order(rest, key), "in-order", "zstd"))


def _with_state(events: DataFrame, key: str, state: DataFrame | None) -> DataFrame:
    """The events that count, and for each stored state a row that comes before its key's events."""
    ready = ["_row"] if "_row" in events.columns else []
    x = events.filter("operation IS NULL OR operation <> 't'").select(*ready, key, F.lit(True).alias("_new"), F.col("kafka_offset").cast("long").alias("kafka_offset"), "operation", F.col("source_lsn").cast("long").alias("source_lsn"), "digest", "record", F.lit(False).alias("_deleted"))
    if state is not None:
        old = state.select(*[F.lit(-1).cast("long").alias(c) for c in ready], key, F.lit(False).alias("_new"), F.lit(None).cast("long").alias("kafka_offset"), F.lit(None).cast("string").alias("operation"), F.col("state.lsn").alias("source_lsn"), "state.digest", "state.record", F.col("state.deleted").alias("_deleted"))
        x = x.unionByName(old)
    return x.withColumn("_given", ~F.col("_new"))


def fold_in_order(events: DataFrame, key: str, state: DataFrame | None = None) -> DataFrame:
    """fold_rows with each key's rows passing through one task in order; only the state of the key at hand is held."""
    return _in_order(_with_state(events, key, state), key)


def _in_order(x: DataFrame, key: str) -> DataFrame:
    by = [key, *ORDER]
    x = x.drop("_given", "_row")
    kind = x.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.struct([("lsn", pa.int64()), ("deleted", pa.bool_()), ("digest", pa.string()), ("record", pa.string())])
        begun, at, now, key_type = False, None, (None,) * 4, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (key_type, pa.int64(), pa.string(), shape, pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "kafka_offset", "disposition", "state", "is_last"])

        def ended() -> tuple:
            return at, None, None, dict(zip(("lsn", "deleted", "digest", "record"), now, strict=True)), True

        for b in batches:
            rows, key_type, records = [], b.schema.field(key).type, b.column("record")
            for i, (k, new, off, op, lsn, digest, deleted) in enumerate(zip(*(b.column(c).to_pylist() for c in (key, "_new", "kafka_offset", "operation", "source_lsn", "digest", "_deleted")), strict=True)):
                if not begun or k != at:
                    if begun:
                        rows.append(ended())
                    begun, at, now = True, k, (None,) * 4
                if not new:
                    now = lsn, deleted, digest, records[i].as_py()
                    continue
                say = judge(now, op, lsn, digest)
                if say == "deleted":
                    now = lsn, True, None, None
                elif say in ("inserted", "updated"):
                    now = lsn, None if op is None else False, digest, records[i].as_py()
                rows.append((k, off, say, None, False))
            yield out(rows)
        if begun:
            yield out([ended()])

    return x.repartition(F.col(key)).sortWithinPartitions(*by).mapInArrow(run, f"`{key}` {kind}, kafka_offset long, disposition string, state {STATE}, is_last boolean")


def fold_current_state(events: DataFrame, key: str, state: DataFrame | None = None) -> DataFrame:
    """fold_rows as one row a key: (key, state, dispositions as (offset, disposition) in order of the offsets). Holds a key's dispositions in one row; fold_rows doesn't."""
    x = fold_rows(events, key, state)
    log = F.sort_array(F.collect_list(F.when(~F.col("is_last"), F.struct(F.col("kafka_offset").alias("off"), "disposition"))))
    return x.groupBy(key).agg(F.max_by("state", "is_last").alias("state"), log.alias("dispositions"))


def fold_event_log(events: DataFrame, key: str) -> DataFrame:
    """(key, kafka_offset, disposition) of fold_log_rows."""
    return fold_log_rows(events, key).filter("NOT is_last").select(key, "kafka_offset", "disposition")


def fold_log_rows(events: DataFrame, key: str, state: DataFrame | None = None) -> DataFrame:
    """As fold_rows: a delete is always appended and frees the key; others are appended once until then. An appended row's state is the event itself, the one at a key's end says by `deleted` whether the key is free."""
    x = _with_state(events, key, state).withColumn("operation", F.when(F.col("_given"), F.when(F.col("_deleted"), "d").otherwise("c")).otherwise(F.col("operation")))
    before = F.lag("operation").over(Window.partitionBy(key).orderBy("_new", "kafka_offset", "operation"))
    say = F.when((F.col("operation") != "d") & (before != "d"), "duplicate_primary_key").otherwise("appended")
    itself = F.struct(F.col("source_lsn").alias("lsn"), (F.col("operation") == "d").alias("deleted"), "digest", "record")
    said = x.withColumn("disposition", say).filter("_new").select(key, "kafka_offset", "disposition", F.when(F.col("disposition") == "appended", itself).alias("state"), F.lit(False).alias("is_last"))
    last = x.groupBy(key).agg(F.max(F.struct("_new", "kafka_offset", "operation", "source_lsn")).alias("e"))
    end = F.struct(F.col("e.source_lsn").alias("lsn"), (F.col("e.operation") == "d").alias("deleted"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("record"))
    none = F.lit(None)
    return said.unionByName(last.select(key, none.cast("long").alias("kafka_offset"), none.cast("string").alias("disposition"), end.alias("state"), F.lit(True).alias("is_last")))
