"""Change events as a stream: raw capture, and current state by key, drained with availableNow."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import cdc, gates
from ..plans import captured

STATE = "lsn long, deleted boolean, digest string"


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def capture(raw: DataFrame, good_path: str, bad_path: str, checkpoint: str):
    """Parses envelopes and appends usable ones by table and partition, the others to quarantine; a batch that runs again overwrites itself, and one that lost a message fails before its offsets are committed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = cdc.parse_envelope(batch).persist()
        good, bad = f"{good_path}/batch={batch_id}", f"{bad_path}/batch={batch_id}"
        parsed.filter("problem IS NULL").write.mode("overwrite").partitionBy("source_table", "kafka_partition").parquet(good)
        parsed.filter("problem IS NOT NULL").write.mode("overwrite").json(bad)
        n_good, n_bad = parsed.agg(F.count_if(F.col("problem").isNull()), F.count_if(F.col("problem").isNotNull())).first()
        read = parsed.sparkSession.read
        kept = (read.parquet(good).count() if n_good else 0) + (read.schema("problem string").json(bad).count() if n_bad else 0)
        parsed.unpersist()
        if kept != n_good + n_bad:
            raise gates.GateError(f"batch {batch_id}: {n_good + n_bad} messages, {kept} of them written")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_up(spark: SparkSession, bronze_path: str, schema: str, root: str, name: str, checkpoint: str, files_per_batch: int = 100):
    """Brings a captured table up to date with what arrives in Bronze, a commit of plans.captured a batch.

    That job knows by its own checkpoint which offsets it has folded, so a batch that Spark runs again, after a crash at any
    place, changes nothing twice; dispositions are those of the batch fold, since it is that fold.
    """
    events = source(spark, bronze_path, schema, files_per_batch)
    fold = lambda batch, _: captured.run_table(batch.sparkSession, batch, root, name)
    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_event(state: tuple | None, op: str | None, lsn: int | None, digest: str | None) -> tuple[str, tuple | None]:
    """(disposition, new state (lsn, deleted, digest)), by the batch fold's rule."""
    say = cdc.judge((*(state or (None,) * 3), None), op, lsn, digest)
    if say == "deleted":
        return say, (lsn, True, None)
    return say, (lsn, None if op is None else False, digest) if say in ("inserted", "updated") else state


class KeyedState(StatefulProcessor):
    """Holds a key's state (lsn, deleted, digest) and the last offset that it has seen, in the state store."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", f"{STATE}, kafka_offset long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, seen = (None, -1)
        if self.state.exists():
            *now, seen = self.state.get()
            now = tuple(now)
        held = sorted((r["kafka_offset"], r["operation"] or "", -1 if r["source_lsn"] is None else r["source_lsn"], r["digest"] or "", r["operation"], r["source_lsn"], r["digest"]) for r in rows)
        for off, _, _, _, op, lsn, digest in held:
            if off <= seen:
                yield Row(**{self.key: key[0], "kafka_offset": off, "disposition": "duplicates_skipped"})
                continue
            say, now = apply_event(now, op, lsn, digest)
            yield Row(**{self.key: key[0], "kafka_offset": off, "disposition": say})
        if held:
            self.state.update((*(now or (None,) * 3), max(seen, held[-1][0])))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        old = initialState["state"]
        self.state.update((old["lsn"], old["deleted"], old["digest"], -1))

    def close(self) -> None:
        pass


def current_state(events: DataFrame, key: str, state: DataFrame | None = None) -> DataFrame:
    """(key, kafka_offset, disposition) of a stream of (key, kafka_offset, operation, source_lsn, digest): the batch fold's, as the stream goes on.

    Tombstones are ignored. Offsets that a key has seen in an earlier batch are duplicates_skipped. A key's events of one batch are put in order of
    their offsets, so a batch must be bounded, as source() bounds it by files; with keys that are hot in a batch keep_up() is the better way. state: a stored
    one of the batch fold (key, state) to go on from. Needs the RocksDB state store, which is set here for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = events.filter("operation IS NULL OR operation <> 't'").select(key, F.col("kafka_offset").cast("long").alias("kafka_offset"), "operation", F.col("source_lsn").cast("long").alias("source_lsn"), "digest")
    out = T.StructType([T.StructField(key, x.schema[key].dataType), T.StructField("kafka_offset", T.LongType()), T.StructField("disposition", T.StringType())])
    first = None if state is None else state.select(key, "state").groupBy(key)
    return x.groupBy(key).transformWithState(KeyedState(key), out, "Append", "None", initialState=first)
