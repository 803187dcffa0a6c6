"""The job over the eleven captured tables: from raw change events to states, live rows, logs and quarantine.

A table's run reads the events after its checkpoint, judges and folds them, writes what came of it to new folders, and
commits folders and checkpoint together (see sources.ledger). States are written as deltas, the touched keys'
only, and merged into one every COMPACT runs, so a run costs what its batch costs; the live rows are written as a
snapshot if asked for. The raw message of a quarantined event stays in Bronze, at its offset.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import JSON
from ..operators import cdc, cdc_tables, gates
from ..sources.ledger import Ledger
from ..sources.stored import stored

COMPACT = 16
KINDS = ("states", "rows", "log", "quarantine")
Checkpoint = list[list]


def unread(bronze: DataFrame, checkpoint: Checkpoint) -> DataFrame:
    """The events after the checkpoint ([topic, partition, offset]): a scan for each partition with its offset as a filter that Parquet can skip row groups by, and one of what the checkpoint doesn't know."""
    if not checkpoint:
        return bronze
    here = [(F.col("source_topic") == t) & (F.col("kafka_partition") == p) for t, p, _ in checkpoint]
    parts = [bronze.filter(x & (F.col("kafka_offset") > c[2])) for x, c in zip(here, checkpoint, strict=True)]
    others = reduce(lambda a, b: a & b, [~F.coalesce(x, F.lit(False)) for x in here])
    return reduce(DataFrame.unionByName, [*parts, bronze.filter(others)])


def read_state(ledger: Ledger, entry: dict, name: str) -> DataFrame | None:
    """(key, state) of a commit: of a key's entries, the one that was written last."""
    folders = entry.get("states") or []
    if not folders:
        return None
    key = cdc_tables.specs()[name][0].key
    read = lambda f: ledger.spark.read.schema(f"`{key}` string, state {cdc.STATE}").parquet(f"{ledger.root}/{f}")
    if len(folders) == 1:
        return read(folders[0])
    both = reduce(DataFrame.unionByName, [read(f).withColumn("_n", F.lit(n)) for n, f in enumerate(folders)])
    return both.groupBy(key).agg(F.max(F.struct("_n", "state")).alias("e")).select(key, "e.state")


def run_table(spark: SparkSession, bronze: DataFrame, root: str, name: str, publish: bool = True, compact: int = COMPACT, on_step: Callable[[str], None] = lambda step: None) -> dict:
    """Brings a table up to date with bronze and returns its commit, the last one if there was nothing to do. on_step hears of each step that is done."""
    spec, mode = cdc_tables.specs()[name]
    ledger = Ledger(spark, f"{root}/{name}")
    last = ledger.last()
    events = unread(bronze.filter(F.col("source_table") == name), last.get("checkpoint", []))
    ends = events.groupBy("source_topic", "kafka_partition").agg(F.max("kafka_offset").alias("offset"), F.count("*").alias("n")).collect()
    if not ends:
        return last
    on_step("read")
    ends = {(r["source_topic"], r["kafka_partition"]): (r["offset"], r["n"]) for r in ends}
    marks = {(t, p): o for t, p, o in last.get("checkpoint", [])} | {k: o for k, (o, _) in ends.items()}
    state = read_state(ledger, last, name)
    if state is not None:
        image = F.when(F.col("operation") == "d", F.col("before")).otherwise(F.col("after"))
        touched = events.select(F.get_json_object(image, f"$.{spec.key}").alias(spec.key)).distinct()
        state = state.join(touched, spec.key, "left_semi")
    done = cdc_tables.process(events, spec, mode, state)
    if mode == "log":
        done = stored(done, "captured", "zstd")  # a state table's is read from what its fold has stored
    on_step("processed")

    folders = {kind: ledger.folder(kind) for kind in KINDS}
    write = lambda df, kind: df.write.parquet(f"{ledger.root}/{folders[kind]}", compression="zstd")
    write(cdc_tables.state_of(done, spec), "states")
    on_step("states")
    states = [*last.get("states", []), folders["states"]]
    if len(states) > compact:
        merged = ledger.folder("states")
        read_state(ledger, {"states": states}, name).write.parquet(f"{ledger.root}/{merged}", compression="zstd")
        states = [merged]
    if mode == "log":
        write(done.filter("disposition = 'appended'").select("kafka_offset", "state"), "log")
        on_step("log")
    elif publish:
        write(cdc_tables.current_rows(read_state(ledger, {"states": states}, name), spec), "rows")
        on_step("rows")
    write(done.filter("disposition = 'quarantined'").select(spec.key, "kafka_offset", "reason"), "quarantine")
    on_step("quarantine")
    counts = {r["disposition"]: r["n_rows"] for r in gates.accounting(done.filter("NOT is_last"), "disposition").collect()}
    n_events = sum(n for _, n in ends.values())
    if sum(counts.values()) != n_events:
        raise gates.GateError(f"{name}: {n_events} events, {sum(counts.values())} dispositions")
    on_step("counted")
    entry = ledger.commit(last["number"] + 1, {
        "checkpoint": [[t, p, o] for (t, p), o in sorted(marks.items())], "states": states, "rows": folders["rows"] if publish and mode != "log" else None,
        "log": [*last.get("log", []), *[folders["log"]] * (mode == "log")], "quarantine": [*last.get("quarantine", []), folders["quarantine"]], "dispositions": counts,
    })
    on_step("committed")
    return entry


def run_all(spark: SparkSession, bronze: DataFrame, root: str, at_once: int = 4, **more) -> dict[str, dict]:
    """run_table for each captured table; all are tried, and failures are raised together at the end."""
    def one(name: str) -> tuple[str, dict | None, str | None]:
        try:
            return name, run_table(spark, bronze, root, name, **more), None
        except Exception as e:
            return name, None, f"{name}: {e}"

    with ThreadPoolExecutor(at_once) as pool:
        out = list(pool.map(one, cdc_tables.specs()))
    gates.require_all([problem for *_, problem in out if problem])
    return {name: entry for name, entry, _ in out}


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A state table's live typed rows as of its last commit: the published ones, or those of its states."""
    ledger = Ledger(spark, f"{root}/{name}")
    spec, last = cdc_tables.specs()[name][0], ledger.last()
    schema = f"{cdc_tables.schema_of(spec)}, record_hash string, source_lsn long"
    if last.get("rows"):
        return spark.read.schema(schema).parquet(f"{ledger.root}/{last['rows']}")
    state = read_state(ledger, last, name)
    if state is None:
        return spark.createDataFrame([], schema)
    return cdc_tables.current_rows(state, spec)


def appended(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A log table's committed events: typed columns, kafka_offset, is_delete, source_lsn."""
    ledger = Ledger(spark, f"{root}/{name}")
    spec, folders = cdc_tables.specs()[name][0], [f"{ledger.root}/{f}" for f in ledger.last().get("log", [])]
    x = spark.read.schema(f"kafka_offset long, state {cdc.STATE}").parquet(*folders) if folders else spark.createDataFrame([], f"kafka_offset long, state {cdc.STATE}")
    return x.select(F.from_json("state.record", cdc_tables.schema_of(spec), JSON).alias("r"), "kafka_offset", "state").select("r.*", "kafka_offset", F.col("state.deleted").alias("is_delete"), F.col("state.lsn").alias("source_lsn"))


def sweep(spark: SparkSession, root: str, name: str) -> int:
    """Deletes what runs of a table that died, or commits before its last one, have left; returns how many folders."""
    ledger = Ledger(spark, f"{root}/{name}")
    last = ledger.last()
    named = {f for kind in ("states", "log", "quarantine") for f in last.get(kind, [])} | {last.get("rows")}
    return ledger.sweep(list(KINDS), named)
