"""Registered queries of the captured tables' job: each runs it twice over Bronze made of a given table, the second time from the first one's commit.

The events' columns follow from the tables' specs by fixed rules (RULES), in SQL that Spark and the oracle both read; faults are
part of the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cdc_tables
from ..operators.checks import ColumnSpec, TableSpec
from ..sources.stored import shared_path
from . import captured
from .entities import table
from .registry import query
from .source_queries import FOLD_SQL

#: Captured table -> the given table and the id that its events are made of.
MADE_OF = {
    "clients": ("supplier", "s_suppkey"), "programs": ("supplier", "s_suppkey"), "campaigns": ("part", "p_partkey"), "offers": ("part", "p_partkey"), "cardholders": ("customer", "c_custkey"), "card_tokens": ("customer", "c_custkey"),
    "transactions": ("orders", "o_orderkey"), "settlements": ("orders", "o_orderkey"), "reconciliation": ("part", "p_partkey"), "transaction_events": ("customer", "c_custkey"), "reward_events": ("part", "p_partkey"),
}
STEPS = 5


def _value(spec: TableSpec, j: int, c: ColumnSpec) -> str:
    """SQL of a column's value in its wire form, from id and step."""
    if c.name == spec.key:
        return "'K' || CAST(id AS STRING)"
    if c.values:
        cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(c.values))
        return f"CASE WHEN id % {17 + j} = 0 AND step = 3 THEN 'BOGUS' ELSE CASE (id + step) % {len(c.values)} {cases} END END"
    if c.kind == "date":
        return f"CAST(9000 + (id + {j} + step) % 300 AS STRING)"
    if c.kind == "timestamp":
        return f"CAST(1700000000000000 + (id % 1000) * 1000000 + step * 1000 + {j} AS STRING)"
    if c.kind != "string":
        plain = f"CAST((id * 7 + step * 3 + {j}) % 1000 + 1 AS STRING) || '.25'"
        return f"CASE WHEN id % {13 + j} = 0 AND step = 1 THEN '-1.00' ELSE {plain} END" if c.positive else plain
    if c.required:
        return f"CASE WHEN id % {23 + j} = 0 AND step = 1 THEN ' ' ELSE 'v' || CAST((id + step * {j}) % 50 AS STRING) END"
    return "CASE WHEN id % 3 = 0 THEN NULL ELSE 'o' || CAST(id % 5 AS STRING) END"


def _raw(spec: TableSpec, rows: str) -> str:
    """Events off, op, lsn, no_image and the columns' wire values, from rows (id, step): late ones, deletes, tombstones, lost images."""
    columns = ", ".join(f"{_value(spec, j, c)} AS {c.name}" for j, c in enumerate(spec.columns))
    return f"""SELECT {STEPS} * id + step AS off, CASE step WHEN 0 THEN 'c' WHEN 1 THEN 'u' WHEN 2 THEN CASE id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 't' ELSE 'u' END ELSE CASE WHEN id % 5 = 0 THEN 'c' ELSE 'u' END END AS op,
 10 * id + CASE step WHEN 3 THEN CASE WHEN id % 2 = 0 THEN 1 ELSE 5 END ELSE step END AS lsn, id % 29 = 0 AND step = 2 AS no_image, {columns} FROM {rows}"""


def bronze(spark, sf: str, name: str) -> DataFrame:
    """A captured table's events, in two partitions by key."""
    spec, (source, key) = cdc_tables.specs()[name][0], MADE_OF[name]
    ids = table(spark, sf, source).select(F.col(key).cast("long").alias("id")).withColumn("step", F.explode(F.expr(f"sequence(0L, {STEPS - 1}L)")))
    x = spark.sql(_raw(spec, "{ids}"), ids=ids)
    number = lambda c: F.col(c.name).cast("long") if c.kind in ("date", "timestamp") else F.col(c.name)
    image = F.when(~F.col("no_image") & (F.col("op") != "t"), F.to_json(F.struct(*[number(c).alias(c.name) for c in spec.columns])))
    return x.select(
        F.lit(f"db.public.{name}").alias("source_topic"), F.lit(name).alias("source_table"), (F.floor(F.col("off") / STEPS) % 2).cast("int").alias("kafka_partition"), F.col("off").alias("kafka_offset"), F.col("op").alias("operation"),
        F.when(F.col("op") == "d", image).alias("before"), F.when(F.col("op") != "d", image).alias("after"), F.col("lsn").alias("source_lsn"),
    )


def run_twice(spark, sf: str, name: str) -> str:
    """Root of the job's output after a run over events up to the middle offset and one over all."""
    events, path, root = bronze(spark, sf, name), shared_path(spark, "bronze"), shared_path(spark, "captured")
    middle = events.agg(F.max("kafka_offset")).first()[0] or 0
    parts = events.withColumn("_first", F.col("kafka_offset") <= middle // 2)
    for first in (True, False):
        parts.filter(F.col("_first") == first).drop("_first").write.mode("append").partitionBy("source_table", "kafka_partition").parquet(path, compression="zstd")
        schema = parts.drop("_first").schema
        captured.run_table(spark, spark.read.schema(schema).parquet(path), root, name)
    return root


def _typed(c: ColumnSpec) -> str:
    if c.kind == "date":
        return f"DATE '1970-01-01' + CAST({c.name} AS INT) AS {c.name}"
    if c.kind == "timestamp":
        return f"make_timestamp(CAST({c.name} AS BIGINT)) AS {c.name}"
    return c.name if c.kind == "string" else f"CAST(CAST({c.name} AS DECIMAL(18,4)) AS DOUBLE) AS {c.name}"


def _judged(spec: TableSpec) -> str:
    """CTEs raw and judged: each event with its fault, if any."""
    source, key = MADE_OF[spec.name]
    faults = []
    for c in spec.columns:
        faults += [f"WHEN op <> 'd' AND trim({c.name}) = '' THEN 'missing_{c.name}'"] * c.required
        faults += [f"WHEN op <> 'd' AND CAST({c.name} AS DECIMAL(18,4)) <= 0 THEN 'not_positive_{c.name}'"] * c.positive
        faults += [f"WHEN op <> 'd' AND {c.name} = 'BOGUS' THEN 'invalid_{c.name}'"] * bool(c.values)
    values = " || '|' || ".join(f"coalesce({c.name}, '~')" for c in spec.columns)
    rows = f"(SELECT CAST({key} AS BIGINT) AS id, step FROM {source} CROSS JOIN (SELECT unnest(range({STEPS})) AS step))"
    return f"""raw AS ({_raw(spec, rows)}), judged AS (SELECT *, md5({values}) AS digest, CASE WHEN op = 't' THEN NULL WHEN no_image THEN 'missing_payload_for_operation' {" ".join(faults)} END AS reason FROM raw)"""


def _sql(spec: TableSpec, mode: str) -> str:
    columns = ", ".join(map(_typed, spec.columns))
    if mode == "log":
        return f"""WITH {_judged(spec)}, ok AS (SELECT *, lag(op) OVER (PARTITION BY {spec.key} ORDER BY off) AS prev FROM judged WHERE op <> 't' AND reason IS NULL)
 SELECT {columns}, off AS kafka_offset, op = 'd' AS is_delete, lsn AS source_lsn FROM ok WHERE op = 'd' OR coalesce(prev, 'd') = 'd'"""
    return f"""WITH RECURSIVE {_judged(spec)}, ev AS (SELECT {spec.key} AS k, off, op, lsn, digest FROM judged WHERE op <> 't' AND reason IS NULL), {FOLD_SQL},
 last AS (SELECT k, max(off) AS off FROM fold WHERE say IN ('inserted', 'updated', 'deleted') GROUP BY k)
 SELECT {columns}, lsn AS source_lsn FROM judged JOIN last USING (off) WHERE op <> 'd'"""


def _register(name: str, spec: TableSpec, mode: str) -> None:
    def run(spark, sf: str) -> DataFrame:
        root = run_twice(spark, sf, name)
        return captured.appended(spark, root, name) if mode == "log" else captured.current(spark, root, name).drop("record_hash")

    query(_sql(spec, mode), name=f"captured_{name}")(run)


for _spec, _mode in cdc_tables.SPECS:
    _register(_spec.name, _spec, _mode)
