"""Client extracts: entitlement, gates, staging, read-back, manifest and idempotent publishing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import GateError, repeated_keys, require_all

FORMATS = ("csv", "parquet")


@dataclass(frozen=True)
class Extract:
    """A dataset that is delivered: its mart, columns in order, grain, schema version; the column that names the client, if rows are a client's own; the amount that is controlled, where (column, value) if not all rows count; the date columns of its period."""

    mart: str
    columns: tuple[str, ...]
    grain: tuple[str, ...]
    version: str
    client_column: str | None = None
    control: str | None = None
    control_where: tuple[str, str] | None = None
    period: tuple[str, str | None] | None = None


def authorize(entitlements: DataFrame, client: str, dataset: str, kind: str) -> None:
    """Raises unless the client may have the dataset in this format; entitlements: client_id, dataset, formats (array)."""
    rows = entitlements.filter(F.col("client_id") == client).select("dataset", "formats").collect()
    if not rows:
        raise GateError(f"{client} is unknown")
    formats = [r["formats"] for r in rows if r["dataset"] == dataset]
    if not formats:
        raise GateError(f"{client} has no right to {dataset}")
    if kind not in FORMATS or kind not in formats[0]:
        raise GateError(f"{dataset} is not delivered as {kind}")


def extract(mart: DataFrame, columns: Sequence[str], grain: Sequence[str], only: tuple[str, str] | None = None) -> DataFrame:
    rows = mart if only is None else mart.filter(F.col(only[0]) == F.lit(only[1]))
    return rows.select(*columns).orderBy(*grain)


def reporting_period(df: DataFrame, first: str | None, last: str | None = None) -> DataFrame:
    """(period_start, period_end, period_kind); no date column is a full snapshot."""
    if first is None:
        return df.sparkSession.range(1).select(F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"), F.lit("full snapshot").alias("period_kind"))
    return df.agg(F.min(first).alias("period_start"), F.max(last or first).alias("period_end")).withColumn("period_kind", F.lit("range"))


def control_total(df: DataFrame, column: str | None, where: tuple[str, str] | None = None) -> str:
    """The sum as text, 0 for no rows; NOT_APPLICABLE if there is no such column."""
    if column is None or column not in df.columns:
        return "NOT_APPLICABLE"
    rows = df if where is None else df.filter(F.col(where[0]) == F.lit(where[1]))
    return str(rows.agg(F.coalesce(F.sum(column), F.lit(0)).cast("decimal(38,4)")).first()[0])


def validate(df: DataFrame, columns: Sequence[str], grain: Sequence[str]) -> None:
    if df.columns != list(columns):
        raise GateError(f"columns are {df.columns}, not {list(columns)}")
    blank = df.filter(" OR ".join(f"`{g}` IS NULL" for g in grain))
    if not blank.isEmpty() or not repeated_keys(df, grain).isEmpty():
        raise GateError("the grain is null or repeated")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, home: str) -> list[dict]:
    """The manifests of a client's deliveries of a dataset, in order of their runs."""
    try:
        rows = spark.read.json(f"{home}/*/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted((r.asDict() for r in rows), key=lambda m: m["run_id"])


def run(mart: DataFrame, entitlements: DataFrame, config: Extract, client: str, dataset: str, outbox: str, run_id: str, kinds: Sequence[str], force: bool = False) -> dict:
    """Delivers the client's rows and returns the manifest; one that passed with the same schema version and period stands, unless forced.

    Files go to a staging folder, are read back and compared, and are then renamed into
    outbox/client/dataset/run; a failure leaves nothing there.
    """
    spark = mart.sparkSession
    for kind in kinds:
        authorize(entitlements, client, dataset, kind)
    lacking = [c for c in config.columns if c not in mart.columns]
    if lacking:
        raise GateError(f"{config.mart} lacks {', '.join(lacking)}")
    only = None if config.client_column is None else (config.client_column, client)
    source = mart if only is None else mart.filter(F.col(only[0]) == F.lit(only[1]))
    df = extract(mart, config.columns, config.grain, only)
    validate(df, config.columns, config.grain)
    total = control_total(source, config.control, config.control_where)
    if control_total(df, config.control, config.control_where) != total:
        raise GateError("the extract doesn't add up to its mart")
    period = reporting_period(df, *(config.period or (None, None))).first()
    dates = {"period_start": None if period[0] is None else str(period[0]), "period_end": None if period[1] is None else str(period[1]), "period_kind": period[2]}
    home = f"{outbox}/{client}/{dataset}"
    same = {"schema_version": config.version} | dates
    for m in manifests(spark, home):
        if not force and m["status"] == "PASSED" and all(m.get(k) == v for k, v in same.items()):
            return m
    staging, target = f"{outbox}/_staging/{client}/{dataset}/{run_id}", f"{home}/{run_id}"
    (there, fs), (here, _), (parent, _) = _path(spark, target), _path(spark, staging), _path(spark, home)
    if fs.exists(there):
        raise GateError(f"{run_id} has been delivered")
    n = df.count()
    manifest = {"run_id": run_id, "client_id": client, "dataset": dataset, "row_count": n, "control_total": total, "formats": list(kinds), "status": "PASSED"} | same
    try:
        for kind in kinds:
            df.write.mode("overwrite").option("header", True).format(kind).save(f"{staging}/{kind}")
            back = spark.read.schema(df.schema).option("header", True).format(kind).load(f"{staging}/{kind}")
            if (back.count(), control_total(back, config.control, config.control_where)) != (n, control_total(df, config.control, config.control_where)):
                raise GateError(f"{kind} doesn't read back as written")
        schema = "run_id string, client_id string, dataset string, row_count long, control_total string, formats array<string>, status string, schema_version string, period_start string, period_end string, period_kind string"
        spark.createDataFrame([manifest], schema).write.mode("overwrite").option("ignoreNullFields", False).json(f"{staging}/manifest")
        fs.mkdirs(parent)
        if not fs.rename(here, there):
            raise GateError(f"{run_id} could not be published")
    except Exception:
        fs.delete(here, True)
        raise
    return manifest


def run_all(marts: Mapping[str, DataFrame], entitlements: DataFrame, configs: Mapping[str, Extract], outbox: str, run_id: str, force: bool = False) -> list[dict]:
    """Every entitled delivery, each its own job; one that fails doesn't stop the others, and all failures are raised together in the end."""
    done, failed = [], []
    for r in entitlements.orderBy("client_id", "dataset").collect():
        name = f"{r['client_id']}/{r['dataset']}"
        try:
            config = configs[r["dataset"]]
            done.append(run(marts[config.mart], entitlements, config, r["client_id"], r["dataset"], outbox, run_id, tuple(r["formats"]), force))
        except (GateError, KeyError) as e:
            failed.append(f"{name}: {e}")
    spark = entitlements.sparkSession
    for m in done:
        if m["run_id"] not in {x["run_id"] for x in manifests(spark, f"{outbox}/{m['client_id']}/{m['dataset']}") if x["status"] == "PASSED"}:
            failed.append(f"{m['client_id']}/{m['dataset']}: no manifest")
    require_all(failed)
    return done
