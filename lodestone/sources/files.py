"""Scans and sinks: raw text first, casts later; snapshots, append logs, runs and quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_text_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV with a header, all columns text; an empty field is null; ragged rows are kept."""
    return spark.read.csv(path, header=True, schema=strings(names), mode="PERMISSIVE", multiLine=True, enforceSchema=True)


def read_documents(spark: SparkSession, paths: str | list[str], schema: str, rows: str | None = None) -> DataFrame:
    """JSON files that are one value each; `rows` names an array whose elements become rows."""
    df = spark.read.json(paths, schema=schema, multiLine=True)
    return df.select(F.explode(rows).alias("r")).select("r.*") if rows else df


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def latest_run(df: DataFrame, run: str = "run_id") -> DataFrame:
    """The rows of the last run by name."""
    last = df.agg(F.max(run).alias("_last"))
    if last.first()[0] is None:
        raise FileNotFoundError("there is no run")
    return df.join(F.broadcast(last), F.col(run) == F.col("_last")).drop("_last")


def after(df: DataFrame, stamp: str, mark, inclusive: bool = False) -> DataFrame:
    """Rows after the watermark; all rows if there is none."""
    if mark is None:
        return df
    return df.filter(F.col(stamp) >= F.lit(mark) if inclusive else F.col(stamp) > F.lit(mark))


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """A new version beside the old ones, so that a table may be computed from its own last version."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The last version below root by name; None if there is none."""
    try:
        found = spark.read.option("basePath", root).parquet(f"{root}/version=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    # versions are partitions, so only the last one's files are read
    last = found.agg(F.max(F.col("version").cast("string"))).first()[0]
    return found.filter(F.col("version").cast("string") == last).drop("version")


def append_log(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    if not df.isEmpty():
        df.write.mode("append").partitionBy(*by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_part(df: DataFrame, path: str, by: Sequence[str], run_id: str) -> None:
    """Adds a run's rows below the partitions of by; a run that has been added is refused, so parts never change."""
    done = f"{path}/_runs/{run_id}"
    if _exists(df.sparkSession, done):
        raise FileExistsError(f"{run_id} has been added")
    if not df.isEmpty():
        df.write.mode("append").partitionBy(*by).parquet(path)
    df.sparkSession.range(1).selectExpr(f"'{run_id}' AS run_id").write.json(done)


def write_metadata(raw: DataFrame, suite: DataFrame, run_dir: str, source: str, **extra: str | None) -> None:
    """What is known of a captured batch: its rows, fields, checks, and what else the caller gives."""
    passed = suite.agg(F.bool_and("passed").alias("passed"), F.collect_list(F.struct("check_name", "n_failures", "passed")).alias("checks"))
    x = raw.agg(F.count("*").alias("record_count")).crossJoin(F.broadcast(passed))
    x = x.select(F.lit(source).alias("source_name"), "*", F.array(*map(F.lit, raw.columns)).alias("fields"), *[F.lit(v).cast("string").alias(k) for k, v in extra.items()])
    x.write.option("ignoreNullFields", False).json(f"{run_dir}/metadata")


def read_metadata(spark: SparkSession, run_dir: str) -> DataFrame:
    """A batch's metadata; without any the batch can't be used, which is an error."""
    if not _exists(spark, f"{run_dir}/metadata"):
        raise FileNotFoundError(f"{run_dir} has no metadata")
    return spark.read.json(f"{run_dir}/metadata")


def materialise(tables: Mapping[str, DataFrame], root: str, version: str) -> None:
    """Writes each table as a new version and shows the versions as views."""
    for name, df in tables.items():
        df.sparkSession.read.parquet(write_snapshot(df, f"{root}/{name}", version)).createOrReplaceTempView(name)


REJECTION = "dataset string, run_id string, record_id string, raw_record string, failing_check_name string, error_reason string, rejected_at timestamp"


def read_quarantine(spark: SparkSession, path: str, dataset: str | None = None, run_id: str | None = None) -> DataFrame:
    """Rejections, of a dataset or a run if given; none if nothing was ever rejected."""
    if not _exists(spark, path):
        return spark.createDataFrame([], REJECTION)
    x = spark.read.schema(REJECTION).json(path)
    return x.filter(F.lit(True) if dataset is None else F.col("dataset") == dataset).filter(F.lit(True) if run_id is None else F.col("run_id") == run_id)


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """Appends rejections as JSON by dataset and run; a clean batch writes nothing."""
    if not rejected.isEmpty():
        rejected.write.mode("append").partitionBy("dataset", "run_id").json(path)
