"""What the operators share: the token rule, table access and shared storage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import shared_path

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
word_of = re.compile(WORD)
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor then costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled_at = path
    return out


def discard(*spooled: DataFrame) -> None:
    """Deletes what spool() wrote, once nothing that is still to run reads it."""
    for df in spooled:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._spooled_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def set_aside(df: DataFrame, known: tuple[str, ...] = DOCUMENT) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns beyond the known ones numbered, so that none clashes with an operator's own; and their names."""
    names = {f"_own{k}": c for k, c in enumerate(df.columns) if c not in known}
    return df.withColumnsRenamed({c: k for k, c in names.items()}), names


def put_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Gives set_aside's columns their names; one that df has itself by now gets _in appended."""
    have, back = {c.lower() for c in df.columns if c not in names}, {}
    for k, c in names.items():
        while c.lower() in have:
            c += "_in"
        have.add(c.lower())
        back[k] = c
    return df.withColumnsRenamed(back)


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(col: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(col: Column) -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def slices(texts: list, limit: int = 4 << 20):
    """(from, to) of runs of texts of about limit characters together: bounds what one step holds."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x or "") + 64
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
