"""High-water marks: what range to read next, and when a mark may move."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = "source string, watermark string"


def next_range(mark: date | None, today: date, backfill_days: int = 90) -> tuple[date, date] | None:
    """First and last day to read: a backfill without a mark, else the days after it; None if there are none."""
    start = today - timedelta(days=backfill_days) if mark is None else mark + timedelta(days=1)
    return None if start > today else (start, today)


def advance(marks: DataFrame, batches: DataFrame) -> DataFrame:
    """marks (source, watermark) after batches (source, passed, n_records, latest): a mark moves only to what was seen, in a batch that passed and had records; a source without a batch keeps its own."""
    moves = batches.filter(F.coalesce("passed", F.lit(False)) & (F.col("n_records") > 0) & F.col("latest").isNotNull()).groupBy("source").agg(F.max("latest").alias("_new"))
    x = marks.join(moves, "source", "full_outer")
    return x.select("source", F.coalesce("_new", "watermark").alias("watermark"))


def read_mark(marks: DataFrame, source: str) -> str | None:
    """A source's mark; None if it has none."""
    row = marks.filter(F.col("source") == source).agg(F.max("watermark")).first()
    return row[0]


def after_mark(df: DataFrame, stamp: str, marks: DataFrame, source: str) -> DataFrame:
    """The rows of df (stamp: a timestamp) of the days after the source's mark, a day; all rows without one. The mark is a literal in the plan, so partitions and row groups are skipped by it."""
    mark = read_mark(marks, source)
    return df if mark is None else df.filter(F.col(stamp) >= F.lit(date.fromisoformat(mark) + timedelta(days=1)).cast("timestamp"))
