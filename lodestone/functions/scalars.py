"""Scalar expressions: cleaning, casting, keys, calendars, hashes and money rules. None of them fails on bad input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_or_null(c: Column) -> Column:
    """Without white space at either end; blank is null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def upper_or_null(c: Column) -> Column:
    return F.upper(trim_or_null(c))


def yes_no(c: Column) -> Column:
    low = F.lower(trim_or_null(c))
    return F.when(low.isin("yes", "y", "true", "1"), True).when(low.isin("no", "n", "false", "0"), False)


def int_or_null(c: Column) -> Column:
    bare = trim_or_null(c)
    return F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("int"))


def double_or_null(c: Column) -> Column:
    return trim_or_null(c).try_cast("double")


def decimal_or_null(c: Column, precision: int = 18, scale: int = 4) -> Column:
    return trim_or_null(c).try_cast(f"decimal({precision},{scale})")


def date_or_null(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def timestamp_or_null(c: Column) -> Column:
    return trim_or_null(c).try_cast("timestamp")


def date_from_days(c: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), c.try_cast("int"))


def timestamp_from_micros(c: Column) -> Column:
    return F.timestamp_micros(c.try_cast("long"))


def date_key(c: Column) -> Column:
    """yyyyMMdd as an integer."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def iso_calendar(d: Column) -> dict[str, Column]:
    """Calendar attributes with Monday as day 1."""
    return {
        "date_key": date_key(d), "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "day": F.dayofmonth(d),
        "day_of_week": (F.weekday(d) + 1).cast("int"), "week_of_year": F.weekofyear(d), "is_weekend": F.weekday(d) >= 5,
    }


def sunday_calendar(d: Column) -> dict[str, Column]:
    """Calendar attributes with Sunday as day 1."""
    return {
        "date_key": date_key(d), "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "month_name": F.date_format(d, "MMMM"),
        "day": F.dayofmonth(d), "day_of_week": F.dayofweek(d), "day_name": F.date_format(d, "EEEE"), "is_weekend": F.dayofweek(d).isin(1, 7),
    }


def clean_array(c: Column) -> Column:
    """Trimmed elements without the blank ones; null when none is left."""
    kept = F.filter(F.transform(c, trim_or_null), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def first_json_key(c: Column) -> Column:
    return F.get(F.map_keys(F.from_json(c, "map<string,string>")), F.lit(0))


#: Nulls are written out, and times keep their microseconds.
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def record_hash(names: Sequence[str]) -> Column:
    """SHA-256 of the named columns in order of name; a null differs from an absent value and from an empty one."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), JSON), 256)


def fee(amount: Column, rate: str = "0.015") -> Column:
    return F.round(amount * F.lit(rate).cast("decimal(6,4)"), 2).cast("decimal(18,4)")


def reward(amount: Column, kind: Column, value: Column, least: Column) -> Column:
    """A share of the amount, or a fixed sum; nothing below the least amount."""
    paid = F.when(kind == "CASHBACK_PCT", F.round(amount * value, 2)).otherwise(value)
    return F.when(amount >= least, paid).otherwise(F.lit(0)).cast("decimal(18,4)")


def campaign_status(start: Column, end: Column, today: Column) -> Column:
    return F.when(end < today, "ENDED").when(start > today, "SCHEDULED").otherwise("ACTIVE")


def match_status(variance: Column) -> Column:
    return F.when(variance == 0, "MATCHED").otherwise("EXCEPTION")


def run_id(now: Column | None = None) -> Column:
    """run_ and the time in UTC, so that names sort by time."""
    return F.concat(F.lit("run_"), F.date_format(F.current_timestamp() if now is None else now, "yyyyMMdd'T'HHmmss'Z'"))
