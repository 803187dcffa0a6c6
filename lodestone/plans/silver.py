"""The dirty-transactions track: flags, rejections, keep-first, normalised rows, star and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sunday_calendar
from ..operators import checks, dedupe, gates, keys
from .entities import CURRENCIES, STATUSES


def flags() -> dict[str, F.Column]:
    code = F.upper(F.trim("currency_code"))
    return {
        "missing_transaction_id": checks.required(F.col("transaction_id")),
        "missing_merchant_id": checks.required(F.col("merchant_id")),
        "invalid_amount": checks.positive(F.col("amount").try_cast("decimal(18,2)")),
        "invalid_currency": checks.one_of(code, CURRENCIES),
        "invalid_timestamp": F.col("transaction_timestamp").try_cast("timestamp").isNotNull(),
        "invalid_status": checks.one_of(F.upper(F.trim("transaction_status")), STATUSES),
    }


def split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(silver rows, rejected raw rows with rejection_reason); every input row is in one of them."""
    marked = raw.withColumn("rejection_reason", F.array_join(checks.failing(flags()), ";"))
    good, bad = marked.filter("rejection_reason = ''"), marked.filter("rejection_reason <> ''")
    first, again = dedupe.keep_first(good, ["transaction_id"], ["seq"])
    rejected = bad.unionByName(again.withColumn("rejection_reason", F.lit("duplicate_transaction_id")))
    silver = first.select(
        F.trim("transaction_id").alias("transaction_id"), "merchant_id", F.col("amount").try_cast("decimal(18,2)").alias("amount"), F.upper(F.trim("currency_code")).alias("currency_code"),
        F.col("transaction_timestamp").try_cast("date").alias("txn_date"), F.upper(F.trim("transaction_status")).alias("transaction_status"), F.upper(F.trim("card_network")).alias("card_network"),
        F.trim("merchant_name").alias("merchant_name"), F.trim("mcc").alias("mcc"), F.upper(F.trim("country_code")).alias("country_code"), F.col("transaction_timestamp").try_cast("timestamp").alias("transaction_timestamp"),
        F.current_date().alias("ingestion_date"), F.current_timestamp().alias("processed_at"),
    )
    return silver, rejected


def observed_dates(silver: DataFrame) -> DataFrame:
    days = silver.select(F.col("txn_date").alias("full_date")).distinct()
    return days.select("full_date", *[c.alias(n) for n, c in sunday_calendar(F.col("full_date")).items()])


def star(silver: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fact, merchants, dates): a key for each distinct (merchant_id, merchant_name) in their order, and the observed dates; a miss leaves a null key."""
    names = silver.select("merchant_id", "merchant_name").distinct()
    # a struct sorts as its fields do, so one column stands for both
    pair = names.select(F.to_json(F.array("merchant_id", "merchant_name")).alias("_pair"), "merchant_id", "merchant_name").withColumn("_sort", F.concat_ws("\x00", "merchant_id", "merchant_name"))
    keyed = keys.assign_keys(pair, silver.sparkSession.createDataFrame([], "_sort string, surrogate_key int"), "_sort")
    merchants = pair.join(keyed, "_sort").select(F.col("surrogate_key").alias("merchant_key"), "merchant_id", "merchant_name")
    dates = observed_dates(silver)
    by_id = merchants.select("merchant_key", F.col("merchant_id").alias("_id"), F.col("merchant_name").alias("_name"))
    x = silver.join(by_id, (silver["merchant_id"] == F.col("_id")) & silver["merchant_name"].eqNullSafe(F.col("_name")), "left").drop("_id", "_name")
    x = x.join(dates.select("date_key", "full_date"), x["txn_date"] == F.col("full_date"), "left").drop("full_date")
    return x, merchants, dates


def merchant_summary(fact: DataFrame, merchants: DataFrame) -> DataFrame:
    """By merchant; the names are joined to the groups, not to the rows."""
    by_key = summarize(fact, "merchant_key")
    return by_key.join(merchants, "merchant_key", "left").select("merchant_key", "merchant_id", "merchant_name", "transaction_count", "total_amount")


def star_checks(silver: DataFrame, fact: DataFrame, merchants: DataFrame, dates: DataFrame) -> DataFrame:
    """(check_name, n_violations): one aggregate over the fact, and a grouping or an anti-join for each of the rest."""
    rows = gates.count_identity("rows differ", silver, fact)
    named = {"missing merchant_key": F.col("merchant_key").isNull(), "missing date_key": F.col("date_key").isNull(), "amount not positive": ~F.coalesce(F.col("amount") > 0, F.lit(False))}
    one = fact.agg(*[F.count_if(c).alias(n) for n, c in named.items()]).unpivot([], list(named), "check_name", "n_violations")
    rest = gates.reference_report({
        "repeated transaction_id": gates.repeated_keys(fact, ["transaction_id"]), "repeated merchant_id": gates.repeated_keys(merchants, ["merchant_id"]), "repeated date_key": gates.repeated_keys(dates, ["date_key"]),
        "merchant_key not in dimension": gates.orphans(fact, "merchant_key", merchants, "merchant_key"), "date_key not in dimension": gates.orphans(fact, "date_key", dates, "date_key"),
    })
    return rows.unionByName(one).unionByName(rest)


def summarize(df: DataFrame, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count("*").alias("transaction_count"), F.sum("amount").cast("decimal(28,2)").alias("total_amount"))


def daily_trend(silver: DataFrame) -> DataFrame:
    """Summaries by day; a day's attributes are worked out once for each day, after the grouping."""
    by_day = summarize(silver.withColumnRenamed("txn_date", "full_date"), "full_date")
    attributes = sunday_calendar(F.col("full_date"))
    return by_day.select(*[attributes[c].alias(c) for c in ("date_key", "day_name", "is_weekend")], "full_date", "transaction_count", "total_amount")
