"""The business entities as views of the given tables, each with the same rows in SQL.

Orders are transactions, customers cardholders, nations programs and regions clients; suppliers
are merchants and line items settlements. Money is decimal from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING' ELSE 'DECLINED' END"
CURRENCIES, STATUSES = ("GBP", "EUR", "USD"), ("APPROVED", "DECLINED", "PENDING", "REFUNDED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS transaction_id", "o_custkey AS cardholder_id", "cast(o_totalprice AS decimal(18,2)) AS amount",
        "cast(o_orderdate AS date) AS txn_date", f"{STATUS} AS status", "o_orderpriority AS network",
    )


TRANSACTIONS = f"""txn AS (SELECT o_orderkey AS transaction_id, o_custkey AS cardholder_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CAST(o_orderdate AS DATE) AS txn_date, {STATUS} AS status, o_orderpriority AS network FROM orders)"""


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    fee = F.round(gross * F.lit("0.015").cast("decimal(6,4)"), 2).cast("decimal(18,2)")
    x = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", gross.alias("gross"), fee.alias("fee"), F.col("l_shipdate").cast("date").alias("settlement_date"),
        F.round(gross * (1 - F.col("l_discount").cast("decimal(6,2)")), 2).cast("decimal(18,2)").alias("actual"), "l_returnflag",
    )
    return x.withColumns({"net": (F.col("gross") - F.col("fee")).cast("decimal(18,2)"), "variance": (F.col("actual") - F.col("gross")).cast("decimal(18,2)"), "batch_id": F.concat(F.lit("BATCH-"), F.col("settlement_date").cast("string"))})


SETTLEMENTS = """stl0 AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, l_discount, l_returnflag, CAST(l_shipdate AS DATE) AS settlement_date FROM lineitem),
stl1 AS (SELECT *, CAST(round(gross * CAST(0.015 AS DECIMAL(6,4)), 2) AS DECIMAL(18,2)) AS fee, CAST(round(gross * (1 - CAST(l_discount AS DECIMAL(6,2))), 2) AS DECIMAL(18,2)) AS actual FROM stl0),
stl AS (SELECT *, CAST(gross - fee AS DECIMAL(18,2)) AS net, CAST(actual - gross AS DECIMAL(18,2)) AS variance, 'BATCH-' || CAST(settlement_date AS VARCHAR) AS batch_id FROM stl1)"""


def dirty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string transactions with defects by fixed rules, and their sequence."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq",
        "CASE WHEN o_orderkey % 53 = 0 THEN ' ' WHEN o_orderkey % 41 = 0 THEN cast(o_orderkey + 1 AS string) ELSE cast(o_orderkey AS string) END AS transaction_id",
        "CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE cast(o_custkey AS string) END AS merchant_id", "concat('Shop ', cast(o_custkey % 700 AS string), ' ') AS merchant_name",
        "cast(5000 + o_orderkey % 40 AS string) AS mcc", "CASE o_custkey % 4 WHEN 0 THEN 'gb' WHEN 1 THEN ' FR' WHEN 2 THEN 'de' ELSE 'ES' END AS country_code",
        "CASE WHEN o_orderkey % 59 = 0 THEN 'N/A' WHEN o_orderkey % 61 = 0 THEN '-15.00' ELSE cast(cast(o_totalprice AS decimal(18,2)) AS string) END AS amount",
        "CASE WHEN o_orderkey % 67 = 0 THEN 'XXX' WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'usd' WHEN o_orderkey % 3 = 1 THEN ' EUR' ELSE 'GBP' END AS currency_code",
        "CASE WHEN o_orderkey % 73 = 0 THEN 'not-a-date' ELSE cast(cast(o_orderdate AS date) AS string) END AS transaction_timestamp",
        f"CASE WHEN o_orderkey % 79 = 0 THEN 'UNKNOWN_STATE' ELSE {STATUS} END AS transaction_status",
        "lower(o_orderpriority) AS card_network",
    )


DIRTY = f"""dirty AS (SELECT o_orderkey AS seq,
  CASE WHEN o_orderkey % 53 = 0 THEN ' ' WHEN o_orderkey % 41 = 0 THEN CAST(o_orderkey + 1 AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS transaction_id,
  CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS merchant_id, 'Shop ' || CAST(o_custkey % 700 AS VARCHAR) || ' ' AS merchant_name,
  CAST(5000 + o_orderkey % 40 AS VARCHAR) AS mcc, CASE o_custkey % 4 WHEN 0 THEN 'gb' WHEN 1 THEN ' FR' WHEN 2 THEN 'de' ELSE 'ES' END AS country_code,
  CASE WHEN o_orderkey % 59 = 0 THEN 'N/A' WHEN o_orderkey % 61 = 0 THEN '-15.00' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
  CASE WHEN o_orderkey % 67 = 0 THEN 'XXX' WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'usd' WHEN o_orderkey % 3 = 1 THEN ' EUR' ELSE 'GBP' END AS currency_code,
  CASE WHEN o_orderkey % 73 = 0 THEN 'not-a-date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS transaction_timestamp,
  CASE WHEN o_orderkey % 79 = 0 THEN 'UNKNOWN_STATE' ELSE {STATUS} END AS transaction_status,
  lower(o_orderpriority) AS card_network FROM orders),
flagged AS (SELECT *, array_to_string(list_filter([
  CASE WHEN trim(transaction_id) = '' THEN 'missing_transaction_id' END,
  CASE WHEN trim(merchant_id) = '' THEN 'missing_merchant_id' END,
  CASE WHEN coalesce(TRY_CAST(amount AS DECIMAL(18,2)), 0) <= 0 THEN 'invalid_amount' END,
  CASE WHEN coalesce(upper(trim(currency_code)) NOT IN ('GBP', 'EUR', 'USD'), TRUE) THEN 'invalid_currency' END,
  CASE WHEN TRY_CAST(transaction_timestamp AS TIMESTAMP) IS NULL THEN 'invalid_timestamp' END,
  CASE WHEN upper(trim(transaction_status)) NOT IN ('APPROVED', 'DECLINED', 'PENDING', 'REFUNDED') THEN 'invalid_status' END], lambda x: x IS NOT NULL), ';') AS reason FROM dirty),
ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY seq) AS n FROM flagged WHERE reason = ''),
silver AS (SELECT trim(transaction_id) AS transaction_id, merchant_id, CAST(amount AS DECIMAL(18,2)) AS amount, upper(trim(currency_code)) AS currency_code,
  CAST(transaction_timestamp AS DATE) AS txn_date, upper(trim(transaction_status)) AS transaction_status, upper(trim(card_network)) AS card_network,
  trim(merchant_name) AS merchant_name, mcc, upper(trim(country_code)) AS country_code FROM ranked WHERE n = 1)"""
