"""Entry points of the jobs: each reads tables, gates what it made, and only then publishes it as a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates
from ..operators.keys import LastingKeys
from ..sources import files
from . import marts, silver
from .gold import DIMENSIONS, FACTS, Star


def bronze_to_silver(raw: DataFrame, root: str, version: str) -> DataFrame:
    """Splits raw transactions, writes silver and rejected rows, and returns the rows by disposition."""
    good, bad = silver.split(raw)
    for name, df in (("silver", good), ("rejected", bad)):
        files.write_snapshot(df, f"{root}/{name}", version)
    spark = raw.sparkSession
    made = {n: spark.read.parquet(f"{root}/{n}/version={version}") for n in ("silver", "rejected")}
    both = made["silver"].select(F.lit("silver").alias("disposition")).unionByName(made["rejected"].select(F.col("rejection_reason").alias("disposition")))
    counts = gates.accounting(both, "disposition")
    gates.require(raw.agg(F.count("*").alias("n")).crossJoin(F.broadcast(counts.agg(F.sum("n_rows").alias("m")))), "n = m", "rows were lost")
    return counts


def silver_to_gold(good: DataFrame, root: str, version: str) -> None:
    """The dirty track's star, written if its checks find nothing."""
    fact, merchants, dates = silver.star(good)
    gates.require(silver.star_checks(good, fact, merchants, dates), "n_violations = 0", "the star is not sound")
    files.materialise({"fact_transactions": fact, "dim_merchant": merchants, "dim_date": dates}, root, version)


def gold_to_consumption(fact: DataFrame, merchants: DataFrame, root: str, version: str) -> dict[str, int]:
    """The summaries, each written only if it adds up; their rows by name."""
    made = {f"{c}_summary": silver.summarize(fact, c) for c in ("transaction_status", "currency_code", "card_network", "mcc", "country_code")}
    made |= {"merchant_summary": silver.merchant_summary(fact, merchants), "daily_trend": silver.daily_trend(fact)}
    return {n: marts.write_reconciled(df, fact, f"{root}/{n}", "transaction_count", "total_amount", "amount", version) for n, df in made.items()}


def rebuild_gold(spark: SparkSession, sf_dir: str, root: str, version: str, allow: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Dimensions, facts and marts, written if the gate finds nothing but in the checks that are allowed to fail. Keys are those of the registries below root, which every rebuild extends and none changes."""
    star = Star(spark, sf_dir, LastingKeys(spark, f"{root}/_keys"))
    gates.require(star.gate().filter(~F.col("check_name").isin(*allow)), "n_violations = 0", "the gate is shut")
    made = {f"dim_{n}": star.dimension(n) for n in (*DIMENSIONS, "date")} | {f"fact_{n}": star.fact(n) for n in FACTS}
    made |= {n: m.build(star) for n, m in marts.MARTS.items()}
    files.materialise(made, root, version)
    return made
