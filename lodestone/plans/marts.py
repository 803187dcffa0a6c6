"""Marts at their declared grains, the measures over them, and report queries: measures by dimensions, with slicers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates
from .gold import Star

APPROVED, DECLINED = "transaction_status = 'APPROVED'", "transaction_status = 'DECLINED'"


@dataclass(frozen=True)
class Mart:
    """Aggregates of an enriched fact (or of another mart) by its grain; slicers: column -> value."""

    source: str
    grain: tuple[str, ...]
    aggregates: Mapping[str, str]
    slicers: tuple[tuple[str, str], ...] = ()

    def of(self, df: DataFrame) -> DataFrame:
        for column, value in self.slicers:
            df = df.filter(F.col(column) == F.lit(value))
        return df.groupBy(*self.grain).agg(*[F.expr(e).alias(n) for n, e in self.aggregates.items()])

    def build(self, star: Star) -> DataFrame:
        if self.source in MARTS:
            return self.of(MARTS[self.source].build(star))
        named = {*self.grain, *(c for c, _ in self.slicers), *re.findall(r"[a-z_]+", " ".join(self.aggregates.values()))}
        return self.of(star.enriched(self.source, named))

    def sql(self) -> str:
        source = f"({MARTS[self.source].sql()})" if self.source in MARTS else f"n_{self.source}"
        where = " WHERE " + " AND ".join(f"{c} = '{v}'" for c, v in self.slicers) if self.slicers else ""
        picked = [*self.grain, *[f"CAST({e} AS {'BIGINT' if n.endswith('count') else 'DOUBLE'}) AS {n}" if not e.startswith(("min", "max")) else f"{e} AS {n}" for n, e in self.aggregates.items()]]
        return f"SELECT {', '.join(picked)} FROM {source}{where}" + (f" GROUP BY {', '.join(self.grain)}" if self.grain else "")


OUTCOMES = {"transaction_count": "count(*)", "approved_amount_total": f"sum(CASE WHEN {APPROVED} THEN amount ELSE 0 END)", "declined_count": f"count(CASE WHEN {DECLINED} THEN 1 END)"}
MARTS = {
    "transaction_mart": Mart("transactions", ("full_date", "year", "month", "month_name", "currency_code", "transaction_status"), {"transaction_count": "count(*)", "amount_total": "sum(amount)"}),
    "merchant_mart": Mart("transactions", ("merchant_key", "merchant_id", "merchant_name", "mcc_code", "mcc_description"), OUTCOMES),
    "client_program_mart": Mart("transactions", ("client_key", "client_id", "client_legal_name", "program_key", "program_id", "program_name", "program_type"), OUTCOMES),
    "settlement_mart": Mart(
        "settlements", ("settlement_batch_id", "currency_code"),
        {"batch_start_date": "min(full_date)", "batch_end_date": "max(full_date)", "settlement_count": "count(*)", "settlement_amount_total": "sum(settlement_amount)", "fee_amount_total": "sum(fee_amount)", "net_amount_total": "sum(net_amount)"},
    ),
    "reconciliation_mart": Mart(
        "reconciliation", ("full_date", "year", "month", "month_name", "match_status"),
        {"reconciliation_count": "count(*)", "expected_amount_total": "sum(expected_amount)", "actual_amount_total": "sum(actual_amount)", "variance_total": "sum(variance)"},
    ),
    "rewards_mart": Mart("rewards", ("offer_key", "offer_id", "offer_type", "campaign_key", "campaign_id", "campaign_name", "qualification_status"), {"reward_event_count": "count(*)", "reward_amount_total": "sum(reward_amount)"}),
}

#: Measure -> (mart, aggregate, filter).
MEASURES = {
    "Total Transactions": ("transaction_mart", "sum(transaction_count)", "TRUE"),
    "Total Transaction Amount": ("transaction_mart", "sum(amount_total)", "TRUE"),
    "Approved Amount": ("transaction_mart", "sum(amount_total)", APPROVED),
    "Declined Amount": ("transaction_mart", "sum(amount_total)", DECLINED),
    "Declined Transactions": ("transaction_mart", "sum(transaction_count)", DECLINED),
    "Merchant Transaction Count": ("merchant_mart", "sum(transaction_count)", "TRUE"),
    "Merchant Approved Amount": ("merchant_mart", "sum(approved_amount_total)", "TRUE"),
    "Merchant Declined Count": ("merchant_mart", "sum(declined_count)", "TRUE"),
    "Client Transaction Count": ("client_program_mart", "sum(transaction_count)", "TRUE"),
    "Client Approved Amount": ("client_program_mart", "sum(approved_amount_total)", "TRUE"),
    "Client Declined Count": ("client_program_mart", "sum(declined_count)", "TRUE"),
    "Settlement Amount Total": ("settlement_mart", "sum(settlement_amount_total)", "TRUE"),
    "Settlement Fee Total": ("settlement_mart", "sum(fee_amount_total)", "TRUE"),
    "Settlement Net Total": ("settlement_mart", "sum(net_amount_total)", "TRUE"),
    "Reconciliation Expected Total": ("reconciliation_mart", "sum(expected_amount_total)", "TRUE"),
    "Reconciliation Actual Total": ("reconciliation_mart", "sum(actual_amount_total)", "TRUE"),
    "Reconciliation Difference": ("reconciliation_mart", "sum(variance_total)", "TRUE"),
}

REPORTS = {
    "amount_by_status": Mart("transaction_mart", ("transaction_status",), {"transaction_count": "sum(transaction_count)", "amount_total": "sum(amount_total)"}),
    "approved_by_month": Mart("transaction_mart", ("year", "month", "month_name"), {"amount_total": "sum(amount_total)"}, (("transaction_status", "APPROVED"),)),
    "merchant_outcomes": Mart("merchant_mart", ("merchant_id", "merchant_name"), {"transaction_count": "sum(transaction_count)", "approved_amount_total": "sum(approved_amount_total)", "declined_count": "sum(declined_count)"}),
    "client_outcomes": Mart("client_program_mart", ("client_id", "client_legal_name", "program_type"), {"transaction_count": "sum(transaction_count)", "approved_amount_total": "sum(approved_amount_total)"}),
    "settlement_by_currency": Mart("settlement_mart", ("currency_code",), {"settlement_amount_total": "sum(settlement_amount_total)", "fee_amount_total": "sum(fee_amount_total)", "net_amount_total": "sum(net_amount_total)"}),
    "exceptions_by_month": Mart("reconciliation_mart", ("year", "month"), {"reconciliation_count": "sum(reconciliation_count)", "variance_total": "sum(variance_total)"}, (("match_status", "EXCEPTION"),)),
}


def measures(star: Star) -> DataFrame:
    """(measure, value), one pass over each mart."""
    out = []
    for mart in dict.fromkeys(m for m, _, _ in MEASURES.values()):
        mine = {n: (e, f) for n, (m, e, f) in MEASURES.items() if m == mart}
        one = MARTS[mart].build(star).agg(*[F.expr(f"{e} FILTER (WHERE {f})").cast("double").alias(n) for n, (e, f) in mine.items()])
        out.append(one.unpivot([], list(mine), "measure", "value"))
    return reduce(DataFrame.unionByName, out)


def measures_sql() -> str:
    made = ", ".join(f"{n} AS ({m.sql()})" for n, m in MARTS.items())
    one = " UNION ALL ".join(f"SELECT '{n}' AS measure, CAST({e} FILTER (WHERE {f}) AS DOUBLE) AS value FROM {m}" for n, (m, e, f) in MEASURES.items())
    return f", {made} {one}"


def write_reconciled(mart: DataFrame, fact: DataFrame, path: str, count: str, total: str, amount: str, version: str) -> int:
    """Writes the mart as a new version, but only if its counts and totals add up to the fact's; returns its rows."""
    from ..sources import files

    gates.require(gates.reconcile(mart, fact, count, total, amount), "passed", "the mart doesn't add up to its fact")
    files.write_snapshot(mart, path, version)
    return mart.sparkSession.read.parquet(f"{path}/version={version}").count()


def missing_marts(spark, root: str, expected: Mapping[str, Sequence[str]]) -> list[str]:
    """All that is wrong with the marts below root: absent ones, and columns other than expected, in order."""
    from ..sources import files

    problems = []
    for name, columns in expected.items():
        found = files.read_current(spark, f"{root}/{name}")
        if found is None:
            problems.append(f"{name}: there is none")
        elif lacking := [c for c in columns if c not in found.columns]:
            problems.append(f"{name}: lacks {', '.join(lacking)}")
    return problems
