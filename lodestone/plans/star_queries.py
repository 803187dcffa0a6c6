"""Registered queries over the star: its dimensions, facts, gate, enriched joins, marts and measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, keys
from ..sources.stored import shared_path, stored
from . import marts
from .entities import table
from .gold import CALENDAR, DIMENSIONS, FACTS, SCD_START, Star, gate_sql, star_sql
from .registry import query

STAR = star_sql()


def _picked(columns, kinds: dict[str, str]) -> str:
    return ", ".join(f"CAST({c} AS {kinds[c]}) AS {c}" if c in kinds else c for c in columns)


MONEY = dict.fromkeys(("amount", "mcc_confidence", "settlement_amount", "fee_amount", "net_amount", "expected_amount", "actual_amount", "variance", "reward_amount", "offer_value", "min_transaction_amount"), "DOUBLE")

for _name, _d in DIMENSIONS.items():
    _columns = (f"{_name}_key", _d.natural, *_d.attributes, *_d.refs, *_d.always)
    query(f"WITH {STAR} SELECT {_picked(_columns, MONEY)} FROM d_{_name}", f"dim_{_name}")(lambda spark, sf, n=_name: Star(spark, sf).dimension(n))
query(f"WITH {STAR} SELECT {', '.join(CALENDAR)} FROM d_date", "dim_date_spine")(lambda spark, sf: Star(spark, sf).dimension("date"))

for _name, (_, _refs, _cols, _, _) in FACTS.items():
    query(f"WITH {STAR} SELECT {_picked(('date_key', *_refs, *_cols), MONEY)} FROM f_{_name}", f"fact_{_name}")(lambda spark, sf, n=_name: Star(spark, sf).fact(n))

query(f"WITH {STAR} {gate_sql()}", "gold_gate")(lambda spark, sf: Star(spark, sf).gate())
query(
    f"WITH {STAR} SELECT CAST(approved AS DOUBLE) AS approved, CAST(settled AS DOUBLE) AS settled, CAST(expected AS DOUBLE) AS expected, coalesce(approved = settled AND settled = expected, FALSE) AS passed FROM totals", "control_totals"
)(lambda spark, sf: Star(spark, sf).control_totals())


@query(f"WITH {STAR} SELECT CAST(approved AS DOUBLE) AS approved, CAST(settled AS DOUBLE) AS settled, CAST(expected AS DOUBLE) AS expected, round(approved, 2) = round(settled, 2) AND round(settled, 2) = round(expected, 2) AS identical FROM totals")
def control_total_identity(spark, sf):
    """The totals as three scalar subqueries, compared to the cent; a missing total is not identical."""
    star = Star(spark, sf)
    return spark.sql(
        """WITH t AS (SELECT (SELECT sum(amount) FROM {f} WHERE transaction_status = 'APPROVED') AS approved, (SELECT sum(settlement_amount) FROM {s}) AS settled, (SELECT sum(expected_amount) FROM {r}) AS expected)
        SELECT CAST(approved AS DOUBLE) AS approved, CAST(settled AS DOUBLE) AS settled, CAST(expected AS DOUBLE) AS expected, coalesce(round(approved, 2) = round(settled, 2) AND round(settled, 2) = round(expected, 2), false) AS identical FROM t""",
        f=star.fact("transactions", ()), s=star.fact("settlements", ()), r=star.fact("reconciliation", ()),
    )


ENRICHED = {
    "transactions": "transaction_id full_date year month month_name merchant_id merchant_name mcc_code mcc_description currency_code program_id program_name program_type client_id client_legal_name transaction_status amount",
    "settlements": "settlement_id settlement_batch_id full_date year month month_name currency_code settlement_amount fee_amount net_amount",
    "reconciliation": "reconciliation_id settlement_id full_date year month month_name match_status expected_amount actual_amount variance settlement_batch_id currency_code settlement_amount settlement_date",
    "rewards": "reward_id kafka_offset full_date year month month_name currency_code offer_id offer_type campaign_id campaign_name qualification_status reward_amount",
}
for _name, _cols in ENRICHED.items():
    query(f"WITH {STAR} SELECT {_picked(_cols.split(), MONEY)} FROM n_{_name}", f"enriched_{_name}")(lambda spark, sf, n=_name, c=_cols: Star(spark, sf).enriched(n).select(*c.split()))

for _name, _m in marts.MARTS.items():
    query(f"WITH {STAR} {_m.sql()}", f"star_{_name}")(lambda spark, sf, m=_m: m.build(Star(spark, sf)))

query(f"WITH {STAR} {marts.measures_sql()}", "bi_measures")(lambda spark, sf: marts.measures(Star(spark, sf)))
for _name, _r in marts.REPORTS.items():
    query(f"WITH {STAR} {_r.sql()}", f"report_{_name}")(lambda spark, sf, r=_r: r.build(Star(spark, sf)))


@query(f"""WITH {STAR} SELECT *, events = expected AS passed FROM (SELECT event_type, count(*) AS events, CASE event_type WHEN 'AUTHORIZATION' THEN (SELECT count(*) FROM e_transaction) ELSE (SELECT count(*) FROM e_transaction WHERE status = 'APPROVED') END AS expected
 FROM e_transaction_event GROUP BY event_type)""")
def event_composition(spark, sf):
    """Events by type against the transactions they must be as many as."""
    star = Star(spark, sf)
    due = star.entity("transaction").agg(F.count("*").alias("AUTHORIZATION"), F.count_if(F.col("status") == "APPROVED").alias("CAPTURE"))
    due = due.unpivot([], ["AUTHORIZATION", "CAPTURE"], "event_type", "expected")
    found = star.entity("transaction_event").groupBy("event_type").agg(F.count("*").alias("events"))
    return found.join(F.broadcast(due), "event_type").select("event_type", "events", "expected", (F.col("events") == F.col("expected")).alias("passed"))


@query(f"""WITH {STAR}, v AS (
 SELECT 'settlement_is_transaction_amount' AS check_name, s.settlement_id AS id FROM e_settlement s JOIN e_transaction t ON s.transaction_id = t.transaction_id WHERE s.settlement_amount <> t.amount
 UNION ALL SELECT 'net_is_amount_less_fee', settlement_id FROM e_settlement WHERE net_amount <> settlement_amount - fee_amount
 UNION ALL SELECT 'expected_is_settlement_amount', r.reconciliation_id FROM e_reconciliation r JOIN e_settlement s ON r.settlement_id = s.settlement_id WHERE r.expected_amount <> s.settlement_amount
 UNION ALL SELECT 'variance_is_difference', reconciliation_id FROM e_reconciliation WHERE variance <> actual_amount - expected_amount
 UNION ALL SELECT 'matched_iff_no_variance', reconciliation_id FROM e_reconciliation WHERE (match_status = 'MATCHED') <> (variance = 0)
 UNION ALL SELECT 'settled_within_a_day', s.settlement_id FROM e_settlement s JOIN e_transaction t ON s.transaction_id = t.transaction_id WHERE s.settlement_date > t.txn_date + 1)
 SELECT c.check_name, count(v.id) AS n_violations FROM (SELECT unnest(['settlement_is_transaction_amount', 'net_is_amount_less_fee', 'expected_is_settlement_amount', 'variance_is_difference', 'matched_iff_no_variance', 'settled_within_a_day']) AS check_name) c
 LEFT JOIN v ON c.check_name = v.check_name GROUP BY c.check_name""")
def arithmetic_cross_checks(spark, sf):
    """Amounts and dates across transactions, settlements and reconciliations; the last rule is one that the data breaks."""
    star = Star(spark, sf)
    t = star.entity("transaction").select("transaction_id", "amount", "txn_date")
    s, r = star.entity("settlement"), star.entity("reconciliation")
    st = s.join(t, "transaction_id")
    rs = r.join(s.select("settlement_id", "settlement_amount"), "settlement_id")
    from ..operators import gates

    return gates.reference_report({
        "settlement_is_transaction_amount": st.filter("settlement_amount <> amount"), "net_is_amount_less_fee": s.filter("net_amount <> settlement_amount - fee_amount"),
        "expected_is_settlement_amount": rs.filter("expected_amount <> settlement_amount"), "variance_is_difference": r.filter("variance <> actual_amount - expected_amount"),
        "matched_iff_no_variance": r.filter("(match_status = 'MATCHED') <> (variance = 0)"), "settled_within_a_day": st.filter("settlement_date > date_add(txn_date, 1)"),
    })


@query(f"""WITH {STAR} SELECT 'client' AS child, 'lei' AS column_name, count(*) FILTER (lei IS NULL) AS n_null, count(*) FILTER (lei IS NOT NULL AND lei NOT IN (SELECT lei FROM e_legal_entity)) AS n_orphans FROM e_client
 UNION ALL SELECT 'program', 'client_id', count(*) FILTER (client_id IS NULL), count(*) FILTER (client_id NOT IN (SELECT client_id FROM e_client WHERE client_type = 'PROGRAM_OWNER')) FROM e_program
 UNION ALL SELECT 'offer', 'eligible_mcc_code', 0, count(*) FILTER (eligible_mcc_code IS NOT NULL AND eligible_mcc_code NOT IN (SELECT mcc_code FROM e_mcc)) FROM e_offer
 UNION ALL SELECT 'transaction', 'token_id', count(*) FILTER (token_id IS NULL), count(*) FILTER (token_id NOT IN (SELECT token_id FROM e_card_token)) FROM e_transaction
 UNION ALL SELECT 'transaction', 'decline_reason', count(*) FILTER (decline_reason IS NULL), count(*) FILTER (decline_reason IS NOT NULL) FROM e_transaction""")
def dataset_references(spark, sf):
    """References between entities: nulls count where they are forbidden, and a parent may be a subset of its table."""
    star = Star(spark, sf)
    none = spark.createDataFrame([], "reason string")
    rules = (
        ("client", "lei", star.entity("legal_entity"), "lei", False), ("program", "client_id", star.entity("client").filter("client_type = 'PROGRAM_OWNER'"), "client_id", False),
        ("offer", "eligible_mcc_code", star.entity("mcc"), "mcc_code", True), ("transaction", "token_id", star.entity("card_token"), "token_id", False), ("transaction", "decline_reason", none, "reason", False),
    )
    from ..operators import gates

    return gates.references([(child, column, star.entity(child), parent, key, optional) for child, column, parent, key, optional in rules])


@query("""WITH s AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || c_mktsegment AS bin, c_mktsegment AS brand, CASE WHEN c_nationkey % 5 = 0 THEN '  ' ELSE n_name END AS issuer FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
 SELECT count(*) AS n_rows, count(DISTINCT bin) AS bins, count(DISTINCT brand) AS brands, count(DISTINCT nullif(trim(issuer), '')) AS issuers, count(*) FILTER (trim(issuer) = '') AS blank_issuers,
 round(100.0 * count(*) FILTER (trim(issuer) = '') / count(*), 1)::DOUBLE AS blank_issuer_percent FROM s""")
def issuer_profile(spark, sf):
    """Distinct values and the share of blanks."""
    from .entities import table

    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    bare = F.nullif(F.trim(F.when(F.col("c_nationkey") % 5 == 0, "  ").otherwise(F.col("n_name"))), F.lit(""))
    x = x.select(F.concat_ws("-", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), "c_mktsegment").alias("bin"), F.col("c_mktsegment").alias("brand"), bare.alias("issuer"))
    out = x.agg(F.count("*").alias("n_rows"), F.count_distinct("bin").alias("bins"), F.count_distinct("brand").alias("brands"), F.count_distinct("issuer").alias("issuers"), F.count_if(F.col("issuer").isNull()).alias("blank_issuers"))
    return out.withColumn("blank_issuer_percent", F.round(100.0 * F.col("blank_issuers") / F.col("n_rows"), 1))


@query(f"""WITH {STAR} SELECT *, source_rows = target_rows AS passed FROM (SELECT 'transactions' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM f_transactions) AS target_rows
 UNION ALL SELECT 'merchants', (SELECT count(*) FROM supplier), (SELECT count(*) FROM d_merchant WHERE merchant_key <> -1)
 UNION ALL SELECT 'card_tokens', (SELECT count(*) FROM customer), (SELECT count(*) FROM d_card_token WHERE card_token_key <> -1))""")
def source_target_counts(spark, sf):
    """Rows of sources and of what was made of them."""
    from ..operators import gates
    from .entities import table

    star = Star(spark, sf)
    pairs = (("transactions", "orders", star.fact("transactions")), ("merchants", "supplier", star.dimension("merchant").filter("merchant_key <> -1")), ("card_tokens", "customer", star.dimension("card_token").filter("card_token_key <> -1")))
    return gates.row_counts({name: (table(spark, sf, source), made) for name, source, made in pairs})


#: Rules of rows that hold inside one entity, by name; the second of each pair breaks some rows on purpose.
CONSTRAINTS = {
    "transaction": {"amount_positive": "amount > 0", "status_known": "status IN ('APPROVED', 'DECLINED')", "declined_iff_reason": "(status = 'DECLINED') = (decline_reason IS NOT NULL)", "confidence_share": "mcc_confidence BETWEEN 0 AND 1"},
    "settlement": {"net_identity": "net_amount = settlement_amount - fee_amount", "fee_limit": "fee_amount <= 4000"},
    "reconciliation": {"variance_identity": "variance = actual_amount - expected_amount", "matched_iff_no_variance": "(match_status = 'MATCHED') = (variance = 0)", "always_matched": "match_status = 'MATCHED'"},
    "offer": {"dates_in_order": "valid_from <= valid_to", "value_positive": "offer_value > 0", "kind_known": "offer_type IN ('CASHBACK_PCT', 'FIXED_AMOUNT')", "codes_below_five": "eligible_mcc_code <= 'K4'"},
    "client": {"type_known": "client_type IN ('ISSUER', 'NETWORK', 'PROGRAM_OWNER')"},
}
_KEYS = {"transaction": "transaction_id", "settlement": "settlement_id", "reconciliation": "reconciliation_id", "offer": "offer_id", "client": "client_id"}


@query(f"WITH {STAR} " + " UNION ALL ".join(f"SELECT '{e}' AS entity, {_KEYS[e]} AS record_id, '{n}' AS constraint_name FROM e_{e} WHERE NOT coalesce({c}, TRUE)" for e, rules in CONSTRAINTS.items() for n, c in rules.items()))
def constraint_violations(spark, sf):
    """Rows that break a named rule; an unknown outcome breaks none."""
    from functools import reduce

    from ..operators import checks

    star = Star(spark, sf)
    return reduce(DataFrame.unionByName, [checks.violations(star.entity(e), _KEYS[e], {n: F.expr(c) for n, c in rules.items()}).select(F.lit(e).alias("entity"), "record_id", "constraint_name") for e, rules in CONSTRAINTS.items()])


@query(f"WITH {STAR} " + " UNION ALL ".join(f"SELECT 'dim_{n}' AS table_name, 'not_null_{n}_key' AS test, count(*) FILTER ({n}_key IS NULL) AS n_failures FROM d_{n} UNION ALL SELECT 'dim_{n}', 'unique_{n}_key', (SELECT count(*) FROM (SELECT {n}_key FROM d_{n} GROUP BY 1 HAVING count(*) > 1))" for n in DIMENSIONS)
       + f" UNION ALL SELECT 'mart_' || t, 'not_null_' || c, n FROM (SELECT 'merchant_mart' AS t, 'merchant_key' AS c, count(*) FILTER (merchant_key IS NULL) AS n FROM ({marts.MARTS['merchant_mart'].sql()}))")
def column_tests(spark, sf):
    """Surrogate keys are unique and never null, in every dimension and in a mart."""
    from functools import reduce

    from ..operators import gates

    star = Star(spark, sf).keep(tuple(DIMENSIONS))
    out = [gates.column_tests(star.dimension(n), [f"{n}_key"], [f"{n}_key"]).select(F.lit(f"dim_{n}").alias("table_name"), "test", "n_failures") for n in DIMENSIONS]
    mart = gates.column_tests(marts.MARTS["merchant_mart"].build(star), (), ["merchant_key"])
    return reduce(DataFrame.unionByName, [*out, mart.select(F.lit("mart_merchant_mart").alias("table_name"), "test", "n_failures")])


@query(f"WITH {STAR} SELECT 'settlement_amount' AS check_name, count(*) FILTER (settlement_amount IS NULL) AS n_violations FROM f_settlements UNION ALL SELECT 'fee_amount', count(*) FILTER (fee_amount IS NULL) FROM f_settlements UNION ALL SELECT 'net_amount', count(*) FILTER (net_amount IS NULL) FROM f_settlements")
def missing_measures(spark, sf):
    from ..operators import gates

    return gates.missing_measures(Star(spark, sf).fact("settlements"), ["settlement_amount", "fee_amount", "net_amount"])


GENERATIONS = ("merchant", "offer", "cardholder", "card_token")
_OLD = "CAST(right({}, 1) AS INT) % 3 = 0"


def _generations_sql() -> str:
    parts = []
    for n in GENERATIONS:
        k = DIMENSIONS[n].natural
        parts.append(f"o_{n} AS (SELECT k, row_number() OVER (ORDER BY k) AS s FROM (SELECT DISTINCT {k} AS k FROM e_{n} WHERE {_OLD.format(k)}))")
        parts.append(f"g_{n} AS (SELECT '{n}' AS dimension, k AS natural_key, s, 1 AS generation FROM o_{n} UNION ALL SELECT '{n}', k, (SELECT coalesce(max(s), 0) FROM o_{n}) + row_number() OVER (ORDER BY k), 2 FROM (SELECT DISTINCT {k} AS k FROM e_{n} WHERE NOT ({_OLD.format(k)})))")
    return f"WITH {STAR}, {', '.join(parts)} SELECT dimension, natural_key, CAST(s AS INT) AS surrogate_key, generation FROM ({' UNION ALL '.join(f'SELECT * FROM g_{n}' for n in GENERATIONS)})"


@query(_generations_sql())
def lasting_keys(spark, sf):
    """Registries after two rebuilds, the second over grown tables: every key of the first stays."""
    star, lasting = Star(spark, sf), keys.LastingKeys(spark, shared_path(spark, "registries"))
    out = []
    for n in GENERATIONS:
        k = DIMENSIONS[n].natural
        first = stored(lasting.extend(n, star.entity(n).filter(_OLD.format(k)), k), "first-keys")
        both = lasting.extend(n, star.entity(n), k)
        x = both.join(first.select(k, F.lit(1).alias("generation")), k, "left").select(F.lit(n).alias("dimension"), F.col(k).alias("natural_key"), "surrogate_key", F.coalesce("generation", F.lit(2)).alias("generation"))
        out.append(x)
    return reduce(DataFrame.unionByName, out)


#: Changes of merchants: seq, merchant, name, the day it holds from. One in three says nothing new, and the second batch has late ones.
MERCHANT_CHANGES = """SELECT 10 * s_suppkey + n AS seq, 'M' || CAST(s_suppkey AS STRING) AS merchant_id, CASE WHEN n = 0 OR (s_suppkey + n) % 3 = 0 THEN s_name ELSE s_name || ' ' || CAST(n AS STRING) END AS merchant_name,
 CAST(DATE '1992-06-01' + CAST(CASE n WHEN 4 THEN 700 ELSE 400 * n END + s_suppkey % 50 AS INT) AS DATE) AS since, n >= 3 AS second FROM {supplier} CROSS JOIN (SELECT explode(sequence(0, 5)) AS n) WHERE s_suppkey % 7 <> 0 OR n < 5"""
_CHANGES = MERCHANT_CHANGES.replace("{supplier}", "supplier").replace("explode(sequence(0, 5))", "unnest(range(6))")
_VERSIONS = f"""ch AS ({_CHANGES}), pick AS (SELECT merchant_id, merchant_name, since FROM ch QUALIFY row_number() OVER (PARTITION BY merchant_id, since ORDER BY seq DESC) = 1),
 diff AS (SELECT *, lag(merchant_name) OVER (PARTITION BY merchant_id ORDER BY since) AS was FROM pick), ver AS (SELECT merchant_id, merchant_name, since AS effective_from, lead(since) OVER (PARTITION BY merchant_id ORDER BY since) AS effective_to FROM diff WHERE was IS DISTINCT FROM merchant_name),
 dim AS (SELECT *, effective_to IS NULL AS is_current, CAST(row_number() OVER (ORDER BY merchant_id || '@' || CAST(effective_from AS VARCHAR)) AS INT) AS merchant_key FROM ver)"""


def merchant_history(spark, sf) -> DataFrame:
    """The merchants' versions, with keys from a registry, after two merges of changes."""
    changes = spark.sql(MERCHANT_CHANGES, supplier=table(spark, sf, "supplier"))
    none = spark.createDataFrame([], "merchant_id string, merchant_name string, effective_from date, effective_to date, is_current boolean")
    versions = none
    for second in (False, True):
        batch = changes.filter(F.col("second") == second)
        versions = stored(history.merge_changes(versions, batch, "merchant_id", "since", ["merchant_name"], "seq"), "versions")
    versions = versions.withColumn("version", history.version_name("merchant_id"))
    registry = keys.LastingKeys(spark, shared_path(spark, "registries")).extend("merchant_version", versions, "version")
    return versions.join(registry, "version").drop("version").withColumnRenamed("surrogate_key", "merchant_key")


@query(f"WITH {_VERSIONS} SELECT merchant_key, merchant_id, merchant_name, effective_from, effective_to, is_current FROM dim UNION ALL SELECT -1, 'UNKNOWN', 'Unknown Merchant', DATE '{SCD_START}', NULL, TRUE")
def dim_merchant_history(spark, sf):
    """Merchants in all their versions."""
    x = merchant_history(spark, sf).select("merchant_key", "merchant_id", "merchant_name", *history.INTERVAL)
    unknown = ["-1", "'UNKNOWN'", "'Unknown Merchant'", f"DATE '{SCD_START}'", "CAST(NULL AS DATE)", "TRUE"]
    return x.unionByName(spark.range(1).select(*[F.expr(e).alias(c) for e, c in zip(unknown, x.columns, strict=True)]))


@query(f"""WITH {STAR}, {_VERSIONS} SELECT t.transaction_id, coalesce(d.merchant_key, -1) AS merchant_key, d.merchant_name FROM e_transaction t LEFT JOIN dim d ON t.merchant_id = d.merchant_id AND t.txn_date >= d.effective_from AND (d.effective_to IS NULL OR t.txn_date < d.effective_to)""")
def fact_merchant_as_of(spark, sf):
    """Transactions with the version of their merchant that held on their day."""
    versions = stored(merchant_history(spark, sf), "merchants")
    facts = Star(spark, sf).entity("transaction").select("transaction_id", "merchant_id", "txn_date")
    x = history.lookup_as_of(facts, "merchant_id", "txn_date", versions, "merchant_id", "merchant_key", "merchant_key")
    return x.join(versions.select("merchant_key", "merchant_name"), "merchant_key", "left").select("transaction_id", "merchant_key", "merchant_name")
