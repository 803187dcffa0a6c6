"""The registered queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import cdc, checks, dedupe, gates, keys, merge, watermarks
from ..sources.stored import stored
from . import entities as E
from . import rules, silver
from .registry import ORACLES, QUERIES, query  # noqa: F401

COUNTS = "count(*) AS transaction_count, CAST(sum(amount) AS DOUBLE) AS total_amount"


def _silver(spark, sf):
    return silver.split(E.dirty_transactions(spark, sf))


@query(f"""WITH {E.DIRTY} SELECT CAST(year(txn_date)*10000+month(txn_date)*100+day(txn_date) AS INT) AS date_key, txn_date AS full_date, dayname(txn_date) AS day_name,
 dayofweek(txn_date) IN (0, 6) AS is_weekend, {COUNTS} FROM silver GROUP BY txn_date""")
def daily_trend(spark, sf):
    return silver.daily_trend(_silver(spark, sf)[0])


@query(f"WITH {E.DIRTY}, rej AS (SELECT reason FROM flagged WHERE reason <> '' UNION ALL SELECT 'duplicate_transaction_id' FROM ranked WHERE n > 1) SELECT reason AS rejection_reason, count(*) AS n_rows FROM rej GROUP BY reason")
def rejection_reasons(spark, sf):
    return gates.accounting(_silver(spark, sf)[1], "rejection_reason")


for _name, _col in (("status_summary", "transaction_status"), ("currency_summary", "currency_code"), ("card_network_summary", "card_network"), ("mcc_summary", "mcc"), ("country_summary", "country_code")):

    def _summary(spark, sf, col=_col):
        return silver.summarize(_silver(spark, sf)[0], col)

    _summary.__name__ = _name
    query(f"WITH {E.DIRTY} SELECT {_col}, {COUNTS} FROM silver GROUP BY {_col}")(_summary)


@query(f"""WITH {E.DIRTY}, m AS (SELECT CAST(row_number() OVER (ORDER BY merchant_id, merchant_name) AS INT) AS merchant_key, merchant_id, merchant_name FROM (SELECT DISTINCT merchant_id, merchant_name FROM silver))
 SELECT m.merchant_key, m.merchant_id, m.merchant_name, {COUNTS} FROM silver s LEFT JOIN m ON s.merchant_id = m.merchant_id AND s.merchant_name = m.merchant_name GROUP BY ALL""")
def merchant_summary(spark, sf):
    star = silver.star(_silver(spark, sf)[0])
    return silver.merchant_summary(*star[:2])


@query(f"""WITH {E.DIRTY}, m AS (SELECT merchant_id FROM (SELECT DISTINCT merchant_id, merchant_name FROM silver) GROUP BY merchant_id HAVING count(*) > 1), f AS (SELECT * FROM silver)
 SELECT * FROM (SELECT 'rows differ' AS check_name, CAST(0 AS BIGINT) AS n_violations UNION ALL SELECT 'repeated transaction_id', (SELECT count(*) FROM (SELECT transaction_id FROM f GROUP BY 1 HAVING count(*) > 1))
 UNION ALL SELECT 'missing merchant_key', 0 UNION ALL SELECT 'missing date_key', 0 UNION ALL SELECT 'merchant_key not in dimension', 0 UNION ALL SELECT 'date_key not in dimension', 0
 UNION ALL SELECT 'amount not positive', (SELECT count(*) FROM f WHERE amount <= 0) UNION ALL SELECT 'repeated merchant_id', (SELECT count(*) FROM m) UNION ALL SELECT 'repeated date_key', 0)""")
def star_checks(spark, sf):
    """The dirty track's star against its silver rows."""
    good = _silver(spark, sf)[0]
    return silver.star_checks(good, *silver.star(good))


@query(f"WITH {E.DIRTY}, d AS (SELECT CASE WHEN reason <> '' THEN 'rejected' WHEN n > 1 THEN 'duplicate' ELSE 'silver' END AS disposition FROM flagged LEFT JOIN ranked USING (seq, reason)) SELECT disposition, count(*) AS n_rows FROM d GROUP BY disposition")
def disposition_accounting(spark, sf):
    good, bad = _silver(spark, sf)
    kind = F.when(F.col("rejection_reason") == "duplicate_transaction_id", "duplicate").otherwise("rejected")
    return gates.accounting(good.select(F.lit("silver").alias("disposition")).unionByName(bad.select(kind.alias("disposition"))), "disposition")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price FROM r WHERE n = 1""")
def keep_first_lineitem(spark, sf):
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    first, _ = dedupe.keep_first(E.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return first.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def repeated_line_keys(spark, sf):
    return gates.repeated_keys(E.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _enriched(spark, sf):
    t = E.transactions(spark, sf)
    c, n, r = (E.table(spark, sf, x) for x in ("customer", "nation", "region"))
    x = t.join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), t["cardholder_id"] == F.col("c_custkey"), "left")
    x = x.join(n, x["c_nationkey"] == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == r["r_regionkey"], "left")
    names = {c: F.coalesce(c, F.lit(keys.UNKNOWN_NAME)) for c in ("n_name", "r_name", "c_mktsegment")}
    return x.withColumns(names).select("transaction_id", "amount", "txn_date", "status", "network", F.col("n_name").alias("program"), F.col("r_name").alias("client"), F.col("c_mktsegment").alias("mcc"), F.coalesce("c_nationkey", F.lit(-1)).alias("program_id"))


ENRICHED = f"""{E.TRANSACTIONS}, enr AS (SELECT transaction_id, amount, txn_date, status, network, coalesce(n_name, 'UNKNOWN') AS program, coalesce(r_name, 'UNKNOWN') AS client,
 coalesce(c_mktsegment, 'UNKNOWN') AS mcc, coalesce(c_nationkey, -1) AS program_id FROM txn LEFT JOIN customer ON cardholder_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
PROGRAM_AGG = "count(*) AS transaction_count, CAST(sum(CASE WHEN status = 'APPROVED' THEN amount ELSE 0 END) AS DOUBLE) AS approved_amount, count(*) FILTER (status = 'DECLINED') AS declined_count"


def _conditional(df: DataFrame, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.count("*").alias("transaction_count"), F.sum(F.when(F.col("status") == "APPROVED", F.col("amount")).otherwise(0)).cast("decimal(28,2)").alias("approved_amount"), F.count_if(F.col("status") == "DECLINED").alias("declined_count")
    )


@query(f"WITH {ENRICHED} SELECT txn_date AS full_date, CAST(year(txn_date) AS INT) AS year, CAST(month(txn_date) AS INT) AS month, network, status, {COUNTS} FROM enr GROUP BY txn_date, network, status")
def transaction_mart(spark, sf):
    x = _enriched(spark, sf).withColumns({"full_date": F.col("txn_date"), "year": F.year("txn_date"), "month": F.month("txn_date")})
    return silver.summarize(x, "full_date", "year", "month", "network", "status")


@query(f"WITH {ENRICHED} SELECT client, program, {PROGRAM_AGG} FROM enr GROUP BY client, program")
def client_program_mart(spark, sf):
    return _conditional(_enriched(spark, sf), "client", "program")


@query(f"WITH {ENRICHED} SELECT l_suppkey AS merchant_id, p_type AS mcc, {PROGRAM_AGG} FROM (SELECT transaction_id, status, amount, l_suppkey, l_partkey FROM enr JOIN lineitem ON transaction_id = l_orderkey) LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type")
def merchant_mart(spark, sf):
    li = E.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("merchant_id"), "l_partkey")
    x = E.transactions(spark, sf).join(li, F.col("transaction_id") == F.col("l_orderkey"))
    x = x.join(E.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("mcc")), F.col("l_partkey") == F.col("p_partkey"), "left")
    return _conditional(x, "merchant_id", "mcc")


@query(f"""WITH {E.SETTLEMENTS} SELECT batch_id, l_returnflag AS currency, min(settlement_date) AS first_date, max(settlement_date) AS last_date, count(*) AS settlement_count,
 CAST(sum(gross) AS DOUBLE) AS gross_amount, CAST(sum(fee) AS DOUBLE) AS fee_amount, CAST(sum(net) AS DOUBLE) AS net_amount FROM stl GROUP BY batch_id, l_returnflag""")
def settlement_mart(spark, sf):
    sums = [F.sum(a).cast("decimal(28,2)").alias(f"{a}_amount") for a in ("gross", "fee", "net")]
    x = E.settlements(spark, sf).groupBy("batch_id", F.col("l_returnflag").alias("currency"))
    return x.agg(F.min("settlement_date").alias("first_date"), F.max("settlement_date").alias("last_date"), F.count("*").alias("settlement_count"), *sums)


@query(f"""WITH {E.SETTLEMENTS} SELECT settlement_date AS full_date, CASE WHEN variance = 0 THEN 'MATCHED' ELSE 'EXCEPTION' END AS match_status, count(*) AS n_rows,
 CAST(sum(gross) AS DOUBLE) AS expected_amount, CAST(sum(actual) AS DOUBLE) AS actual_amount, CAST(sum(variance) AS DOUBLE) AS net_variance FROM stl GROUP BY settlement_date, variance = 0""")
def reconciliation_mart(spark, sf):
    x = E.settlements(spark, sf).withColumn("match_status", X.match_status(F.col("variance"))).groupBy(F.col("settlement_date").alias("full_date"), "match_status")
    return x.agg(F.count("*").alias("n_rows"), *[F.sum(a).cast("decimal(28,2)").alias(n) for a, n in (("gross", "expected_amount"), ("actual", "actual_amount"), ("variance", "net_variance"))])


def _offers(spark, sf):
    return E.table(spark, sf, "part").filter("p_size <= 10").selectExpr(
        "p_partkey AS offer_id", "cast(p_partkey % 25 AS int) AS program_id", "CASE WHEN p_size <= 5 THEN 'AUTOMOBILE' END AS eligible_mcc",
        "date_add(date'1995-01-01', cast(p_partkey % 1500 AS int)) AS valid_from", "date_add(date'1995-01-01', cast(p_partkey % 1500 + 60 AS int)) AS valid_to",
        "CASE WHEN p_partkey % 2 = 0 THEN 'CASHBACK_PCT' ELSE 'FIXED_AMOUNT' END AS offer_type", "cast(CASE WHEN p_partkey % 2 = 0 THEN 0.05 ELSE 10 END AS decimal(18,4)) AS offer_value",
        "cast(50000 AS decimal(18,4)) AS min_amount",
    )


REWARDS = f"""{ENRICHED}, offers AS (SELECT p_partkey AS offer_id, p_partkey % 25 AS program_id, CASE WHEN p_size <= 5 THEN 'AUTOMOBILE' END AS eligible_mcc,
 DATE '1995-01-01' + CAST(p_partkey % 1500 AS INT) AS valid_from, DATE '1995-01-01' + CAST(p_partkey % 1500 + 60 AS INT) AS valid_to, p_partkey % 2 = 0 AS pct FROM part WHERE p_size <= 10),
hit AS (SELECT e.transaction_id, e.amount, o.offer_id, o.pct, row_number() OVER (PARTITION BY e.transaction_id ORDER BY o.offer_id) AS n FROM enr e JOIN offers o
 ON e.program_id = o.program_id AND e.txn_date BETWEEN o.valid_from AND o.valid_to AND (o.eligible_mcc IS NULL OR o.eligible_mcc = e.mcc) WHERE e.status = 'APPROVED'),
rew AS (SELECT transaction_id, offer_id, CAST(CASE WHEN amount < 50000 THEN 0 WHEN pct THEN round(amount * CAST(0.05 AS DECIMAL(18,4)), 2) ELSE 10 END AS DECIMAL(18,4)) AS reward_amount FROM hit WHERE n = 1)"""


@query(f"WITH {REWARDS} SELECT offer_id, CASE WHEN reward_amount > 0 THEN 'QUALIFIED' ELSE 'NOT_QUALIFIED' END AS qualification_status, count(*) AS reward_count, CAST(sum(reward_amount) AS DOUBLE) AS reward_total FROM rew GROUP BY 1, 2")
def rewards_mart(spark, sf):
    x = rules.qualify_offers(_enriched(spark, sf), _offers(spark, sf))
    return x.groupBy("offer_id", "qualification_status").agg(F.count("*").alias("reward_count"), F.sum("reward_amount").cast("decimal(28,4)").alias("reward_total"))


@query(f"""WITH {ENRICHED} SELECT count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(amount) FILTER (status = 'APPROVED') AS DOUBLE) AS approved,
 CAST(sum(amount) FILTER (status = 'DECLINED') AS DOUBLE) AS declined, count(*) FILTER (status = 'DECLINED') AS declined_count, count(DISTINCT program) AS programs FROM enr""")
def kpis(spark, sf):
    one = lambda s: F.sum(F.when(F.col("status") == s, F.col("amount"))).cast("decimal(28,2)")
    return _enriched(spark, sf).agg(F.count("*").alias("transactions"), F.sum("amount").cast("decimal(28,2)").alias("amount"), one("APPROVED").alias("approved"), one("DECLINED").alias("declined"), F.count_if(F.col("status") == "DECLINED").alias("declined_count"), F.count_distinct("program").alias("programs"))


@query("""SELECT 'lineitem_order' AS check_name, count(*) AS n_violations FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'customer_nation', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)
UNION ALL SELECT 'event_customer', count(*) FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)""")
def reference_integrity(spark, sf):
    t = lambda n: E.table(spark, sf, n)
    return gates.reference_report({
        "lineitem_order": gates.orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), "order_customer": gates.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey"),
        "customer_nation": gates.orphans(t("customer"), "c_nationkey", t("nation"), "n_nationkey"), "event_customer": gates.orphans(t("events"), "user_id", t("customer"), "c_custkey"),
    })


@query(f"WITH {E.DIRTY} SELECT count(*) AS n_rows, count(*) FILTER (coalesce(trim(transaction_id), '') = '') AS blank_transaction_id, count(*) FILTER (coalesce(trim(currency_code), '') = '') AS blank_currency_code, CAST(count(*) - count(DISTINCT transaction_id) AS BIGINT) AS n_repeated, count(*) FILTER (NOT regexp_matches(amount, '^[0-9]+[.][0-9]{{2}}$')) AS mismatch_amount, FALSE AS passed FROM dirty")
def batch_profile(spark, sf):
    return checks.profile(E.dirty_transactions(spark, sf), ["transaction_id", "currency_code"], ["transaction_id"], {"amount": r"\d+\.\d{2}$"})


@query("""WITH d AS (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY))::DATE AS d FROM orders)
SELECT d AS full_date, CAST(year(d)*10000+month(d)*100+day(d) AS INT) AS date_key, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, CAST(isodow(d) AS INT) AS day_of_week, CAST(week(d) AS INT) AS week_of_year, isodow(d) >= 6 AS is_weekend FROM d""")
def dim_date(spark, sf):
    days = E.transactions(spark, sf).agg(F.sequence(F.min("txn_date"), F.max("txn_date")).alias("d")).select(F.explode("d").alias("full_date"))
    return days.select("full_date", *[c.alias(n) for n, c in X.iso_calendar(F.col("full_date")).items()])


@query("""WITH old AS (SELECT p_name, CAST(row_number() OVER (ORDER BY p_name) AS INT) AS surrogate_key FROM (SELECT DISTINCT p_name FROM part WHERE p_size <= 2)),
new AS (SELECT p_name, CAST((SELECT max(surrogate_key) FROM old) + row_number() OVER (ORDER BY p_name) AS INT) AS surrogate_key FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM old)))
SELECT p_name, surrogate_key FROM old UNION ALL SELECT p_name, surrogate_key FROM new UNION ALL SELECT 'UNKNOWN', -1""")
def registry_keys(spark, sf):
    """Keys given out for the small parts stay; all other names are numbered after them."""
    part = E.table(spark, sf, "part")
    empty = spark.createDataFrame([], "p_name string, surrogate_key int")
    old = keys.assign_keys(part.filter("p_size <= 2"), empty, "p_name")
    return keys.with_unknown(keys.assign_keys(part, old, "p_name"), "surrogate_key", "p_name")


@query("""WITH f AS (SELECT DISTINCT o_custkey, max(o_orderkey) OVER (PARTITION BY o_custkey) AS k FROM orders), pub AS (SELECT o_custkey, k FROM f WHERE o_custkey % 2 = 0),
batch AS (SELECT o_custkey, CASE WHEN o_custkey % 6 = 0 THEN k + 1 ELSE k END AS k FROM f)
SELECT b.o_custkey, b.k, CASE WHEN p.k IS NULL THEN 'appended' WHEN p.k = b.k THEN 'unchanged' ELSE 'immutability_conflict' END AS disposition FROM batch b LEFT JOIN pub p ON b.o_custkey = p.o_custkey""")
def immutable_append(spark, sf):
    f = E.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    batch = f.withColumn("k", F.when(F.col("o_custkey") % 6 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return merge.append_immutable(f.filter("o_custkey % 2 = 0"), batch, ["o_custkey"], "k", "k")


@query("""WITH a AS (SELECT user_id, event_id, event_type, 0 AS fresh FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_id, event_type, 1 AS fresh FROM events WHERE event_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, fresh DESC, event_id DESC) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT user_id, event_id, event_type FROM r WHERE n = 1""")
def latest_wins_merge(spark, sf):
    e = E.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return merge.latest_wins(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_type", "event_id")


@query("SELECT user_id, min(event_id) AS first_event FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0) GROUP BY user_id")
def insert_if_absent(spark, sf):
    e = E.table(spark, sf, "events")
    have = e.filter("event_type = 'purchase' AND user_id % 3 = 0").select("user_id").distinct()
    return merge.insert_if_absent(have, e.groupBy("user_id").agg(F.min("event_id").alias("first_event")), ["user_id"])


@query("""WITH h AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0), s AS (SELECT DISTINCT user_id FROM events)
SELECT count(*) AS source_rows, count(*) FILTER (user_id NOT IN (SELECT user_id FROM h)) AS inserted, count(*) FILTER (user_id IN (SELECT user_id FROM h)) AS skipped FROM s""")
def insert_counts(spark, sf):
    e = E.table(spark, sf, "events").select("user_id", "event_type")
    return merge.insert_counts(e.filter("event_type = 'purchase' AND user_id % 3 = 0").select("user_id"), e.select("user_id").distinct(), ["user_id"])


@query("""WITH f AS (SELECT o_custkey AS k, max(o_orderkey) AS s FROM orders GROUP BY o_custkey),
old AS (SELECT k, s, CAST(s AS VARCHAR) AS d FROM f WHERE k % 3 <> 0), batch AS (SELECT k, CASE WHEN k % 5 = 0 THEN s + 1 WHEN k % 5 = 1 THEN s - 1 WHEN k % 5 = 2 THEN s ELSE NULL END AS s, CASE WHEN k % 7 = 0 THEN CAST(s AS VARCHAR) ELSE 'new' END AS d FROM f),
j AS (SELECT b.k, b.s AS bs, b.d AS bd, o.s AS os, o.d AS od, CASE WHEN o.d IS NULL THEN 'inserted' WHEN o.d = b.d THEN 'unchanged' WHEN b.s IS NULL THEN 'upsert_conflict' WHEN b.s > o.s THEN 'updated' WHEN b.s < o.s THEN 'stale_skipped' ELSE 'upsert_conflict' END AS disposition FROM batch b LEFT JOIN old o ON b.k = o.k)
SELECT k, disposition, CASE WHEN disposition IN ('inserted', 'updated') THEN bs ELSE os END AS s FROM j""")
def freshness_upsert(spark, sf):
    f = E.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("s"))
    old = f.filter("k % 3 <> 0").select("k", "s", F.col("s").cast("string").alias("d"))
    batch = f.selectExpr("k", "CASE WHEN k % 5 = 0 THEN s + 1 WHEN k % 5 = 1 THEN s - 1 WHEN k % 5 = 2 THEN s END AS s", "CASE WHEN k % 7 = 0 THEN cast(s AS string) ELSE 'new' END AS d", "0 AS o")
    x = merge.fresh_upsert_rows(old, batch, "k", "s", "d", "o")
    one = x.groupBy("k").agg(F.max("disposition").alias("disposition"), F.max(F.when(F.col("is_last"), F.col("s"))).alias("s"))  # a row a key in this batch
    return one.filter("disposition IS NOT NULL")


CHANGE = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' WHEN 'purchase' THEN 'r' ELSE 'u' END"


def _changes(spark, sf, late: bool = True):
    lsn = "CASE WHEN event_id % 7 = 0 THEN event_id - 400 ELSE event_id END" if late else "event_id"
    return E.table(spark, sf, "events").selectExpr(
        "user_id", "event_id AS kafka_offset", f"{CHANGE} AS operation", f"{lsn} AS source_lsn", "sha2(concat_ws('|', cast(cast(value AS int) AS string)), 256) AS digest", "to_json(struct(value, props)) AS record", "'db.public.users' AS source_topic", "cast(user_id % 3 AS int) AS kafka_partition"
    )


@query(f"""WITH c AS (SELECT user_id, event_id AS kafka_offset, {CHANGE} AS op, lag({CHANGE}) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
SELECT CASE WHEN op <> 'd' AND coalesce(prev, 'd') <> 'd' THEN 'duplicate_primary_key' ELSE 'appended' END AS disposition, count(*) AS n_rows FROM c GROUP BY 1""")
def cdc_event_log(spark, sf):
    return gates.accounting(cdc.fold_event_log(_changes(spark, sf), "user_id"), "disposition")


@query("""WITH seen AS (SELECT user_id % 3 AS p, max(event_id) AS m FROM events WHERE event_id < 5000 GROUP BY 1)
SELECT CAST(user_id % 3 AS INT) AS kafka_partition, count(*) AS n_new, max(event_id) AS kafka_offset FROM events JOIN seen ON user_id % 3 = p WHERE event_id > m GROUP BY 1""")
def cdc_offset_dedup(spark, sf):
    e = _changes(spark, sf)
    old = cdc.advance(spark.createDataFrame([], "source_topic string, kafka_partition int, kafka_offset long"), e.filter("kafka_offset < 5000"))
    return cdc.unseen(e, old).groupBy("kafka_partition").agg(F.count("*").alias("n_new"), F.max("kafka_offset").alias("kafka_offset"))


@query("""SELECT CASE WHEN event_id % 11 = 0 THEN 't' WHEN event_id % 13 = 0 THEN 'x' ELSE 'u' END AS operation, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'unknown_op' WHEN event_id % 17 = 0 THEN 'missing_payload_for_operation' END AS problem, count(*) AS n FROM events GROUP BY 1, 2""")
def cdc_envelopes(spark, sf):
    value = """CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '{"payload":{"op":"x","after":"{}"}}' WHEN event_id % 17 = 0 THEN '{"payload":{"op":"u"}}' ELSE concat('{"payload":{"op":"u","after":', props, ',"source":{"lsn":', event_id, '}}}') END"""
    raw = E.table(spark, sf, "events").selectExpr(f"{value} AS value", "'a.b.users' AS topic")
    return cdc.parse_envelope(raw).groupBy("operation", "problem").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k, count(*) AS n FROM events GROUP BY event_type")
def json_properties(spark, sf):
    x = E.table(spark, sf, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v")).filter("key = 'k'")
    return x.groupBy("event_type").agg(F.sum(F.col("v").try_cast("long")).alias("total_k"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) - 30 AS wm FROM orders) SELECT CAST(o_orderdate AS DATE) AS txn_date, count(*) AS n FROM orders, m WHERE CAST(o_orderdate AS DATE) > wm GROUP BY 1""")
def watermark_scan(spark, sf):
    """The days after the mark that an earlier batch, up to a month ago, has left in a stored table of marks: it is read first, so the scan has it as a literal filter."""
    orders = E.table(spark, sf, "orders")
    until = orders.agg(F.date_sub(F.max("o_orderdate").cast("date"), 30).cast("string").alias("latest"))
    batch = until.select(F.lit("orders").alias("source"), F.lit(True).alias("passed"), F.lit(1).alias("n_records"), "latest")
    marks = stored(watermarks.advance(spark.createDataFrame([], watermarks.MARKS), batch), "marks")
    return watermarks.after_mark(orders, "o_orderdate", marks, "orders").groupBy(F.col("o_orderdate").cast("date").alias("txn_date")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 10000")
def capped_extract(spark, sf):
    return E.table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").orderBy("o_orderkey").limit(10_000).select("o_orderkey", "o_custkey")


@query("""SELECT l_orderkey, first(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber % 2 = 0) AS part, min(l_linenumber) AS line
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey""")
def group_merge(spark, sf):
    x = E.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    x = x.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("p")).alias("part"), F.col("l_linenumber").alias("line"))
    return dedupe.merge_first_known(x, "l_orderkey", "l_linenumber", ["part", "line"])


SHOPS = "CASE p_partkey % 7 WHEN 0 THEN 'art; gift ' WHEN 1 THEN 'books;tea' WHEN 2 THEN 'tailor' WHEN 3 THEN 'art' WHEN 4 THEN '' ELSE NULL END"
AMENITIES = "CASE p_partkey % 5 WHEN 0 THEN ' cafe' WHEN 1 THEN 'bank' WHEN 2 THEN 'school' ELSE NULL END"


@query(f"""WITH c(tag, val, code, sure) AS (VALUES {", ".join(map(str, rules.categories()))}), p AS (SELECT p_partkey, {SHOPS} AS shop, {AMENITIES} AS amenity FROM part),
 s AS (SELECT p_partkey, trim(unnest(string_split(shop, ';'))) AS val, unnest(range(len(string_split(shop, ';')))) AS pos FROM p WHERE shop IS NOT NULL),
 h AS (SELECT p_partkey, arg_min(code, pos) AS code, arg_min(sure, pos) AS sure FROM s JOIN c ON c.tag = 'shop' AND c.val = s.val GROUP BY p_partkey)
 SELECT p.p_partkey, coalesce(h.code, a.code, '{rules.OTHER_CODE}') AS mcc_code, CAST(coalesce(h.sure, a.sure, {rules.OTHER_CONFIDENCE}) AS DOUBLE) AS mcc_confidence FROM p LEFT JOIN h ON p.p_partkey = h.p_partkey LEFT JOIN c a ON a.tag = 'amenity' AND a.val = trim(p.amenity)""")
def code_crosswalk(spark, sf):
    places = E.table(spark, sf, "part").select("p_partkey", F.expr(SHOPS).alias("shop"), F.expr(AMENITIES).alias("amenity"))
    return rules.merchant_category(places, "p_partkey", "shop", "amenity")


@query("""SELECT o_orderkey AS transaction_id, CASE WHEN o_orderkey % 29 = 0 THEN 'authorization_count' WHEN o_orderstatus = 'F' AND o_orderkey % 31 = 0 THEN 'approved_without_capture' ELSE 'reversal_without_capture' END AS fault
FROM orders WHERE o_orderkey % 29 = 0 OR (o_orderkey % 31 = 0 AND o_orderstatus = 'F') OR (o_orderkey % 37 = 0 AND o_orderstatus = 'O')""")
def lifecycle_faults(spark, sf):
    t = E.transactions(spark, sf)
    kinds = F.expr("""filter(array(IF(transaction_id % 29 <> 0, 'AUTHORIZATION', NULL), IF(status = 'APPROVED' AND transaction_id % 31 <> 0, 'CAPTURE', NULL), IF(status = 'PENDING' AND transaction_id % 37 = 0, 'REVERSAL', NULL), 'NOTE'), x -> x IS NOT NULL)""")
    return rules.sequence_faults(t.select("transaction_id", "status", F.posexplode(kinds).alias("event_ts", "event_type")))


@query(f"WITH {ENRICHED} SELECT client, program, {PROGRAM_AGG}, sum(count(*)) OVER () AS control_count FROM enr WHERE client = 'ASIA' GROUP BY client, program")
def client_extract(spark, sf):
    from .delivery import extract

    mart = client_program_mart(spark, sf)
    x = extract(mart, ["client", "program", "transaction_count", "approved_amount", "declined_count"], ["client", "program"], ("client", "ASIA"))
    return x.crossJoin(F.broadcast(x.agg(F.sum("transaction_count").alias("control_count"))))
