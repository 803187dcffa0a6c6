"""Registered queries over raw records and change events: reference datasets, suites, marks, and the captured tables.

Raw records are made of the given tables, as JSON or text with faults by fixed rules; the SQL works
the expected typed rows out from the same tables without the detour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cdc, cdc_tables, gates, merge, watermarks
from . import reference as R
from .entities import table
from .queries import CHANGE, _changes
from .registry import query

#: The fold of change events as SQL: ev (k, off, op, lsn, digest) -> fold (k, n, off, lsn, deleted, digest, say), a row an event and one (n = 0) before each key's first.
FOLD_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY off) AS n FROM ev WHERE op <> 't'),
fold AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS off, CAST(NULL AS BIGINT) AS lsn, CAST(NULL AS BOOLEAN) AS deleted, CAST(NULL AS VARCHAR) AS digest, CAST(NULL AS VARCHAR) AS say FROM (SELECT DISTINCT k FROM o)
 UNION ALL SELECT k, n, off, CASE WHEN say IN ('inserted', 'updated', 'deleted') THEN elsn ELSE lsn END, CASE WHEN say = 'deleted' THEN TRUE WHEN say IN ('inserted', 'updated') THEN FALSE ELSE deleted END,
  CASE WHEN say = 'deleted' THEN NULL WHEN say IN ('inserted', 'updated') THEN edigest ELSE digest END, say
 FROM (SELECT f.k, o.n, o.off, o.lsn AS elsn, o.digest AS edigest, f.lsn, f.deleted, f.digest,
  CASE WHEN o.op = 'd' THEN CASE WHEN f.lsn IS NULL OR o.lsn > f.lsn THEN 'deleted' ELSE 'stale_skipped' END
   WHEN f.lsn IS NULL THEN 'inserted' WHEN f.deleted AND o.lsn <= f.lsn THEN 'stale_skipped' WHEN f.deleted AND o.op = 'c' THEN 'inserted' WHEN f.deleted THEN 'conflict_update_after_delete'
   WHEN o.lsn < f.lsn THEN 'stale_skipped' WHEN o.digest = f.digest THEN 'unchanged' WHEN o.lsn > f.lsn THEN 'updated' ELSE 'conflict_same_lsn' END AS say
  FROM fold f JOIN o ON f.k = o.k AND o.n = f.n + 1))"""

EVENTS = f"""ev AS (SELECT user_id AS k, event_id AS off, {CHANGE} AS op, CASE WHEN event_id % 7 = 0 THEN event_id - 400 ELSE event_id END AS lsn, sha256(CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR)) AS digest FROM events)"""


@query(f"WITH RECURSIVE {EVENTS}, {FOLD_SQL} SELECT k AS user_id, lsn, deleted AS is_deleted, digest FROM fold QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1")
def cdc_current_state(spark, sf):
    """Out-of-order change events folded into one state a key."""
    x = cdc.fold_rows(_changes(spark, sf), "user_id").filter("is_last")
    return x.select("user_id", F.col("state.lsn").alias("lsn"), F.col("state.deleted").alias("is_deleted"), F.col("state.digest").alias("digest"))


@query(f"WITH RECURSIVE {EVENTS}, {FOLD_SQL} SELECT say AS disposition, count(*) AS n_rows FROM fold WHERE n > 0 GROUP BY say")
def cdc_dispositions(spark, sf):
    x = cdc.fold_rows(_changes(spark, sf), "user_id").filter("NOT is_last")
    return gates.accounting(x.select("disposition"), "disposition")


#: Events of two captured tables, made of customers (card_tokens) and orders (transaction_events): their faults and lateness by fixed rules.
TOKENS = """SELECT 5 * c_custkey + step AS off, CASE step WHEN 0 THEN 'c' WHEN 1 THEN 'u' WHEN 2 THEN CASE c_custkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 't' ELSE 'u' END ELSE 'u' END AS op,
 10 * c_custkey + CASE step WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 5 END ELSE step END AS lsn, 'T' || CAST(c_custkey AS STRING) AS token_id, 'H' || CAST(c_custkey AS STRING) AS cardholder_id,
 CASE WHEN c_custkey % 23 = 0 AND step = 1 THEN ' ' ELSE 'B' || CAST(c_nationkey AS STRING) END AS bin_range, c_mktsegment AS card_brand,
 CASE WHEN c_custkey % 19 = 0 AND step = 3 THEN 'LOST' WHEN step < 2 THEN 'ACTIVE' ELSE 'SUSPENDED' END AS token_status, 9000 + CAST(c_custkey % 100 AS INT) AS issued_day, c_custkey % 29 = 0 AND step = 2 AS no_image FROM {customer} CROSS JOIN (SELECT explode_steps AS step FROM STEPS)"""
_STEPS_SPARK, _STEPS_SQL = "VALUES (0), (1), (2), (3), (4) AS t(explode_steps)", "(VALUES (0), (1), (2), (3), (4)) AS t(explode_steps)"


def _token_events(spark, sf) -> DataFrame:
    rows = spark.sql(TOKENS.replace("STEPS", _STEPS_SPARK), customer=table(spark, sf, "customer"))
    image = F.to_json(F.struct("token_id", "cardholder_id", "bin_range", "card_brand", "token_status", F.col("issued_day").alias("issued_date"), F.lit("cdc").alias("source_type")))
    image = F.when(~F.col("no_image") & (F.col("op") != "t"), image)
    return rows.select(F.lit("db.public.card_tokens").alias("source_topic"), F.lit(0).alias("kafka_partition"), F.col("off").alias("kafka_offset"), F.col("op").alias("operation"), F.when(F.col("op") == "d", image).alias("before"), F.when(F.col("op") != "d", image).alias("after"), F.col("lsn").alias("source_lsn"))


TOKEN_SQL = TOKENS.replace("STEPS", _STEPS_SQL).replace("{customer}", "customer")
TOKEN_FOLD = f"""raw AS ({TOKEN_SQL}), judged AS (SELECT *, md5(bin_range || '|' || card_brand || '|' || token_status || '|' || issued_day) AS digest, CASE WHEN op = 't' THEN NULL WHEN no_image THEN 'missing_payload_for_operation' WHEN op = 'd' THEN NULL WHEN trim(bin_range) = '' THEN 'missing_bin_range' WHEN token_status = 'LOST' THEN 'invalid_token_status' END AS reason FROM raw),
ev AS (SELECT token_id AS k, off, op, lsn, digest FROM judged WHERE op <> 't' AND reason IS NULL), {FOLD_SQL}"""


@query(f"""WITH RECURSIVE {TOKEN_FOLD} SELECT disposition, reason, count(*) AS n_rows FROM (
 SELECT CASE WHEN op = 't' THEN 'tombstone_ignored' ELSE 'quarantined' END AS disposition, reason FROM judged WHERE op = 't' OR reason IS NOT NULL
 UNION ALL SELECT CASE WHEN say LIKE 'conflict%' THEN 'quarantined' ELSE say END, CASE WHEN say LIKE 'conflict%' THEN say END FROM fold WHERE n > 0) GROUP BY disposition, reason""")
def cdc_table_dispositions(spark, sf):
    """Every event of a captured table in exactly one bucket: typed, checked, folded."""
    spec, mode = cdc_tables.specs()["card_tokens"]
    return gates.accounting(cdc_tables.process(_token_events(spark, sf), spec, mode).filter("NOT is_last"), "disposition", ["reason"])


@query(f"""WITH RECURSIVE {TOKEN_FOLD}, last AS (SELECT * FROM fold WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1)
 SELECT j.token_id, j.cardholder_id, j.bin_range, j.card_brand, j.token_status, DATE '1970-01-01' + j.issued_day AS issued_date, 'cdc' AS source_type, l.lsn AS source_lsn
 FROM last l JOIN judged j ON j.token_id = l.k AND j.lsn = l.lsn AND j.digest = l.digest AND j.reason IS NULL AND j.op <> 't' WHERE NOT l.deleted QUALIFY row_number() OVER (PARTITION BY j.token_id ORDER BY j.off) = 1""")
def cdc_table_rows(spark, sf):
    """The typed rows of a captured table that live in the end."""
    spec, mode = cdc_tables.specs()["card_tokens"]
    return cdc_tables.current_rows(cdc_tables.state_of(cdc_tables.process(_token_events(spark, sf), spec, mode), spec), spec).drop("record_hash")


@query(f"""WITH RECURSIVE cut AS (SELECT CAST(floor(max(off) / 2) AS BIGINT) AS c FROM ({TOKEN_SQL})), {TOKEN_FOLD}
 SELECT k AS token_id, lsn, deleted AS is_deleted FROM fold WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1""")
def cdc_two_runs(spark, sf):
    """A run over the first half of the log, and one over all of it from the first one's state and checkpoint: what a single run gives."""
    spec, mode = cdc_tables.specs()["card_tokens"]
    e = _token_events(spark, sf)
    half = e.agg(F.floor(F.max("kafka_offset") / 2).alias("c"))
    first = e.join(F.broadcast(half), F.col("kafka_offset") <= F.col("c")).drop("c")
    marks = cdc.advance(spark.createDataFrame([], "source_topic string, kafka_partition int, kafka_offset long"), first)
    state = cdc_tables.state_of(cdc_tables.process(first, spec, mode), spec)
    x = cdc_tables.state_of(cdc_tables.process(e, spec, mode, state, marks), spec)
    return x.select("token_id", F.col("state.lsn").alias("lsn"), F.col("state.deleted").alias("is_deleted"))


@query("""WITH ev AS (SELECT o_orderkey, step, CASE WHEN step = 1 AND o_orderkey % 6 = 0 THEN 'd' ELSE 'c' END AS op, CASE WHEN o_orderkey % 31 = 0 AND step = 2 THEN 'VOID' ELSE 'AUTHORIZATION' END AS kind FROM orders CROSS JOIN (VALUES (0), (1), (2)) AS t(step)),
 ok AS (SELECT *, lag(op) OVER (PARTITION BY o_orderkey ORDER BY step) AS prev FROM ev WHERE kind = 'AUTHORIZATION' OR op = 'd')
 SELECT disposition, reason, count(*) AS n_rows FROM (SELECT CASE WHEN op <> 'd' AND coalesce(prev, 'd') <> 'd' THEN 'quarantined' ELSE 'appended' END AS disposition, CASE WHEN op <> 'd' AND coalesce(prev, 'd') <> 'd' THEN 'duplicate_primary_key' END AS reason FROM ok
 UNION ALL SELECT 'quarantined', 'invalid_event_type' FROM ev WHERE kind <> 'AUTHORIZATION' AND op <> 'd') GROUP BY disposition, reason""")
def cdc_log_dispositions(spark, sf):
    """An event log: a delete frees its key, a second insert without one is quarantined."""
    spec, mode = cdc_tables.specs()["transaction_events"]
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, range(3)))).alias("step"))
    op = F.when((F.col("step") == 1) & (F.col("o_orderkey") % 6 == 0), "d").otherwise("c")
    kind = F.when((F.col("o_orderkey") % 31 == 0) & (F.col("step") == 2), "VOID").otherwise("AUTHORIZATION")
    image = F.to_json(F.struct(F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("event_id"), F.col("o_orderkey").cast("string").alias("transaction_id"), kind.alias("event_type"), F.lit(1_700_000_000_000_000).alias("event_timestamp"), F.lit("OK").alias("event_status"), F.lit("cdc").alias("source_type")))
    bronze = rows.select((3 * F.col("o_orderkey") + F.col("step")).alias("kafka_offset"), op.alias("operation"), F.when(op == "d", image).alias("before"), F.when(op != "d", image).alias("after"), F.col("o_orderkey").alias("source_lsn"))
    return gates.accounting(cdc_tables.process(bronze, spec, mode).filter("NOT is_last"), "disposition", ["reason"])


# ---- reference datasets ----

def _raw_mcc(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS seq", "CASE WHEN p_partkey % 17 = 0 THEN 'x12' WHEN p_partkey % 23 = 0 THEN ' ' ELSE concat(' ', lpad(cast(p_partkey % 400 AS string), 4, '0')) END AS mcc", "CASE WHEN p_partkey % 29 = 0 THEN '' ELSE p_type END AS edited_description",
        "p_name AS combined_description", "'' AS usda_description", "p_brand AS irs_description", "CASE p_partkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '?' END AS irs_reportable")


MCC = """r AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 17 = 0 THEN 'x12' WHEN p_partkey % 23 = 0 THEN NULL ELSE lpad(CAST(p_partkey % 400 AS VARCHAR), 4, '0') END AS mcc_code, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_type END AS description, p_name AS description_combined, CAST(NULL AS VARCHAR) AS description_usda,
 p_brand AS description_irs, CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS irs_reportable FROM part),
 j AS (SELECT *, CASE WHEN mcc_code IS NULL THEN 'required_mcc_code' WHEN NOT regexp_matches(mcc_code, '^[0-9]{4}$') THEN 'pattern_mcc_code' WHEN description IS NULL THEN 'required_description' END AS fault FROM r),
 n AS (SELECT *, row_number() OVER (PARTITION BY mcc_code ORDER BY seq) AS nth FROM j WHERE fault IS NULL)"""


@query(f"WITH {MCC} SELECT seq, mcc_code, description, description_combined, description_usda, description_irs, irs_reportable FROM n WHERE nth = 1")
def silver_mcc(spark, sf):
    return R.conform(_raw_mcc(spark, sf), R.mcc(), ["seq"])[0].drop("warnings")


@query(f"WITH {MCC} SELECT failing_check_name, count(*) AS n_rows FROM (SELECT fault AS failing_check_name FROM j WHERE fault IS NOT NULL UNION ALL SELECT 'uniqueness_mcc_code' FROM n WHERE nth > 1) GROUP BY 1")
def silver_mcc_rejections(spark, sf):
    return gates.accounting(R.conform(_raw_mcc(spark, sf), R.mcc(), ["seq"])[1], "failing_check_name")


def _raw_issuers(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.selectExpr("c_custkey AS seq", "CASE WHEN c_custkey % 19 = 0 THEN '12a' ELSE lpad(cast(c_custkey AS string), 6, '0') END AS BIN", "c_mktsegment AS Brand", "'CREDIT ' AS Type", "' ' AS Category", "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS Issuer",
        "'' AS IssuerPhone", "NULL AS IssuerUrl", "lower(substr(n_name, 1, 2)) AS isoCode2", "lower(substr(n_name, 1, 3)) AS isoCode3", "n_name AS CountryName")


@query("""SELECT c_custkey AS seq, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS bin_range, c_mktsegment AS card_brand, 'CREDIT' AS card_type, CAST(NULL AS VARCHAR) AS card_category, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS issuer_name, c_custkey % 2 <> 0 AS has_known_issuer,
 CAST(NULL AS VARCHAR) AS issuer_phone, CAST(NULL AS VARCHAR) AS issuer_website, upper(substr(n_name, 1, 2)) AS issuer_country_alpha2, upper(substr(n_name, 1, 3)) AS issuer_country_alpha3, n_name AS issuer_country_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 19 <> 0""")
def silver_card_issuer(spark, sf):
    return R.conform(_raw_issuers(spark, sf), R.card_issuer(), ["seq"])[0].drop("warnings")


@query("""SELECT n_nationkey AS seq, 'X' || chr(65 + n_nationkey % 26) || chr(65 + n_nationkey // 26) AS country_code_alpha3, 'X' || chr(65 + n_nationkey % 26) AS country_code_alpha2, CAST(n_nationkey AS VARCHAR) AS country_code_numeric, n_name AS country_name, CAST(NULL AS VARCHAR) AS country_official_name,
 r_name AS region, CAST(NULL AS VARCHAR) AS subregion, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'City of ' || n_name END AS capital, 'GBP' AS default_currency_code, n_nationkey % 2 = 0 AS is_independent, CAST(NULL AS BOOLEAN) AS is_un_member FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 11 <> 5""")
def silver_country(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = n.selectExpr("n_nationkey AS seq", """to_json(named_struct('cca3', concat('x', lower(chr(65 + n_nationkey % 26)), chr(65 + n_nationkey div 26)), 'cca2', CASE WHEN n_nationkey % 11 = 5 THEN 'X1' ELSE concat('X', chr(65 + n_nationkey % 26)) END, 'ccn3', cast(n_nationkey AS string),
        'name', named_struct('common', n_name, 'official', ' '), 'region', r_name, 'capital', CASE WHEN n_nationkey % 4 = 0 THEN cast(array() AS array<string>) ELSE array(concat('City of ', n_name), 'other') END,
        'currencies', map('gbp', map('name', 'pound'), 'eur', map('name', 'euro')), 'independent', n_nationkey % 2 = 0, 'unMember', 'yes')) AS raw""")  # fmt: skip
    return R.conform(raw, R.country(), ["seq"])[0].drop("warnings")


@query("""WITH r AS (SELECT p_partkey AS seq, chr(65 + CAST(p_partkey % 26 AS INT)) || chr(65 + CAST(p_size % 5 AS INT)) || 'C' AS code, CASE WHEN p_size % 5 = 3 THEN NULL WHEN p_partkey % 3 = 0 THEN p_name END AS currency_name, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) END AS num, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS INT) END AS mu,
 CASE WHEN p_partkey % 26 < 4 AND p_partkey % 11 = 0 THEN '2001-01' END AS wd FROM part WHERE p_partkey % 31 <> 0),
 g AS (SELECT code AS currency_code, arg_min(currency_name, seq) FILTER (currency_name IS NOT NULL) AS currency_name, arg_min(num, seq) FILTER (num IS NOT NULL) AS currency_numeric_code, arg_min(mu, seq) FILTER (mu IS NOT NULL) AS minor_unit, arg_min(wd, seq) FILTER (wd IS NOT NULL) AS withdrawal_date FROM r GROUP BY code)
 SELECT *, withdrawal_date IS NULL AS is_active FROM g WHERE currency_name IS NOT NULL""")
def silver_iso_currency(spark, sf):
    raw = table(spark, sf, "part").selectExpr("p_partkey AS seq", "CASE WHEN p_partkey % 31 = 0 THEN 'Z9' ELSE lower(concat(chr(65 + p_partkey % 26), chr(65 + p_size % 5), 'C')) END AS AlphabeticCode", "CASE WHEN p_size % 5 = 3 THEN '' WHEN p_partkey % 3 = 0 THEN p_name ELSE ' ' END AS Currency",
        "CASE WHEN p_partkey % 5 = 0 THEN cast(p_partkey AS string) ELSE '' END AS NumericCode", "CASE WHEN p_partkey % 7 = 0 THEN cast(p_size AS string) ELSE 'N.A.' END AS MinorUnit", "CASE WHEN p_partkey % 26 < 4 AND p_partkey % 11 = 0 THEN '2001-01' ELSE NULL END AS WithdrawalDate")
    return R.merge_currencies(R.conform(raw, R.iso_currency(), ["seq"], unique=False)[0], "seq")[0]


@query("""SELECT s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END || ':' || CAST(s_suppkey AS VARCHAR) AS merchant_id, CASE s_suppkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type, s_suppkey AS osm_id, s_suppkey % 90 + 0.5 AS latitude, CAST(s_suppkey % 170 AS DOUBLE) AS longitude,
 s_name AS merchant_name, 'bakery;cafe' AS raw_shop_tag, CAST(NULL AS VARCHAR) AS raw_amenity_tag, n_name AS address_city, CAST(NULL AS VARCHAR) AS address_postcode, CAST(NULL AS VARCHAR) AS address_street, CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS website, CAST(NULL AS VARCHAR) AS opening_hours,
 '2026-01-01T00:00:00Z' AS source_updated_timestamp, CAST(6 AS INT) AS n_warnings FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0 AND s_suppkey % 10 <> 3""")
def silver_merchant(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    raw = s.selectExpr("s_suppkey AS seq", """to_json(named_struct('type', CASE s_suppkey % 3 WHEN 0 THEN ' node' WHEN 1 THEN 'way' ELSE 'relation' END, 'id', s_suppkey, 'lat', CASE WHEN s_suppkey % 7 = 0 THEN 91 ELSE s_suppkey % 90 + 0.5 END, 'lon', cast(s_suppkey % 170 AS double), 'timestamp', '2026-01-01T00:00:00Z',
        'tags', map('name', CASE WHEN s_suppkey % 10 = 3 THEN ' ' ELSE s_name END, 'shop', 'bakery;cafe', 'addr:city', n_name))) AS raw""")  # fmt: skip
    return R.conform(raw, R.place(), ["seq"])[0].withColumn("n_warnings", F.size("warnings")).drop("warnings")


@query("""SELECT c_custkey AS seq, 'LEI' || lpad(CAST(c_custkey AS VARCHAR), 15, '0') || '42' AS lei, c_name AS legal_name, upper(substr(n_name, 1, 2)) AS legal_address_country, n_name AS legal_address_city, CAST(NULL AS VARCHAR) AS legal_address_region, 'Z1' AS legal_address_postal_code,
 array_to_string(['Line ' || CAST(c_custkey AS VARCHAR), 'Floor 2'], '|') AS legal_lines, CAST(NULL AS VARCHAR) AS hq_address_country, CAST(NULL AS VARCHAR) AS hq_lines, lower(n_name) AS entity_jurisdiction, 'ACTIVE' AS entity_status, 'ISSUED' AS registration_status,
 TIMESTAMP '2026-01-02 03:04:05' AS registration_last_update_date, CAST(NULL AS VARCHAR) AS bic FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 12 <> 0 AND c_custkey % 25 <> 1""")
def silver_legal_entity(spark, sf):
    """From pages of up to 100 records each, as an API hands them out."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    one = c.selectExpr("c_custkey div 100 AS page", """named_struct('attributes', named_struct('lei', concat('LEI', lpad(cast(c_custkey AS string), 15, '0'), CASE WHEN c_custkey % 12 = 0 THEN 'X2' ELSE '42' END), 'entity', named_struct('legalName', named_struct('name', concat(c_name, ' ')), 'legalAddress',
        named_struct('country', lower(substr(n_name, 1, 2)), 'city', n_name, 'region', '', 'postalCode', 'Z1', 'addressLines', array(concat('Line ', cast(c_custkey AS string)), ' ', 'Floor 2')), 'headquartersAddress', named_struct('addressLines', array('', ' ')), 'category', 'GENERAL', 'status', 'ACTIVE', 'jurisdiction', lower(n_name)),
        'registration', named_struct('lastUpdateDate', CASE WHEN c_custkey % 25 = 1 THEN 'soon' ELSE '2026-01-02T03:04:05Z' END, 'status', 'ISSUED'))) AS record""")  # fmt: skip
    page = one.groupBy("page").agg(F.to_json(F.struct(F.collect_list("record").alias("data"))).alias("raw"))
    records = R.pages(page).withColumn("seq", F.get_json_object("raw", "$.attributes.lei").substr(4, 15).cast("long"))
    good = R.conform(records, R.legal_entity(), ["seq"])[0]
    lines = [F.array_join(f"{p}_address_lines", "|").alias(f"{p}_lines") for p in ("legal", "hq")]
    return good.select("seq", "lei", "legal_name", "legal_address_country", "legal_address_city", "legal_address_region", "legal_address_postal_code", lines[0], "hq_address_country", lines[1], "entity_jurisdiction", "entity_status", "registration_status", "registration_last_update_date", "bic")


RATE_ROWS = """SELECT CASE o_custkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE 'USD' END AS base, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, 'X' || CASE o_orderkey % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'BB' WHEN 2 THEN 'CC' ELSE '9' END AS quote, max(CAST(o_totalprice AS DECIMAL(18,2))) AS rate, max(o_orderkey) AS k FROM {orders} GROUP BY 1, 2, 3"""


def _responses(spark, sf) -> DataFrame:
    """A range response for each base and year, and a flat one for each day of 1995."""
    rows = spark.sql(RATE_ROWS, orders=table(spark, sf, "orders")).withColumn("rate", F.when(F.col("k") % 50 == 0, -F.col("rate")).otherwise(F.col("rate")).cast("string"))
    by_day = rows.groupBy("base", "day").agg(F.map_from_entries(F.collect_list(F.struct("quote", "rate"))).alias("rates"))
    ranged = by_day.filter("day NOT LIKE '1995%'").groupBy("base", F.substring("day", 1, 4).alias("y")).agg(F.map_from_entries(F.collect_list(F.struct("day", "rates"))).alias("rates"), F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    flat = by_day.filter("day LIKE '1995%'").select(F.to_json(F.struct("base", F.col("day").alias("date"), "rates")).alias("raw"))
    return ranged.select(F.to_json(F.struct("base", "start_date", "end_date", "rates")).alias("raw")).unionByName(flat)


@query(f"WITH r AS ({RATE_ROWS.replace('{orders}', 'orders')}) SELECT CAST(day AS DATE) AS rate_date, base AS base_currency, quote AS quote_currency, CAST(rate AS DOUBLE) AS exchange_rate FROM r WHERE quote <> 'X9' AND k % 50 <> 0")
def silver_fx_rate(spark, sf):
    return R.conform(R.flatten_rates(_responses(spark, sf)), R.fx_rate(), [], unique=False)[0].drop("warnings")


@query(f"""WITH r AS ({RATE_ROWS.replace('{orders}', 'orders')}) SELECT failing_check_name, count(*) AS n_rows FROM (SELECT CASE WHEN quote = 'X9' THEN 'pattern_quote_currency' WHEN k % 50 = 0 THEN 'positive_exchange_rate' END AS failing_check_name FROM r) WHERE failing_check_name IS NOT NULL GROUP BY 1""")
def silver_fx_rejections(spark, sf):
    return gates.accounting(R.conform(R.flatten_rates(_responses(spark, sf)), R.fx_rate(), [], unique=False)[1], "failing_check_name")


@query(f"""WITH r AS ({RATE_ROWS.replace('{orders}', 'orders')}), good AS (SELECT * FROM r WHERE quote <> 'X9' AND k % 50 <> 0), pub AS (SELECT * FROM good WHERE k % 2 = 0)
 SELECT disposition, count(*) AS n_rows FROM (SELECT CASE WHEN k % 2 <> 0 THEN 'appended' WHEN k % 3 = 0 THEN 'immutability_conflict' ELSE 'unchanged' END AS disposition FROM good) GROUP BY 1""")
def fx_immutable_append(spark, sf):
    """Published rates never change: a second batch with other values for some of them conflicts there, and its new ones are appended."""
    r = spark.sql(RATE_ROWS, orders=table(spark, sf, "orders")).filter("quote <> 'X9' AND k % 50 <> 0")
    keyed = r.select(F.col("day").alias("rate_date"), F.col("base").alias("base_currency"), F.col("quote").alias("quote_currency"), F.col("rate").alias("exchange_rate"), "k")
    batch = keyed.withColumn("exchange_rate", F.when((F.col("k") % 2 == 0) & (F.col("k") % 3 == 0), F.col("exchange_rate") + 1).otherwise(F.col("exchange_rate")))
    return gates.accounting(merge.append_immutable(keyed.filter("k % 2 = 0").drop("k"), batch, ["rate_date", "base_currency", "quote_currency"], "exchange_rate", "k"), "disposition")


@query("""SELECT source, check_name, CAST(n AS BIGINT) AS n_failures, (n = 0 OR free) AS passed FROM (
 SELECT 'mcc' AS source, unnest(['non_empty', 'required_mcc', 'duplicates_mcc']) AS check_name, unnest([0, 0, (SELECT count(*) - count(DISTINCT CASE WHEN p_partkey % 17 = 0 THEN 'x12' WHEN p_partkey % 23 = 0 THEN ' ' ELSE lpad(CAST(p_partkey % 400 AS VARCHAR), 4, '0') END) FROM part)]) AS n, FALSE AS free
 UNION ALL SELECT 'card_issuer', unnest(['non_empty', 'required_BIN', 'required_Brand', 'duplicates_BIN', 'pattern_BIN', 'pattern_isoCode2']), unnest([0, 0, 0, (SELECT greatest(count(*) - 1, 0) FROM customer WHERE c_custkey % 19 = 0), (SELECT count(*) FROM customer WHERE c_custkey % 19 = 0), 0]), FALSE
 UNION ALL SELECT 'rates_response', unnest(['non_empty', 'object_rates']), 0, FALSE
 UNION ALL SELECT 'fx_rate', unnest(['non_empty', 'required_date', 'required_currency', 'required_rate']), 0, FALSE)""")
def source_suites(spark, sf):
    responses = _responses(spark, sf)
    return R.union([
        R.run_suite(_raw_mcc(spark, sf), "mcc", R.SUITES["mcc"]), R.run_suite(_raw_issuers(spark, sf), "card_issuer", R.SUITES["card_issuer"]),
        R.run_suite(responses, "rates_response", R.SUITES["rates_response"]), R.run_suite(R.flatten_rates(responses), "fx_rate", R.SUITES["fx_rate"]),
    ])


@query("""SELECT source, check_name, CAST(n AS BIGINT) AS n_failures, (n = 0 OR free) AS passed FROM (
 SELECT 'country' AS source, unnest(['non_empty', 'required_cca2', 'required_cca3', 'required_name', 'duplicates_cca3']) AS check_name, unnest([0, (SELECT count(*) FROM nation WHERE n_nationkey % 11 = 5), 0, 0, (SELECT count(*) - count(DISTINCT n_regionkey) FROM nation)]) AS n, FALSE AS free
 UNION ALL SELECT 'iso_currency', unnest(['non_empty', 'required_AlphabeticCode', 'required_Currency', 'required_MinorUnit', 'duplicates_AlphabeticCode', 'pattern_AlphabeticCode']), unnest([0, 0, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0), 0, (SELECT count(*) - count(DISTINCT CASE WHEN p_partkey % 31 = 0 THEN 'Z9' ELSE 'AB' || chr(65 + p_size % 26) END) FROM part), (SELECT count(*) FROM part WHERE p_partkey % 31 = 0)]), unnest([FALSE, FALSE, FALSE, FALSE, TRUE, FALSE])
 UNION ALL SELECT 'merchant', unnest(['non_empty', 'required_id', 'required_type', 'duplicates_id']), unnest([0, (SELECT count(*) FROM supplier WHERE s_suppkey % 13 = 1), 0, (SELECT count(*) - count(DISTINCT CASE WHEN s_suppkey % 13 <> 1 THEN s_suppkey // 2 END) - count(*) FILTER (s_suppkey % 13 = 1) FROM supplier)]), FALSE
 UNION ALL SELECT 'legal_entity', unnest(['non_empty', 'required_lei', 'required_entity_status', 'required_entity_jurisdiction', 'required_registration_status', 'duplicates_lei', 'nulls_lei', 'nulls_entity_status', 'nulls_entity_jurisdiction', 'nulls_registration_status']),
  unnest([0, 0, 0, (SELECT count(*) FROM customer WHERE c_custkey % 9 = 2), 0, 0, 0, (SELECT count(*) FROM customer WHERE c_custkey % 8 = 3), (SELECT count(*) FROM customer WHERE c_custkey % 9 = 2), 0]), unnest([FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, TRUE, TRUE, TRUE, TRUE])
 UNION ALL SELECT 'lei_page', unnest(['non_empty', 'list_data']), unnest([0, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 4)]), FALSE)""")
def more_source_suites(spark, sf):
    """The suites of countries, currency codes, places, legal entities and their pages, over raw records with faults."""
    raw = lambda name, *columns: table(spark, sf, name).selectExpr(*columns)
    return R.union([
        R.run_suite(raw("nation", "CASE WHEN n_nationkey % 11 <> 5 THEN n_name END AS cca2", "cast(n_regionkey AS string) AS cca3", "n_name AS name"), "country", R.SUITES["country"]),
        R.run_suite(raw("part", "CASE WHEN p_partkey % 31 = 0 THEN 'Z9' ELSE concat('AB', chr(65 + p_size % 26)) END AS AlphabeticCode", "CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS Currency", "'2' AS MinorUnit"), "iso_currency", R.SUITES["iso_currency"]),
        R.run_suite(raw("supplier", "CASE WHEN s_suppkey % 13 <> 1 THEN cast(s_suppkey div 2 AS string) END AS id", "'node' AS type"), "merchant", R.SUITES["merchant"]),
        R.run_suite(raw("customer", "cast(c_custkey AS string) AS lei", "CASE WHEN c_custkey % 8 = 3 THEN ' ' ELSE 'ACTIVE' END AS entity_status", "CASE WHEN c_custkey % 9 <> 2 THEN 'x' END AS entity_jurisdiction", "'ISSUED' AS registration_status"), "legal_entity", R.SUITES["legal_entity"]),
        R.run_suite(raw("supplier", """CASE WHEN s_suppkey % 10 = 4 THEN '{"data": {}}' ELSE '{"data": [1]}' END AS raw"""), "lei_page", R.SUITES["lei_page"]),
    ])


@query("""WITH b AS (SELECT o_orderpriority AS source, count(*) FILTER (o_orderkey % 2 = 0) AS n_records, max(CAST(o_orderdate AS DATE)) FILTER (o_orderkey % 2 = 0) AS latest, o_orderpriority NOT LIKE '1%' AS passed FROM orders GROUP BY 1)
 SELECT source, CASE WHEN passed AND n_records > 0 THEN CAST(latest AS VARCHAR) ELSE '1990-01-01' END AS watermark FROM b UNION ALL SELECT 'no batch', '1990-01-01'""")
def watermark_advance(spark, sf):
    """A mark for each priority: only batches that passed move theirs, and a source without a batch keeps its own."""
    o = table(spark, sf, "orders")
    batches = o.groupBy(F.col("o_orderpriority").alias("source")).agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("n_records"), F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date"))).cast("string").alias("latest"))
    marks = batches.select("source").unionByName(spark.createDataFrame([("no batch",)], "source string")).withColumn("watermark", F.lit("1990-01-01"))
    return watermarks.advance(marks, batches.withColumn("passed", ~F.col("source").startswith("1")))


@query("""SELECT disposition, count(*) AS n_rows FROM (SELECT CASE WHEN s_suppkey % 9 = 2 THEN 'vacant_shop' WHEN s_suppkey % 10 = 3 THEN 'unnamed' WHEN s_suppkey % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS disposition FROM supplier) GROUP BY 1""")
def place_dispositions(spark, sf):
    """Every place in one bucket: excluded ones first, in order, then the checks."""
    raw = table(spark, sf, "supplier").selectExpr("s_suppkey AS seq", """to_json(named_struct('type', 'node', 'id', s_suppkey, 'lat', CASE WHEN s_suppkey % 7 = 0 THEN 91 ELSE 1 END, 'lon', 2,
        'tags', map('name', CASE WHEN s_suppkey % 10 = 3 THEN ' ' ELSE s_name END, 'shop', CASE WHEN s_suppkey % 9 = 2 THEN ' vacant' ELSE 'tea' END))) AS raw""")
    x = R.excluded_places(raw)
    good, bad = R.conform(x.filter("excluded IS NULL"), R.place(), ["seq"])
    kinds = [x.filter("excluded IS NOT NULL").select(F.col("excluded").alias("disposition")), good.select(F.lit("accepted").alias("disposition")), bad.select(F.lit("rejected").alias("disposition"))]
    return gates.accounting(R.union(kinds), "disposition")


@query("SELECT 'LEI' || CAST(c_custkey AS VARCHAR) AS lei, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS entity_legal_name, CAST(NULL AS VARCHAR) AS entity_hq_address_city, 'x' AS entity_jurisdiction FROM customer")
def lei_profile(spark, sf):
    raw = table(spark, sf, "customer").selectExpr("to_json(named_struct('attributes', named_struct('lei', concat('LEI', cast(c_custkey AS string)), 'entity', named_struct('legalName', CASE WHEN c_custkey % 2 = 0 THEN named_struct('name', c_name) END, 'jurisdiction', 'x')))) AS raw")
    return R.lei_profile(raw).select("lei", "entity_legal_name", "entity_hq_address_city", "entity_jurisdiction")
