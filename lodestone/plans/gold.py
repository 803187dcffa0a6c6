"""The star: thirteen dimensions, five facts, their gate and their enriched joins, over the given tables.

ENTITIES are the typed records that the star is built from, as SQL that both Spark and the checking
engine run over the tables; braces name a table or another entity. Dimensions are declared: a natural
key, attributes, and references to other dimensions by natural keys. Surrogate keys are those of
lasting registries (operators.keys), or of ones that start empty if none are given; every dimension but that of dates has one row for what is unknown, and
a reference that finds nothing goes there.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import gates, keys
from ..sources.stored import stored
from . import rules
from .entities import STATUS, table

CURRENCY = "CASE {} % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE 'USD' END"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SCD_START = "2026-01-01"

ENTITIES = {
    "merchant": """SELECT 'M' || CAST(s_suppkey AS STRING) AS merchant_id, s_name AS merchant_name, lower(n_name) AS raw_shop_tag, CAST(NULL AS STRING) AS raw_amenity_tag,
        CAST(s_suppkey % 90 AS DOUBLE) AS latitude, CAST(s_suppkey % 180 AS DOUBLE) AS longitude, n_name AS address_city, CAST(NULL AS STRING) AS address_postcode, CAST(NULL AS STRING) AS address_street,
        CAST(NULL AS STRING) AS phone, CAST(NULL AS STRING) AS website, CAST(NULL AS STRING) AS opening_hours, CAST(NULL AS STRING) AS country_code FROM {supplier} LEFT JOIN {nation} ON s_nationkey = n_nationkey""",
    "mcc": """SELECT 'K' || CAST(p_size AS STRING) AS mcc_code, min(p_type) AS description, min(p_brand) AS description_combined, CAST(NULL AS STRING) AS description_usda, max(p_type) AS description_irs,
        p_size % 2 = 0 AS irs_reportable FROM {part} GROUP BY p_size""",
    "country": f"""SELECT 'N' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS country_code_alpha3, substr(n_name, 1, 2) AS country_code_alpha2, n_name AS country_name, r_name AS region,
        CAST(NULL AS STRING) AS subregion, {CURRENCY.format("n_nationkey")} AS default_currency_code FROM {{nation}} LEFT JOIN {{region}} ON n_regionkey = r_regionkey""",
    "currency": f"SELECT {CURRENCY.format('n_nationkey')} AS currency_code, min(n_name) AS currency_name, 2 AS minor_unit, TRUE AS is_active FROM {{nation}} GROUP BY 1",
    "card_issuer": """SELECT lpad(CAST(c_nationkey AS STRING), 2, '0') || '-' || c_mktsegment AS bin_range, c_mktsegment AS card_brand, 'CREDIT' AS card_type, CAST(NULL AS STRING) AS card_category,
        min(n_name) || ' BANK' AS issuer_name, substr(min(n_name), 1, 2) AS issuer_country_alpha2, min(n_name) AS issuer_country_name
        FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey WHERE c_nationkey % 5 <> 0 GROUP BY c_nationkey, c_mktsegment""",
    "legal_entity": """SELECT 'LEI' || CAST(r_regionkey AS STRING) AS lei, r_name AS legal_name, substr(r_name, 1, 2) AS legal_address_country, lower(r_name) AS entity_jurisdiction, 'ACTIVE' AS entity_status,
        'ISSUED' AS registration_status FROM {region} WHERE r_regionkey < 4""",
    "client": """SELECT 'C' || CAST(r_regionkey AS STRING) AS client_id, 'LEI' || CAST(r_regionkey AS STRING) AS lei, r_name AS legal_name, CASE r_regionkey % 3 WHEN 0 THEN 'ISSUER' WHEN 1 THEN 'NETWORK' ELSE 'PROGRAM_OWNER' END AS client_type,
        substr(r_name, 1, 2) AS country_code, 'ACTIVE' AS status FROM {region}""",
    "program": f"""SELECT 'P' || CAST(n_nationkey AS STRING) AS program_id, 'C' || CAST(n_regionkey AS STRING) AS client_id, n_name AS program_name,
        CASE n_nationkey % 3 WHEN 0 THEN 'CASHBACK' WHEN 1 THEN 'LOYALTY' ELSE 'CO_BRAND' END AS program_type, {CURRENCY.format("n_nationkey")} AS currency_code, 'ACTIVE' AS status FROM {{nation}}""",
    "campaign": """SELECT p_brand AS campaign_id, 'P' || CAST(min(p_partkey) % 26 AS STRING) AS program_id, lower(p_brand) AS campaign_name, CAST(DATE '1995-01-01' + INTERVAL '30' DAY AS DATE) AS start_date,
        CAST(DATE '1998-01-01' AS DATE) AS end_date, 'ENDED' AS status FROM {part} GROUP BY p_brand""",
    "offer": f"""SELECT 'O' || CAST(p_partkey AS STRING) AS offer_id, p_brand AS campaign_id, CASE WHEN p_partkey % 7 = 0 THEN 'K0' WHEN p_size <= 5 THEN 'K' || CAST(p_size AS STRING) END AS eligible_mcc_code,
        CASE WHEN p_partkey % 2 = 0 THEN 'CASHBACK_PCT' ELSE 'FIXED_AMOUNT' END AS offer_type, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0.05 ELSE 10 END AS DECIMAL(18,4)) AS offer_value, CAST(50000 AS DECIMAL(18,4)) AS min_transaction_amount,
        {CURRENCY.format("p_partkey")} AS currency_code, 'ACTIVE' AS status, CAST(DATE '1995-01-01' + CAST(p_partkey % 1500 AS INT) AS DATE) AS valid_from, CAST(DATE '1995-01-01' + CAST(p_partkey % 1500 + 60 AS INT) AS DATE) AS valid_to
        FROM {{part}} WHERE p_size <= 10""",
    "cardholder": """SELECT 'H' || CAST(c_custkey AS STRING) AS cardholder_id, c_name AS pseudonym, 'N' || lpad(CAST(c_nationkey AS STRING), 2, '0') AS country_code, 'P' || CAST(c_nationkey AS STRING) AS enrolled_program_id,
        CAST(DATE '1994-01-01' AS DATE) AS enrollment_date FROM {customer}""",
    "card_token": """SELECT 'T' || CAST(c_custkey AS STRING) AS token_id, 'H' || CAST(c_custkey AS STRING) AS cardholder_id, lpad(CAST(c_nationkey AS STRING), 2, '0') || '-' || c_mktsegment AS bin_range, c_mktsegment AS card_brand,
        CASE c_custkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SUSPENDED' ELSE 'EXPIRED' END AS token_status, CAST(DATE '1994-06-01' AS DATE) AS issued_date FROM {customer} WHERE c_custkey % 50 <> 0""",
    "transaction": f"""SELECT 'X' || CAST(o_orderkey AS STRING) AS transaction_id, o_orderkey AS seq, 'T' || CAST(o_custkey AS STRING) AS token_id, 'M' || CAST(o_custkey % 110 AS STRING) AS merchant_id, 'K' || CAST(o_orderkey % 53 AS STRING) AS mcc_code,
        CAST(0.9 AS DECIMAL(18,4)) AS mcc_confidence, {CURRENCY.format("o_orderkey")} AS currency_code, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS amount, CAST(o_orderdate AS TIMESTAMP) AS transaction_timestamp,
        CAST(o_orderdate AS DATE) AS txn_date, {STATUS} AS status, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'LIMIT' END AS decline_reason, CASE WHEN o_orderstatus = 'F' THEN 'A' || CAST(o_orderkey % 1000 AS STRING) END AS auth_code FROM {{orders}}""",
    # one in 1009 approved transactions is not settled, so the gate has something to find
    "settlement": """SELECT 'S' || substr(transaction_id, 2) AS settlement_id, transaction_id, 'BATCH-' || CAST(CAST(txn_date + INTERVAL '2' DAY AS DATE) AS STRING) AS settlement_batch_id, CAST(txn_date + INTERVAL '2' DAY AS DATE) AS settlement_date,
        currency_code AS settlement_currency, amount AS settlement_amount, CAST(round(amount * CAST(0.015 AS DECIMAL(6,4)), 2) AS DECIMAL(18,4)) AS fee_amount,
        CAST(amount - CAST(round(amount * CAST(0.015 AS DECIMAL(6,4)), 2) AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS net_amount, seq FROM {transaction} WHERE status = 'APPROVED' AND seq % 1009 <> 0""",
    "reconciliation": """SELECT 'R' || substr(settlement_id, 2) AS reconciliation_id, settlement_id, settlement_amount AS expected_amount, CAST(settlement_amount - CASE WHEN seq % 100 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS actual_amount,
        CAST(CASE WHEN seq % 100 = 0 THEN -1 ELSE 0 END AS DECIMAL(18,4)) AS variance, CASE WHEN seq % 100 = 0 THEN 'EXCEPTION' ELSE 'MATCHED' END AS match_status, CAST(settlement_date + INTERVAL '1' DAY AS DATE) AS reconciled_date FROM {settlement}""",
    "transaction_event": """SELECT 'E1' || transaction_id AS event_id, 2 * seq AS kafka_offset, transaction_id, transaction_timestamp AS event_timestamp, 'AUTHORIZATION' AS event_type, 'OK' AS event_status, CASE WHEN seq % 97 = 0 THEN 'd' ELSE 'c' END AS operation FROM {transaction}
        UNION ALL SELECT 'E2' || transaction_id, 2 * seq + 1, transaction_id, CAST(transaction_timestamp + INTERVAL '1' DAY AS TIMESTAMP), 'CAPTURE', 'OK', 'c' FROM {transaction} WHERE status = 'APPROVED'""",
}


@dataclass(frozen=True)
class Dimension:
    """natural: its natural key; attributes as in the entity; refs: key column -> (entity column, dimension, whether null stays null); unknown: attributes of the unknown row beside nulls; always: constant columns."""

    natural: str
    attributes: tuple[str, ...]
    refs: dict[str, tuple[str, str, bool]] = field(default_factory=dict)
    unknown: dict[str, str] = field(default_factory=dict)
    always: dict[str, str] = field(default_factory=dict)


def _dim(natural: str, attributes: str, refs=None, unknown=None, always=None) -> Dimension:
    return Dimension(natural, tuple(attributes.split()), refs or {}, unknown or {}, always or {})


DIMENSIONS = {
    "merchant": _dim(
        "merchant_id", "merchant_name raw_shop_tag raw_amenity_tag latitude longitude address_city address_postcode address_street phone website opening_hours country_code",
        None, {"merchant_name": "'Unknown Merchant'"}, {"effective_from": f"DATE '{SCD_START}'", "effective_to": "CAST(NULL AS DATE)", "is_current": "TRUE"},
    ),
    "mcc": _dim("mcc_code", "description description_combined description_usda description_irs irs_reportable", None, {"description": "'Unknown MCC'"}),
    "country": _dim("country_code_alpha3", "country_code_alpha2 country_name region subregion default_currency_code", None, {"country_name": "'Unknown Country'"}),
    "currency": _dim("currency_code", "currency_name minor_unit is_active", None, {"currency_name": "'Unknown Currency'"}),
    "card_issuer": _dim("bin_range", "card_brand card_type card_category issuer_name issuer_country_alpha2 issuer_country_name", None, {"card_brand": "'Unknown'"}),
    "legal_entity": _dim("lei", "legal_name legal_address_country entity_jurisdiction entity_status registration_status", None, {"legal_name": "'Unknown Legal Entity'"}),
    "client": _dim("client_id", "lei legal_name client_type country_code status", {"legal_entity_key": ("lei", "legal_entity", False)}, {"legal_name": "'Unknown Client'"}),
    "program": _dim("program_id", "program_name program_type status", {"client_key": ("client_id", "client", False), "currency_key": ("currency_code", "currency", False)}, {"program_name": "'Unknown Program'"}),
    "campaign": _dim("campaign_id", "campaign_name start_date end_date status", {"program_key": ("program_id", "program", False)}, {"campaign_name": "'Unknown Campaign'"}),
    "offer": _dim(
        "offer_id", "offer_type offer_value min_transaction_amount status valid_from valid_to",
        {"campaign_key": ("campaign_id", "campaign", False), "eligible_mcc_key": ("eligible_mcc_code", "mcc", True), "currency_key": ("currency_code", "currency", False)},
    ),
    "cardholder": _dim("cardholder_id", "pseudonym country_code enrollment_date", {"program_key": ("enrolled_program_id", "program", False)}, {"pseudonym": "'Unknown Cardholder'"}),
    "card_token": _dim("token_id", "card_brand token_status issued_date", {"cardholder_key": ("cardholder_id", "cardholder", False), "card_issuer_key": ("bin_range", "card_issuer", False)}),
}

#: Key column -> (entity column, dimension); columns by name -> expression; the date that date_key is of; the grain.
FACTS = {
    "transactions": (
        "transaction_chain",
        {"merchant_key": ("merchant_id", "merchant"), "mcc_key": ("mcc_code", "mcc"), "currency_key": ("currency_code", "currency"), "card_token_key": ("token_id", "card_token"),
         "cardholder_key": ("cardholder_id", "cardholder"), "program_key": ("program_id", "program"), "client_key": ("client_id", "client")},
        {"transaction_id": "transaction_id", "country_key": "-1", "transaction_timestamp": "transaction_timestamp", "amount": "amount", "mcc_confidence": "mcc_confidence", "transaction_status": "status", "decline_reason": "decline_reason", "auth_code": "auth_code"},
        "transaction_timestamp", ("transaction_id",),
    ),
    "transaction_events": (
        "transaction_event", {},
        {c: c for c in ("event_id", "kafka_offset", "transaction_id", "event_timestamp", "event_type", "event_status")} | {"event_count": "1"},
        "event_timestamp", ("event_id", "kafka_offset"),
    ),
    "settlements": (
        "settlement", {"currency_key": ("settlement_currency", "currency")},
        {c: c for c in ("settlement_id", "transaction_id", "settlement_batch_id", "settlement_amount", "fee_amount", "net_amount")}, "settlement_date", ("settlement_id",),
    ),
    "reconciliation": (
        "reconciliation", {}, {c: c for c in ("reconciliation_id", "settlement_id", "match_status", "expected_amount", "actual_amount", "variance")}, "reconciled_date", ("reconciliation_id",),
    ),
    "rewards": (
        "reward_event", {"offer_key": ("offer_id", "offer"), "currency_key": ("reward_currency", "currency")},
        {c: c for c in ("reward_id", "kafka_offset", "transaction_id", "qualification_status", "reward_amount")}, "event_timestamp", ("reward_id", "kafka_offset"),
    ),
}
#: Dimensions that enrich a fact: the key, and columns by their names there. Rewards reach their campaign through the offer.
CAMPAIGN = ("campaign_key", "campaign_id", "campaign_name")
JOINS = {
    "transactions": [
        ("merchant", "merchant_key", {"merchant_id": "merchant_id", "merchant_name": "merchant_name"}), ("mcc", "mcc_key", {"mcc_code": "mcc_code", "mcc_description": "description"}),
        ("currency", "currency_key", {"currency_code": "currency_code"}), ("program", "program_key", {"program_id": "program_id", "program_name": "program_name", "program_type": "program_type"}),
        ("client", "client_key", {"client_id": "client_id", "client_legal_name": "legal_name"}),
    ],
    "settlements": [("currency", "currency_key", {"currency_code": "currency_code"})],
    "reconciliation": [],
    "rewards": [("currency", "currency_key", {"currency_code": "currency_code"}), ("offer", "offer_key", {"offer_id": "offer_id", "offer_type": "offer_type", "campaign_key": "campaign_key"})],
}
DATES = (("transaction", "transaction_timestamp"), ("settlement", "settlement_date"), ("reconciliation", "reconciled_date"), ("transaction_event", "event_timestamp"), ("reward_event", "event_timestamp"))
#: Entities whose days are all days of the one that they are made from: they can't widen the calendar, so it doesn't make them. The star's gate finds days that it lacks.
DAYS_OF = {"reward_event": "transaction"}
CALENDAR = ("date_key", "full_date", "year", "quarter", "month", "month_name", "day", "day_of_week", "day_name", "week_of_year", "is_weekend")


class Star:
    """Entities, registries, dimensions and facts over one folder of tables, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str, lasting: keys.LastingKeys | None = None):
        self.spark, self.sf_dir, self.made, self.lasting = spark, sf_dir, {}, lasting

    def _once(self, name: str, make) -> DataFrame:
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def entity(self, name: str) -> DataFrame:
        if name == "transaction_chain":
            return self._once(name, self._chain)
        if name == "reward_event":
            return self._once(name, self._rewards)
        return self._once(name, lambda: self._sql(ENTITIES[name]))

    def _sql(self, text: str) -> DataFrame:
        named = {n: table(self.spark, self.sf_dir, n) if n in TABLES else self.entity(n) for n in set(re.findall(r"\{(\w+)\}", text))}
        return self.spark.sql(text, **named)

    def _chain(self) -> DataFrame:
        """Transactions with the cardholder, program and client that their token leads to."""
        token = self.entity("card_token").select("token_id", "cardholder_id")
        holder = self.entity("cardholder").select("cardholder_id", F.col("enrolled_program_id").alias("program_id"))
        program = self.entity("program").select("program_id", "client_id")
        return self.entity("transaction").join(token, "token_id", "left").join(holder, "cardholder_id", "left").join(program, "program_id", "left")

    def _rewards(self) -> DataFrame:
        """Approved transactions with the first offer of their program that fits, and what it pays."""
        campaigns = self.entity("campaign").select("campaign_id", "program_id")
        offers = self.entity("offer").join(campaigns, "campaign_id").select("offer_id", "program_id", F.col("eligible_mcc_code").alias("eligible_mcc"), "valid_from", "valid_to", "offer_type", "offer_value", F.col("min_transaction_amount").alias("min_amount"))
        txns = self.entity("transaction_chain").select("transaction_id", "seq", "amount", "txn_date", "status", "program_id", F.col("mcc_code").alias("mcc"), "currency_code")
        got = rules.qualify_offers(txns, offers, keep=("seq", "currency_code"))
        return got.select(
            F.concat(F.lit("W"), F.col("seq").cast("string")).alias("reward_id"), F.col("seq").alias("kafka_offset"), "transaction_id", "offer_id", "qualification_status", "reward_amount",
            F.col("currency_code").alias("reward_currency"), F.col("txn_date").cast("timestamp").alias("event_timestamp"), F.when(F.col("seq") % 89 == 0, "d").otherwise("c").alias("operation"),
        )

    def registry(self, name: str) -> DataFrame:
        def make() -> DataFrame:
            natural = DIMENSIONS[name].natural
            if self.lasting is not None:
                return self.lasting.extend(name, self.entity(name), natural)
            empty = self.spark.createDataFrame([], f"{natural} string, surrogate_key int")
            return stored(keys.assign_keys(self.entity(name), empty, natural), f"registry-{name}")

        return self._once(f"registry of {name}", make)

    def registries(self, names: Iterable[str]) -> None:
        """Gives out keys for several dimensions at once: their jobs are small and don't wait for each other."""
        self._together(self.registry, [n for n in dict.fromkeys(names) if f"registry of {n}" not in self.made])

    @staticmethod
    def _together(make, names: Sequence[str]) -> None:
        with ThreadPoolExecutor(6) as pool:
            list(pool.map(make, names))

    def lookup(self, df: DataFrame, column: str, dim: str, alias: str, keep_null: bool = False) -> DataFrame:
        return keys.lookup(df, column, self.registry(dim), DIMENSIONS[dim].natural, "surrogate_key", alias, keep_null)

    def dimension(self, name: str) -> DataFrame:
        if name == "date":
            return self._once("dim date", self._dates)
        return self._once(f"dim {name}", lambda: self._dimension(name))

    def keep(self, dimensions: Sequence[str] = (), facts: Sequence[str] = ()) -> Star:
        """Stores these tables, so that what reads them several times doesn't make them each time."""
        self.registries([n for n in dimensions if n != "date"])
        for kind, names, make in (("dim", dimensions, self.dimension), ("fact", facts, self.fact)):
            made = {n: make(n) for n in names}
            self._together(lambda n, kind=kind, made=made: self.made.update({f"{kind} {n}": stored(made[n], f"{kind}-{n}")}), list(made))
        return self

    def _dimension(self, name: str) -> DataFrame:
        d = DIMENSIONS[name]
        self.registries([name, *(parent for _, parent, _ in d.refs.values())])
        x = self.entity(name).join(self.registry(name).withColumnRenamed("surrogate_key", f"{name}_key"), d.natural)
        for ref, (column, parent, keep_null) in d.refs.items():
            x = self.lookup(x, column, parent, ref, keep_null)
        x = x.select(f"{name}_key", d.natural, *d.attributes, *d.refs, *[F.expr(e).alias(c) for c, e in d.always.items()])
        given = {f"{name}_key": "-1", d.natural: "'UNKNOWN'"} | {c: "-1" for c, r in d.refs.items() if not r[2]} | d.unknown | d.always
        return x.unionByName(self.spark.range(1).select(*[F.expr(given.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in x.schema]))

    def _dates(self) -> DataFrame:
        ends = [self.entity(e).agg(F.min(F.col(c).cast("date")).alias("a"), F.max(F.col(c).cast("date")).alias("b")) for e, c in DATES if e not in DAYS_OF]
        days = reduce(DataFrame.unionByName, ends).agg(F.sequence(F.min("a"), F.max("b")).alias("d")).select(F.explode("d").alias("full_date"))
        d = F.col("full_date")
        names = {"month_name": F.date_format(d, "MMMM"), "day_name": F.date_format(d, "EEEE")}
        return days.select("full_date", *[c.alias(n) for n, c in (X.iso_calendar(d) | names).items()]).select(*CALENDAR)

    def fact(self, name: str, only: Sequence[str] | None = None) -> DataFrame:
        """A fact; only: of its keys, those that are needed (a lookup is a join that can't be pruned)."""

        def make() -> DataFrame:
            entity, refs, columns, date, _ = FACTS[name]
            refs = {r: v for r, v in refs.items() if only is None or r in only}
            x = self.entity(entity)
            if "operation" in x.columns:
                x = x.filter("operation <> 'd'")
            self.registries(dim for _, dim in refs.values())
            for ref, (column, dim) in refs.items():
                x = self.lookup(x, column, dim, ref)
            x = x.withColumn("date_key", X.date_key(F.col(date).cast("date")))
            return x.select("date_key", *refs, *[F.expr(e).alias(c) for c, e in columns.items()])

        if f"fact {name}" in self.made or only is None:
            return self._once(f"fact {name}", make)
        return self._once(f"fact {name} {sorted(only)}", make)

    def gate(self) -> DataFrame:
        """(check_name, n_violations): keys unique in dimensions, grains of facts, references, counts against the sources, control totals.

        One grouping of all keys and grains, one pass over each fact for all that its rows and totals must satisfy, and a count of each source.
        """
        self.keep((*DIMENSIONS, "date"), FACTS)
        keyed = {("date", "date_key"): ("unique dim_date.date_key", ["date_key"])}
        keyed |= {(n, c): (f"unique dim_{n}.{c}", [c]) for n, d in DIMENSIONS.items() for c in (f"{n}_key", d.natural)}
        parts = [gates.named_keys(self.dimension(n), {check: columns for (dim, _), (check, columns) in keyed.items() if dim == n}) for n in (*DIMENSIONS, "date")]
        parts += [gates.named_keys(self.fact(n), {f"grain fact_{n}": grain}) for n, (*_, grain) in FACTS.items()]
        names = [check for check, _ in keyed.values()] + [f"grain fact_{n}" for n in FACTS]
        report = gates.repeats_by_name(reduce(DataFrame.unionByName, parts), names)
        amounts = {"transactions": ("amount", "transaction_status = 'APPROVED'"), "settlements": ("settlement_amount", "true"), "reconciliation": ("expected_amount", "true")}
        check = lambda name, n: F.struct(F.lit(name).alias("check_name"), n.cast("long").alias("n_violations"))
        passes = []
        for n, (entity, refs, *_) in FACTS.items():
            source = self.entity(entity)
            source = source.filter("operation <> 'd'") if "operation" in source.columns else source
            parents = {f"reference fact_{n}.{r}": (r, self.dimension(dim), f"{dim}_key", keys.UNKNOWN_KEY) for r, (_, dim) in refs.items()}
            parents[f"reference fact_{n}.date_key"] = ("date_key", self.dimension("date"), "date_key", None)
            amount, which = amounts.get(n, (None, "true"))
            total = F.sum(F.when(F.expr(which), F.col(amount))) if amount else F.lit(None)
            one = gates.orphan_counts(self.fact(n), parents, {"n_rows": F.count("*"), "n_counted": F.count_if(F.expr(which)), "total": total.cast("decimal(38,4)")})
            one = one.crossJoin(F.broadcast(source.agg(F.count("*").alias("n_source"))))
            counts = [check(c, F.col(f"`{c}`")) for c in parents] + [check(f"rows fact_{n}", F.abs(F.col("n_source") - F.col("n_rows")))]
            passes.append(one.select(F.lit(n).alias("fact"), "n_counted", "total", F.array(*counts).alias("counts")))
        of = lambda n, c: F.max(F.when(F.col("fact") == n, F.col(c)))
        sums = [F.coalesce(of(n, "total"), F.lit(0).cast("decimal(38,4)")) for n in amounts]
        equal = F.coalesce((sums[0] == sums[1]) & (sums[1] == sums[2]), F.lit(False))
        settled = F.abs(of("transactions", "n_counted") - of("settlements", "n_counted"))
        # a row a fact
        whole = reduce(DataFrame.unionByName, passes).agg(F.flatten(F.collect_list("counts")).alias("counts"), settled.alias("settled"), F.when(equal, 0).otherwise(1).alias("totals"))
        checks = F.concat("counts", F.array(check("approved transactions are settled", F.col("settled")), check("control totals", F.col("totals"))))
        return report.unionByName(whole.select(F.explode(checks).alias("x")).select("x.*"))

    def control_totals(self) -> DataFrame:
        """Approved, settled and expected amounts; passed if all are there and equal."""
        one = [
            gates.control_total(self.fact("transactions", ()).filter("transaction_status = 'APPROVED'"), F.col("amount"), "approved"),
            gates.control_total(self.fact("settlements", ()), F.col("settlement_amount"), "settled"),
            gates.control_total(self.fact("reconciliation", ()), F.col("expected_amount"), "expected"),
        ]
        x = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one)  # one row each
        return x.withColumn("passed", F.expr("coalesce(approved = settled AND settled = expected, false)"))

    def enriched(self, name: str, needed: Collection[str] | None = None) -> DataFrame:
        """A fact with the attributes of its dimensions (all left joins); with needed, only the joins that bring one of these columns."""
        wants = lambda columns: needed is None or not {*columns}.isdisjoint(needed)
        joins = [(dim, key, columns) for dim, key, columns in JOINS[name] if wants(columns) or (dim == "offer" and wants(CAMPAIGN))]
        refs = FACTS[name][1]
        x = self.fact(name, None if needed is None else [r for r in refs if r in needed or r in {k for _, k, _ in joins}])
        if wants(("full_date", "year", "month", "month_name")):
            x = x.join(self.dimension("date").select("date_key", "full_date", "year", "month", "month_name"), "date_key", "left")
        for dim, key, columns in joins:
            x = x.join(self.dimension(dim).select(key, *[F.col(c).alias(a) for a, c in columns.items()]), key, "left")
        if name == "rewards" and wants(CAMPAIGN):
            x = x.join(self.dimension("campaign").select("campaign_key", "campaign_id", "campaign_name"), "campaign_key", "left")
        if name == "reconciliation" and wants(("settlement_batch_id", "currency_code", "settlement_amount", "settlement_date")):
            settled = self.enriched("settlements").select("settlement_id", "settlement_batch_id", "currency_code", "settlement_amount", F.col("full_date").alias("settlement_date"))
            x = x.join(settled, "settlement_id", "left")
        return x


def _plain(text: str) -> str:
    """An entity's SQL for the checking engine."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else f"e_{m[1]}", text)


def _key_sql(dim: str, on: str, keep_null: bool = False) -> str:
    found = f"coalesce((SELECT surrogate_key FROM k_{dim} WHERE {DIMENSIONS[dim].natural} = {on}), -1)"
    return f"CASE WHEN {on} IS NOT NULL THEN {found} END" if keep_null else found


def star_sql() -> str:
    """The whole star as common table expressions (no WITH): e_ entities, k_ registries, d_ dimensions, f_ facts."""
    parts = [f"e_{n} AS ({_plain(s)})" for n, s in ENTITIES.items()]
    parts.append("""e_transaction_chain AS (SELECT t.*, k.cardholder_id, h.enrolled_program_id AS program_id, p.client_id FROM e_transaction t LEFT JOIN e_card_token k ON t.token_id = k.token_id
        LEFT JOIN e_cardholder h ON k.cardholder_id = h.cardholder_id LEFT JOIN e_program p ON h.enrolled_program_id = p.program_id)""")
    parts.append("""e_hit AS (SELECT t.*, o.offer_id, o.offer_type, o.offer_value, o.min_transaction_amount, row_number() OVER (PARTITION BY t.transaction_id ORDER BY o.offer_id) AS n FROM e_transaction_chain t JOIN e_campaign c ON t.program_id = c.program_id
        JOIN e_offer o ON o.campaign_id = c.campaign_id AND t.txn_date BETWEEN o.valid_from AND o.valid_to AND (o.eligible_mcc_code IS NULL OR o.eligible_mcc_code = t.mcc_code) WHERE t.status = 'APPROVED')""")
    parts.append("""e_paid AS (SELECT *, CAST(CASE WHEN amount < min_transaction_amount THEN 0 WHEN offer_type = 'CASHBACK_PCT' THEN round(amount * offer_value, 2) ELSE offer_value END AS DECIMAL(18,4)) AS reward_amount FROM e_hit WHERE n = 1),
        e_reward_event AS (SELECT 'W' || CAST(seq AS VARCHAR) AS reward_id, seq AS kafka_offset, transaction_id, offer_id, CASE WHEN reward_amount > 0 THEN 'QUALIFIED' ELSE 'NOT_QUALIFIED' END AS qualification_status, reward_amount,
        currency_code AS reward_currency, CAST(txn_date AS TIMESTAMP) AS event_timestamp, CASE WHEN seq % 89 = 0 THEN 'd' ELSE 'c' END AS operation FROM e_paid)""")
    for n, d in DIMENSIONS.items():
        parts.append(f"k_{n} AS (SELECT {d.natural}, CAST(row_number() OVER (ORDER BY {d.natural}) AS INT) AS surrogate_key FROM (SELECT DISTINCT {d.natural} FROM e_{n}))")
    for n, d in DIMENSIONS.items():
        columns = [f"k.surrogate_key AS {n}_key", f"e.{d.natural}", *[f"e.{a}" for a in d.attributes], *[f"{_key_sql(p, f'e.{c}', z)} AS {r}" for r, (c, p, z) in d.refs.items()], *[f"{e} AS {c}" for c, e in d.always.items()]]
        given = {c: "-1" for c, r in d.refs.items() if not r[2]} | d.unknown | d.always
        unknown = ["-1", "'UNKNOWN'", *[given.get(c, "NULL") for c in (*d.attributes, *d.refs, *d.always)]]
        parts.append(f"d_{n} AS (SELECT {', '.join(columns)} FROM e_{n} e JOIN k_{n} k ON e.{d.natural} = k.{d.natural} UNION ALL SELECT {', '.join(unknown)})")
    days = " UNION ALL ".join(f"SELECT CAST({c} AS DATE) AS d FROM e_{e}" for e, c in DATES)
    parts.append(f"""days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ({days})),
        d_date AS (SELECT CAST(year(d)*10000+month(d)*100+day(d) AS INT) AS date_key, d AS full_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, monthname(d) AS month_name,
        CAST(day(d) AS INT) AS day, CAST(isodow(d) AS INT) AS day_of_week, dayname(d) AS day_name, CAST(week(d) AS INT) AS week_of_year, isodow(d) >= 6 AS is_weekend FROM days)""")
    for n, (entity, refs, columns, date, _) in FACTS.items():
        where = " WHERE operation <> 'd'" if entity in ("transaction_event", "reward_event") else ""
        picked = [f"CAST(year({date})*10000+month({date})*100+day({date}) AS INT) AS date_key", *[f"{_key_sql(d, f'e.{c}')} AS {r}" for r, (c, d) in refs.items()], *[f"{e} AS {c}" for c, e in columns.items()]]
        parts.append(f"f_{n} AS (SELECT {', '.join(picked)} FROM e_{entity} e{where})")
    parts.append("totals AS (SELECT (SELECT coalesce(sum(amount), 0) FROM f_transactions WHERE transaction_status = 'APPROVED') AS approved, (SELECT coalesce(sum(settlement_amount), 0) FROM f_settlements) AS settled, (SELECT coalesce(sum(expected_amount), 0) FROM f_reconciliation) AS expected)")
    date = "d.full_date, d.year, d.month, d.month_name"
    parts.append(f"""n_transactions AS (SELECT f.*, {date}, m.merchant_id, m.merchant_name, c.mcc_code, c.description AS mcc_description, u.currency_code, p.program_id, p.program_name, p.program_type, l.client_id, l.legal_name AS client_legal_name
        FROM f_transactions f LEFT JOIN d_date d USING (date_key) LEFT JOIN d_merchant m USING (merchant_key) LEFT JOIN d_mcc c USING (mcc_key) LEFT JOIN d_currency u USING (currency_key) LEFT JOIN d_program p USING (program_key) LEFT JOIN d_client l ON f.client_key = l.client_key),
        n_settlements AS (SELECT f.*, {date}, u.currency_code FROM f_settlements f LEFT JOIN d_date d USING (date_key) LEFT JOIN d_currency u USING (currency_key)),
        n_reconciliation AS (SELECT f.*, {date}, s.settlement_batch_id, s.currency_code, s.settlement_amount, s.full_date AS settlement_date FROM f_reconciliation f LEFT JOIN d_date d USING (date_key) LEFT JOIN n_settlements s USING (settlement_id)),
        n_rewards AS (SELECT f.*, {date}, u.currency_code, o.offer_id, o.offer_type, o.campaign_key, c.campaign_id, c.campaign_name FROM f_rewards f LEFT JOIN d_date d USING (date_key) LEFT JOIN d_currency u USING (currency_key) LEFT JOIN d_offer o USING (offer_key) LEFT JOIN d_campaign c USING (campaign_key))""")
    return ",\n".join(parts)


def gate_sql() -> str:
    one = []
    for n, d in DIMENSIONS.items():
        for c in (f"{n}_key", d.natural):
            one.append(f"SELECT 'unique dim_{n}.{c}' AS check_name, count(*) AS n_violations FROM (SELECT {c} FROM d_{n} GROUP BY {c} HAVING count(*) > 1)")
    one.append("SELECT 'unique dim_date.date_key', count(*) FROM (SELECT date_key FROM d_date GROUP BY date_key HAVING count(*) > 1)")
    for n, (entity, refs, _, _, grain) in FACTS.items():
        g = ", ".join(grain)
        one.append(f"SELECT 'grain fact_{n}', count(*) FROM (SELECT {g} FROM f_{n} GROUP BY {g} HAVING count(*) > 1)")
        for r, (_, d) in refs.items():
            one.append(f"SELECT 'reference fact_{n}.{r}', count(*) FROM f_{n} WHERE {r} <> -1 AND {r} NOT IN (SELECT {d}_key FROM d_{d})")
        one.append(f"SELECT 'reference fact_{n}.date_key', count(*) FROM f_{n} WHERE date_key NOT IN (SELECT date_key FROM d_date)")
        where = " WHERE operation <> 'd'" if entity in ("transaction_event", "reward_event") else ""
        one.append(f"SELECT 'rows fact_{n}', abs((SELECT count(*) FROM e_{entity}{where}) - (SELECT count(*) FROM f_{n}))")
    one.append("SELECT 'approved transactions are settled', abs((SELECT count(*) FROM f_transactions WHERE transaction_status = 'APPROVED') - (SELECT count(*) FROM f_settlements))")
    one.append("SELECT 'control totals', CASE WHEN approved = settled AND settled = expected THEN 0 ELSE 1 END FROM totals")
    return "SELECT check_name, CAST(n_violations AS BIGINT) AS n_violations FROM (" + " UNION ALL ".join(one) + ")"
