"""The gate over the entities before they become a star: keys, references, amounts, one report that can raise.

One pass over each entity, and one grouping of all values of keys and of references to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates
from .gold import Star, star_sql
from .registry import query

#: Entity -> its keys; a settlement belongs to one transaction, and a reconciliation to one settlement.
KEYS = {
    "client": ("client_id",), "program": ("program_id",), "campaign": ("campaign_id",), "offer": ("offer_id",), "cardholder": ("cardholder_id",), "card_token": ("token_id",), "transaction": ("transaction_id",),
    "transaction_event": ("event_id",), "settlement": ("settlement_id", "transaction_id"), "reconciliation": ("reconciliation_id", "settlement_id"), "reward_event": ("reward_id",),
}
#: Entity, column, parent, its key, whether null may stand, the parent's rows that count.
REFERENCES = (
    ("client", "lei", "legal_entity", "lei", False, None),
    ("program", "client_id", "client", "client_id", False, "client_type = 'PROGRAM_OWNER'"),
    ("program", "currency_code", "currency", "currency_code", False, None),
    ("campaign", "program_id", "program", "program_id", False, None),
    ("offer", "campaign_id", "campaign", "campaign_id", False, None),
    ("offer", "eligible_mcc_code", "mcc", "mcc_code", True, None),
    ("offer", "currency_code", "currency", "currency_code", False, None),
    ("cardholder", "enrolled_program_id", "program", "program_id", False, None),
    ("cardholder", "country_code", "country", "country_code_alpha3", False, None),
    ("card_token", "cardholder_id", "cardholder", "cardholder_id", False, None),
    ("card_token", "bin_range", "card_issuer", "bin_range", False, None),
    ("transaction", "token_id", "card_token", "token_id", False, None),
    ("transaction", "merchant_id", "merchant", "merchant_id", False, None),
    ("transaction", "mcc_code", "mcc", "mcc_code", False, None),
    ("transaction", "currency_code", "currency", "currency_code", False, None),
    ("transaction_event", "transaction_id", "transaction", "transaction_id", False, None),
    ("settlement", "transaction_id", "transaction", "transaction_id", False, None),
    ("reconciliation", "settlement_id", "settlement", "settlement_id", False, None),
    ("reward_event", "transaction_id", "transaction", "transaction_id", False, None),
    ("reward_event", "offer_id", "offer", "offer_id", False, None),
)
#: Entity -> name of a rule and what breaks it.
AMOUNTS = {
    "transaction": {"positive amount": "NOT coalesce(amount > 0, false)"},
    "offer": {"positive min_transaction_amount": "NOT coalesce(min_transaction_amount > 0, false)", "positive offer_value": "NOT coalesce(offer_value > 0, false)"},
    "settlement": {"positive settlement_amount": "NOT coalesce(settlement_amount > 0, false)", "positive net_amount": "NOT coalesce(net_amount > 0, false)"},
    "reward_event": {
        "qualified has a reward": "qualification_status = 'QUALIFIED' AND NOT coalesce(reward_amount > 0, false)", "not qualified has none": "qualification_status = 'NOT_QUALIFIED' AND NOT coalesce(reward_amount = 0, false)",
    },
}


def report(star: Star) -> DataFrame:
    """(check_name, n_violations)."""
    # a parent's key is place 0 of a domain, and each column that refers to it another place
    domains: dict[tuple[str, str, str | None], list[tuple[str, str]]] = {}
    for e, column, parent, key, _, which in REFERENCES:
        domains.setdefault((parent, key, which), []).append((e, column))
    at = {child: (n, place) for n, children in enumerate(domains.values()) for place, child in enumerate(children, 1)}
    puts: dict[tuple[str, str | None], list] = {}
    for n, ((parent, key, which), children) in enumerate(domains.items()):
        if which is None:
            at.setdefault((parent, key), (n, 0))
        puts.setdefault((parent, which), []).append((n, 0, F.col(key)))
        for place, (e, column) in enumerate(children, 1):
            puts.setdefault((e, None), []).append((n, place, F.col(column)))
    n, checks = len(domains), {}
    for e, columns in KEYS.items():
        for c in columns:
            if (e, c) not in at:
                at[e, c], n = (n, 0), n + 1
                puts.setdefault((e, None), []).append((*at[e, c], F.col(c)))
            checks[f"unique {e}.{c}"] = ("repeats", *at[e, c])
    for e, column, _, _, optional, _ in REFERENCES:
        checks[f"reference {e}.{column}"] = ("orphans", *at[e, column])
        if not optional:
            checks[f"missing {e}.{column}"] = ("nulls", *at[e, column])
    for e, rules in AMOUNTS.items():
        for name, broken in rules.items():
            # a domain of the rule's own, in which rows that break it have no value
            puts.setdefault((e, None), []).append((n, 0, F.when(~F.coalesce(F.expr(broken), F.lit(False)), "kept")))
            checks[f"{e}: {name}"], n = ("nulls", n, 0), n + 1
    found = gates.domain_counts([(star.entity(e) if which is None else star.entity(e).filter(which), values) for (e, which), values in puts.items()])
    # a row a domain
    one = found.agg(*[F.coalesce(F.max(F.when(F.col("domain") == domain, F.col(kind)[place])), F.lit(0)).alias(name) for name, (kind, domain, place) in checks.items()])
    return one.unpivot([], [F.col(f"`{name}`") for name in checks], "check_name", "n_violations")


def require(star: Star, allow: tuple[str, ...] = ()) -> None:
    """Raises GateError, with what was found, unless only checks in allow have violations."""
    gates.require(report(star).filter(~F.col("check_name").isin(*allow)), "n_violations = 0", "the dataset is not sound")


def _sql() -> str:
    one = [f"SELECT 'unique {e}.{c}' AS check_name, count(*) AS n_violations FROM (SELECT {c} FROM e_{e} GROUP BY {c} HAVING count(*) > 1)" for e, columns in KEYS.items() for c in columns]
    for e, column, parent, key, optional, which in REFERENCES:
        where = f" WHERE {which}" if which else ""
        one.append(f"SELECT 'reference {e}.{column}', count(*) FROM e_{e} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM e_{parent}{where})")
        if not optional:
            one.append(f"SELECT 'missing {e}.{column}', count(*) FROM e_{e} WHERE {column} IS NULL")
    one += [f"SELECT '{e}: {n}', count(*) FROM e_{e} WHERE {broken}" for e, rules in AMOUNTS.items() for n, broken in rules.items()]
    return f"WITH {star_sql()} SELECT check_name, CAST(n_violations AS BIGINT) AS n_violations FROM ({' UNION ALL '.join(one)})"


@query(_sql())
def dataset_gate(spark, sf):
    """All keys, references and amounts of the entities."""
    return report(Star(spark, sf))
