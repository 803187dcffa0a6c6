"""The eleven captured tables: their typed records, checks and keys, and the job that folds a table's events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import JSON
from ..sources.stored import stored
from . import cdc
from .checks import ColumnSpec, TableSpec

#: The eleven tables, their keys, whether they hold states or a log, and what their columns must satisfy.
SPECS: tuple[tuple[TableSpec, str], ...] = (
    (TableSpec("clients", "client_id", (
        ColumnSpec("client_id", required=True),
        ColumnSpec("lei", required=True),
        ColumnSpec("legal_name", required=True),
        ColumnSpec("client_type", required=True, values=("ISSUER", "NETWORK", "PROGRAM_OWNER")),
        ColumnSpec("country_code"),
        ColumnSpec("onboarding_date", "date", required=True),
        ColumnSpec("status", required=True),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("programs", "program_id", (
        ColumnSpec("program_id", required=True),
        ColumnSpec("client_id", required=True),
        ColumnSpec("program_name", required=True),
        ColumnSpec("program_type", required=True, values=("CASHBACK", "LOYALTY", "CO_BRAND")),
        ColumnSpec("currency_code", required=True),
        ColumnSpec("status", required=True),
        ColumnSpec("start_date", "date", required=True),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("campaigns", "campaign_id", (
        ColumnSpec("campaign_id", required=True),
        ColumnSpec("program_id", required=True),
        ColumnSpec("campaign_name", required=True),
        ColumnSpec("start_date", "date", required=True),
        ColumnSpec("end_date", "date", required=True),
        ColumnSpec("status", required=True, values=("ACTIVE", "ENDED", "SCHEDULED")),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("offers", "offer_id", (
        ColumnSpec("offer_id", required=True),
        ColumnSpec("campaign_id", required=True),
        ColumnSpec("eligible_mcc_code"),
        ColumnSpec("offer_type", required=True, values=("CASHBACK_PCT", "FIXED_AMOUNT")),
        ColumnSpec("offer_value", "decimal(18,4)", required=True, positive=True),
        ColumnSpec("min_transaction_amount", "decimal(18,4)", required=True, positive=True),
        ColumnSpec("currency_code", required=True),
        ColumnSpec("status", required=True),
        ColumnSpec("valid_from", "date", required=True),
        ColumnSpec("valid_to", "date", required=True),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("cardholders", "cardholder_id", (
        ColumnSpec("cardholder_id", required=True),
        ColumnSpec("pseudonym", required=True),
        ColumnSpec("country_code", required=True),
        ColumnSpec("enrolled_program_id", required=True),
        ColumnSpec("enrollment_date", "date", required=True),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("card_tokens", "token_id", (
        ColumnSpec("token_id", required=True),
        ColumnSpec("cardholder_id", required=True),
        ColumnSpec("bin_range", required=True),
        ColumnSpec("card_brand", required=True),
        ColumnSpec("token_status", required=True, values=("ACTIVE", "SUSPENDED", "EXPIRED")),
        ColumnSpec("issued_date", "date", required=True),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("transactions", "transaction_id", (
        ColumnSpec("transaction_id", required=True),
        ColumnSpec("token_id", required=True),
        ColumnSpec("merchant_id", required=True),
        ColumnSpec("mcc_code", required=True),
        ColumnSpec("mcc_confidence", "decimal(18,4)", required=True),
        ColumnSpec("currency_code", required=True),
        ColumnSpec("amount", "decimal(18,4)", required=True, positive=True),
        ColumnSpec("transaction_timestamp", "timestamp", required=True),
        ColumnSpec("status", required=True, values=("APPROVED", "DECLINED")),
        ColumnSpec("decline_reason"),
        ColumnSpec("auth_code"),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("settlements", "settlement_id", (
        ColumnSpec("settlement_id", required=True),
        ColumnSpec("transaction_id", required=True),
        ColumnSpec("settlement_batch_id", required=True),
        ColumnSpec("settlement_date", "date", required=True),
        ColumnSpec("settlement_amount", "decimal(18,4)", required=True, positive=True),
        ColumnSpec("settlement_currency", required=True),
        ColumnSpec("fee_amount", "decimal(18,4)", required=True),
        ColumnSpec("net_amount", "decimal(18,4)", required=True, positive=True),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("reconciliation", "reconciliation_id", (
        ColumnSpec("reconciliation_id", required=True),
        ColumnSpec("settlement_id", required=True),
        ColumnSpec("expected_amount", "decimal(18,4)", required=True),
        ColumnSpec("actual_amount", "decimal(18,4)", required=True),
        ColumnSpec("variance", "decimal(18,4)", required=True),
        ColumnSpec("match_status", required=True, values=("MATCHED", "EXCEPTION")),
        ColumnSpec("reconciled_date", "date", required=True),
        ColumnSpec("source_type", required=True),
    )), "state"),
    (TableSpec("transaction_events", "event_id", (
        ColumnSpec("event_id", required=True),
        ColumnSpec("transaction_id", required=True),
        ColumnSpec("event_type", required=True, values=("AUTHORIZATION", "CAPTURE", "REVERSAL")),
        ColumnSpec("event_timestamp", "timestamp", required=True),
        ColumnSpec("event_status", required=True),
        ColumnSpec("source_type", required=True),
    )), "log"),
    (TableSpec("reward_events", "reward_id", (
        ColumnSpec("reward_id", required=True),
        ColumnSpec("transaction_id", required=True),
        ColumnSpec("offer_id", required=True),
        ColumnSpec("qualification_status", required=True, values=("QUALIFIED", "NOT_QUALIFIED")),
        ColumnSpec("reward_amount", "decimal(18,4)", required=True),
        ColumnSpec("reward_currency", required=True),
        ColumnSpec("event_timestamp", "timestamp", required=True),
        ColumnSpec("source_type", required=True),
    )), "log"),
)


def specs() -> dict[str, tuple[TableSpec, str]]:
    """Table -> (its spec, state or log)."""
    return {spec.name: (spec, mode) for spec, mode in SPECS}


def key_text(spec: TableSpec) -> Column:
    """The key as a JSON array."""
    return F.to_json(F.array(F.col(spec.key).cast("string")))


def schema_of(spec: TableSpec) -> str:
    return ", ".join(f"`{c.name}` {c.kind}" for c in spec.columns)


def typed_events(bronze: DataFrame, spec: TableSpec) -> DataFrame:
    """_off, _op, _lsn, _ts, _reason (why an event can't be used; null for tombstones), and the typed columns of its image.

    bronze: kafka_offset, operation, before, after, source_lsn, and problem if envelopes were parsed.
    """
    is_delete = F.col("operation") == "d"
    image = F.when(is_delete, F.col("before")).when(F.coalesce(F.col("operation") != "seen", F.lit(True)), F.col("after"))
    problem = F.col("problem") if "problem" in bronze.columns else F.lit(None).cast("string")
    x = bronze.select(F.col("kafka_offset").cast("long").alias("_off"), F.col("operation").alias("_op"), F.col("source_lsn").cast("long").alias("_lsn"), problem.alias("_problem"), image.alias("_image"))
    x = x.withColumn("_values", F.from_json("_image", "map<string,string>"))
    x = x.select("_off", "_op", "_lsn", "_problem", "_image", *spec.typed(F.col("_values")))
    reason: Column = F.coalesce("_problem", F.when(F.col("_image").isNull(), "missing_payload_for_operation"), spec.first_failure(F.col("_op") == "d"))
    return x.withColumn("_reason", F.when(F.col("_op") != "t", reason)).drop("_problem", "_image")


def judged(bronze: DataFrame, spec: TableSpec, checkpoint: DataFrame | None = None, mode: str = "log") -> DataFrame:
    """A stored row an event: _row (its number), key, kafka_offset, operation, source_lsn, record (its typed image as JSON, columns in order of name; null for deletes of a state table), early (what it is without a look at any state; null: to be folded), reason. Images are parsed once."""
    if checkpoint is not None:
        seen = checkpoint.select("source_topic", "kafka_partition", F.col("kafka_offset").alias("_seen"))
        bronze = bronze.join(seen, ["source_topic", "kafka_partition"], "left")
        bronze = bronze.withColumn("operation", F.when(F.col("kafka_offset") <= F.col("_seen"), "seen").otherwise(F.col("operation")))
    op = F.col("_op")
    early = F.when(op == "seen", "duplicates_skipped").when(op == "t", "tombstone_ignored").when(F.col("_reason").isNotNull(), "quarantined")
    x = typed_events(bronze, spec).withColumn("early", early)
    needed = F.col("early").isNull() if mode == "log" else F.col("early").isNull() & ~op.eqNullSafe(F.lit("d"))
    kept = x.select(
        F.monotonically_increasing_id().alias("_row"), F.when(op != "seen", F.col(spec.key)).alias(spec.key), F.col("_off").alias("kafka_offset"), op.alias("operation"), F.col("_lsn").alias("source_lsn"),
        F.when(needed, _record(spec)).alias("record"), "early", F.when(F.col("early") == "quarantined", F.col("_reason")).alias("reason"),
    )
    return stored(kept, "judged", "zstd")


def _record(spec: TableSpec) -> Column:
    """What record_hash() is the hash of."""
    return F.to_json(F.struct(*sorted(c.name for c in spec.columns)), JSON)


def _by_record(state: DataFrame, spec: TableSpec) -> DataFrame:
    """state with its record, written as judged() writes it, in place of the digest."""
    s = state.withColumn("_r", F.from_json("state.record", schema_of(spec), JSON))
    record = F.when(F.col("state.record").isNotNull(), F.to_json(F.struct(*[F.col(f"_r.{n}").alias(n) for n in sorted(c.name for c in spec.columns)]), JSON))
    return s.select(spec.key, F.struct("state.lsn", "state.deleted", record.alias("digest"), F.lit(None).cast("string").alias("record")).alias("state"))


def process(bronze: DataFrame, spec: TableSpec, mode: str, state: DataFrame | None = None, checkpoint: DataFrame | None = None) -> DataFrame:
    """(key, kafka_offset, disposition, reason, state, is_last): every event once, and a row at each key's end with its state.

    Events up to the checkpoint are duplicates_skipped; tombstones are tombstone_ignored; events that
    can't be used, or that break the table's rules, are quarantined with a reason. In a log, an appended event's
    state is the event itself. A state table's events are compared by their records, which hold all that digests would tell;
    digests are taken of the states at the end.
    """
    key, none = spec.key, F.lit(None)
    x = judged(bronze, spec, checkpoint, mode)
    good = x.filter("early IS NULL")
    if mode == "log":
        folded = cdc.fold_log_rows(good.select(key, "kafka_offset", "operation", "source_lsn", F.sha2("record", 256).alias("digest"), "record"), key, state)
    else:
        good = good.select("_row", key, "kafka_offset", "operation", "source_lsn", F.col("record").alias("digest"), none.cast("string").alias("record"))
        folded = cdc.fold_rows(good, key, None if state is None else _by_record(state, spec))
        held = F.struct("state.lsn", "state.deleted", F.sha2("state.digest", 256).alias("digest"), F.col("state.digest").alias("record"))
        folded = folded.withColumn("state", F.when(F.col("is_last"), held))
    broken = F.col("disposition").isin("conflict_update_after_delete", "conflict_same_lsn", "duplicate_primary_key")
    folded = folded.select(key, "kafka_offset", F.when(broken, "quarantined").otherwise(F.col("disposition")).alias("disposition"), F.when(broken, F.col("disposition")).alias("reason"), "state", "is_last")
    rest = x.filter("early IS NOT NULL").select(key, "kafka_offset", F.col("early").alias("disposition"), "reason", none.cast(cdc.STATE).alias("state"), F.lit(False).alias("is_last"))
    return folded.unionByName(rest)


def state_of(processed: DataFrame, spec: TableSpec) -> DataFrame:
    """(key, state) to carry to the next run: tombstones stay, as the memory of deletes."""
    return processed.filter("is_last AND state IS NOT NULL").select(spec.key, "state")


def current_rows(state: DataFrame, spec: TableSpec) -> DataFrame:
    """The typed rows that live, with record_hash and the log position of the event that last changed them."""
    live = state.filter("NOT state.deleted").select(F.from_json("state.record", schema_of(spec), JSON).alias("r"), F.col("state.digest").alias("record_hash"), F.col("state.lsn").alias("source_lsn"))
    return live.select("r.*", "record_hash", "source_lsn")


def process_all(bronze: DataFrame, states: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """process() for each table of bronze (by source_table)."""
    return {name: process(bronze.filter(F.col("source_table") == name), spec, mode, (states or {}).get(name)) for name, (spec, mode) in specs().items()}
