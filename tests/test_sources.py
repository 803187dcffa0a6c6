"""Reference datasets, suites, marks, captured tables, sources, scalars and delivery on small fixtures."""

import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.operators import cdc, cdc_tables, checks, dedupe, gates, merge, watermarks
from lodestone.plans import delivery, marts
from lodestone.plans import reference as R
from lodestone.sources import files
from lodestone.streaming import changes

D = decimal.Decimal


def values(spark, rows, kind, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kind).select(*columns).collect()]


def test_scalars(spark):
    c = F.col
    assert values(spark, [(" ab ", "Y", "1e2", "1.5")], "a string, b string, c string, d string", X.upper_or_null(c("a")), X.yes_no(c("b")), X.int_or_null(c("c")), X.double_or_null(c("d"))) == [("AB", True, None, 1.5)]
    assert values(spark, [("maybe",), ("NO",), (None,)], "b string", X.yes_no(c("b"))) == [(None,), (False,), (None,)]
    got = values(spark, [("2024-02-29T01:02:03Z", "0"), ("nonsense", "x")], "a string, b string", X.timestamp_or_null(c("a")), X.timestamp_from_micros(c("b")))
    assert got == [(dt.datetime(2024, 2, 29, 1, 2, 3), dt.datetime(1970, 1, 1)), (None, None)]
    assert values(spark, [('{"b":1,"a":2}',), ("x",)], "a string", X.first_json_key(c("a"))) == [("b",), (None,)]
    rows = [(D("100.00"), "CASHBACK_PCT", D("0.05"), D("50")), (D("100.00"), "FIXED_AMOUNT", D("7"), D("50")), (D("10.00"), "FIXED_AMOUNT", D("7"), D("50"))]
    assert [r[0] for r in values(spark, rows, "a decimal(18,2), k string, v decimal(18,4), m decimal(18,4)", X.reward(c("a"), c("k"), c("v"), c("m")))] == [D("5"), D("7"), D("0")]
    day = dt.date(2024, 5, 5)
    assert values(spark, [(day, day)], "a date, b date", X.campaign_status(c("a"), c("b"), F.lit(day)), X.campaign_status(c("a"), c("b"), F.lit(day + dt.timedelta(1))), X.match_status(F.lit(0))) == [("ACTIVE", "ENDED", "MATCHED")]
    assert values(spark, [(D("99.99"),)], "a decimal(18,2)", X.fee(c("a")), X.date_key(F.lit(day))) == [(D("1.5000"), 20240505)]
    sunday = X.sunday_calendar(F.lit(day)) | {"iso": X.iso_calendar(F.lit(day))["day_of_week"]}
    assert values(spark, [(1,)], "a int", sunday["day_of_week"], sunday["is_weekend"], sunday["iso"]) == [(1, True, 7)]


def test_checks(spark):
    df = spark.createDataFrame([(None, "5", 1), ("a", "x", 11), ("b", None, None)], "k string, n string, v int")
    got = [tuple(r) for r in df.select(checks.castable(F.col("n"), "int"), checks.in_range(F.col("v"), 0, 10), checks.one_of(F.col("k"), ["a"])).collect()]
    assert got == [(True, True, False), (False, False, True), (True, False, False)]
    parent = spark.createDataFrame([("a",), ("a",)], "p string")
    assert [r["ok"] for r in checks.known(df, "k", parent, "p", "ok").orderBy(F.col("k").asc_nulls_first()).collect()] == [True, True, False]
    soft = checks.with_verdict(df, {"required_k": checks.required(F.col("k"))}, {"n": checks.required(F.col("n"))}).orderBy(F.col("k").asc_nulls_first()).collect()
    assert [(r["is_valid"], r["warnings"]) for r in soft] == [(False, []), (True, []), (True, ["n"])]


def test_place_records(spark):
    raw = [{"type": "node", "id": 7, "lat": 51.5, "lon": -0.1, "tags": {"name": " Shop ", "addr:city": "X"}}, {"type": "node", "lat": 1, "lon": 1, "tags": {"name": "No id"}}, {"type": "area", "id": 1, "lat": 91, "lon": 0, "tags": {"name": "Bad"}}, {"type": "node", "id": 7, "lat": 0, "lon": 0, "tags": {"name": "Again"}}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(raw)], "seq int, raw string")
    good, bad = R.conform(df, R.place(), ["seq"])
    assert [(r["merchant_id"], r["merchant_name"], r["address_city"], len(r["warnings"])) for r in good.collect()] == [("node:7", "Shop", "X", 8)]
    assert {r["seq"]: r["failing_check_name"] for r in bad.collect()} == {1: "required_merchant_id", 2: "pattern_osm_type", 3: "uniqueness_merchant_id"}


def test_rates_flat_and_ranged(spark):
    raw = [{"base": "eur", "date": "2024-01-02", "rates": {"GBP": 0.85, "USD": "x"}}, {"base": "EUR", "start_date": "2024-01-03", "end_date": "2024-01-04", "rates": {"2024-01-03": {"GBP": 0.86}, "2024-01-04": {"GBP": -1}}}, {"base": "EUR", "rates": {"GBP": 1}}]
    flat = R.flatten_rates(spark.createDataFrame([(json.dumps(r),) for r in raw], "raw string"))
    good, bad = R.conform(flat, R.fx_rate(), [], unique=False)
    assert {(str(r["rate_date"]), r["base_currency"], r["exchange_rate"]) for r in good.collect()} == {("2024-01-02", "EUR", D("0.85")), ("2024-01-03", "EUR", D("0.86"))}
    assert sorted(r["failing_check_name"] for r in bad.collect()) == ["positive_exchange_rate", "required_exchange_rate", "required_rate_date"]


def test_currencies_merge_and_are_checked_again(spark):
    rows = [(0, "aaa", "", "", "2", None), (1, "AAA", "Coin", "7", "3", None), (2, "bbb", " ", "", "", "2001"), (3, "A1", "x", "", "", None)]
    raw = spark.createDataFrame(rows, "seq int, AlphabeticCode string, Currency string, NumericCode string, MinorUnit string, WithdrawalDate string")
    good, bad = R.conform(raw, R.iso_currency(), ["seq"], unique=False)
    assert [r["failing_check_name"] for r in bad.collect()] == ["pattern_currency_code"]
    whole, left = R.merge_currencies(good, "seq")
    assert [(r["currency_code"], r["currency_name"], r["currency_numeric_code"], r["minor_unit"], r["is_active"]) for r in whole.collect()] == [("AAA", "Coin", "7", 2, True)]
    assert [(r["currency_code"], r["failing_check_name"]) for r in left.collect()] == [("BBB", "required_currency_name")]


def test_suites(spark):
    df = spark.createDataFrame([("AAA", "x", "2"), ("AAA", None, "2"), ("a1", "y", "")], "AlphabeticCode string, Currency string, MinorUnit string")
    got = {r["check_name"]: (r["n_failures"], r["passed"]) for r in R.run_suite(df, "iso_currency", R.SUITES["iso_currency"]).collect()}
    assert got == {"non_empty": (0, True), "required_AlphabeticCode": (0, True), "required_Currency": (1, False), "required_MinorUnit": (0, True), "duplicates_AlphabeticCode": (1, True), "pattern_AlphabeticCode": (1, False)}
    none = R.run_suite(df.limit(0), "iso_currency", R.SUITES["iso_currency"])
    assert not R.suite_passed(none).first()["passed"] and R.suite_passed(R.run_suite(df.limit(0), "iso_currency", R.SUITES["iso_currency"], incremental=True)).first()["passed"]
    pages = spark.createDataFrame([('{"data":[]}',), ('{"data":{}}',)], "raw string")
    assert [r["n_failures"] for r in R.run_suite(pages, "lei_page", R.SUITES["lei_page"]).filter("check_name = 'list_data'").collect()] == [1]


def test_marks(spark):
    today = dt.date(2024, 3, 1)
    assert watermarks.next_range(None, today) == (today - dt.timedelta(90), today) and watermarks.next_range(dt.date(2024, 2, 28), today) == (dt.date(2024, 2, 29), today)
    assert watermarks.next_range(today, today) is None
    marks = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], watermarks.MARKS)
    batches = spark.createDataFrame([("a", True, 3, "5"), ("b", False, 3, "5"), ("c", True, 0, "5"), ("e", True, 1, "2")], "source string, passed boolean, n_records int, latest string")
    assert {r["source"]: r["watermark"] for r in watermarks.advance(marks, batches).collect()} == {"a": "5", "b": "1", "c": "1", "d": "1", "e": "2"}


CLIENT = {"client_id": "C1", "lei": "L", "legal_name": "N", "client_type": "ISSUER", "country_code": None, "onboarding_date": "19723", "status": "ACTIVE", "source_type": "cdc"}


def bronze(spark, *events):
    rows = [("t", 0, off, op, json.dumps(image) if op == "d" and image else None, json.dumps(image) if op != "d" and image else None, lsn) for off, (op, lsn, image) in enumerate(events)]
    return spark.createDataFrame(rows, "source_topic string, kafka_partition int, kafka_offset long, operation string, before string, after string, source_lsn long")


def said(spark, *events, table="clients", **more):
    spec, mode = cdc_tables.specs()[table]
    return {r["kafka_offset"]: (r["disposition"], r["reason"]) for r in cdc_tables.process(bronze(spark, *events), spec, mode, **more).filter("NOT is_last").collect()}


def test_specs():
    made = cdc_tables.specs()
    assert len(made) == 11 and [n for n, (_, mode) in made.items() if mode == "log"] == ["transaction_events", "reward_events"]
    offer = {c.name: c for c in made["offers"][0].columns}
    assert offer["offer_value"].positive and offer["offer_value"].kind == "decimal(18,4)" and offer["offer_type"].values == ("CASHBACK_PCT", "FIXED_AMOUNT") and not offer["eligible_mcc_code"].required


@pytest.mark.parametrize("events,expected", [
    ([("c", 5, CLIENT)], [("inserted", None)]),
    ([("c", 5, CLIENT), ("u", 6, CLIENT | {"status": "X"})], [("inserted", None), ("updated", None)]),
    ([("c", 5, CLIENT), ("u", 9, CLIENT), ("u", 7, CLIENT | {"status": "X"})], [("inserted", None), ("unchanged", None), ("updated", None)]),
    ([("c", 5, CLIENT), ("u", 5, CLIENT | {"status": "X"})], [("inserted", None), ("quarantined", "conflict_same_lsn")]),
    ([("c", 5, CLIENT), ("u", 4, CLIENT | {"status": "X"})], [("inserted", None), ("stale_skipped", None)]),
    ([("c", 5, CLIENT), ("d", 6, CLIENT), ("u", 7, CLIENT)], [("inserted", None), ("deleted", None), ("quarantined", "conflict_update_after_delete")]),
    ([("c", 5, CLIENT), ("d", 6, CLIENT), ("c", 7, CLIENT)], [("inserted", None), ("deleted", None), ("inserted", None)]),
    ([("c", 5, CLIENT), ("d", 5, CLIENT), ("d", 6, CLIENT), ("d", 7, CLIENT)], [("inserted", None), ("stale_skipped", None), ("deleted", None), ("deleted", None)]),
    ([("c", 5, CLIENT), ("d", 6, CLIENT), ("c", 6, CLIENT)], [("inserted", None), ("deleted", None), ("stale_skipped", None)]),
    ([("t", 5, None), ("u", 5, None), ("d", 6, None)], [("tombstone_ignored", None), ("quarantined", "missing_payload_for_operation"), ("quarantined", "missing_payload_for_operation")]),
    ([("c", 5, CLIENT | {"client_type": "BANK"}), ("c", 6, CLIENT | {"lei": " ", "status": None}), ("d", 7, {"client_id": "C1"})], [("quarantined", "invalid_client_type"), ("quarantined", "missing_lei"), ("deleted", None)]),
    ([("c", 5, CLIENT | {"client_id": ""}), ("d", 6, {"client_id": None})], [("quarantined", "missing_client_id"), ("quarantined", "missing_client_id")]),
])
def test_state_table(spark, events, expected):
    assert said(spark, *events) == dict(enumerate(expected))


def test_event_log_table(spark):
    e = {"event_id": "E1", "transaction_id": "T", "event_type": "CAPTURE", "event_timestamp": "1700000000000000", "event_status": "OK", "source_type": "cdc"}
    assert said(spark, ("c", 1, e), ("c", 2, e), ("d", 3, e), ("c", 4, e), ("c", 5, e | {"event_type": "X"}), table="transaction_events") == {
        0: ("appended", None), 1: ("quarantined", "duplicate_primary_key"), 2: ("appended", None), 3: ("appended", None), 4: ("quarantined", "invalid_event_type")}


def test_state_and_checkpoint_go_on(spark):
    spec, mode = cdc_tables.specs()["clients"]
    events = [("c", 5, CLIENT), ("d", 8, CLIENT), ("u", 9, CLIENT), ("c", 10, CLIENT | {"status": "X"})]
    first = bronze(spark, *events[:2])
    state = cdc_tables.state_of(cdc_tables.process(first, spec, mode), spec)
    assert cdc_tables.current_rows(state, spec).count() == 0
    marks = cdc.advance(spark.createDataFrame([], "source_topic string, kafka_partition int, kafka_offset long"), first)
    whole = cdc_tables.process(bronze(spark, *events), spec, mode, state, marks)
    assert {r["kafka_offset"]: r["disposition"] for r in whole.filter("NOT is_last").collect()} == {0: "duplicates_skipped", 1: "duplicates_skipped", 2: "quarantined", 3: "inserted"}
    live = cdc_tables.current_rows(cdc_tables.state_of(whole, spec), spec).first()
    assert (live["client_id"], live["status"], live["onboarding_date"], live["source_lsn"]) == ("C1", "X", dt.date(2024, 1, 1), 10)


def test_envelopes(spark):
    source = {"connector": "pg", "db": "d", "schema": "public", "table": "clients", "lsn": 3, "ts_ms": 4, "snapshot": "false"}
    good = {"payload": {"op": "c", "after": {"a": 1}, "source": source, "transaction": {"id": "x", "total_order": 1}}}
    rows = [("{}", json.dumps(good)), ("{}", None), ("{", json.dumps(good)), ("{}", "{"), ("{}", "{}"), ("{}", '{"payload":{"after":{}}}'), ("{}", '{"payload":{"op":"d"}}'), (None, '{"payload":{"op":"z"}}')]
    raw = spark.createDataFrame([(k, v, "s.public.clients", 0, n) for n, (k, v) in enumerate(rows)], "key string, value string, topic string, kafka_partition int, kafka_offset long")
    x = cdc.parse_envelope(raw, key="key").withColumn("source_topic", F.col("topic"))
    assert [r["problem"] for r in x.orderBy("kafka_offset").collect()] == [None, None, "malformed_key", "malformed_json", "missing_payload", "missing_op", "missing_payload_for_operation", "unknown_op"]
    kept = cdc.bronze_records(x).orderBy("kafka_offset").collect()
    assert len(kept) == 2 and kept[0]["source_table"] == "clients" and kept[0]["after"] == '{"a":1}' and kept[0]["snapshot_indicator"] is None and kept[1]["operation"] == "t" and len(kept[0]) == 19


def test_capture_runs_to_the_end(spark, tmp_path):
    rows = [(json.dumps({"payload": {"op": "c", "after": "{}", "source": {"lsn": k}}}) if k % 3 else "{", "s.public.clients", k % 2, k) for k in range(30)]
    kind = "value string, topic string, kafka_partition int, kafka_offset long"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    q = changes.capture(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 20 and spark.read.json(str(tmp_path / "bad")).count() == 10


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,\n" a ",b,c\n')
    assert [tuple(r) for r in files.read_text_csv(spark, str(tmp_path / "a.csv"), ["x", "y"]).collect()] == [("1", None), (" a ", "b")]
    for k in (1, 2):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"data": [{"a": k}, {"a": k + 10}]}))
    got = files.read_documents(spark, [str(tmp_path / f"p{k}.json") for k in (1, 2)], "data array<struct<a:int>>", "data")
    assert sorted(r["a"] for r in got.collect()) == [1, 2, 11, 12]
    df = spark.createDataFrame([("run_1", 1), ("run_2", 2), ("run_2", 3)], "run_id string, v int")
    assert {r["v"] for r in files.latest_run(df).collect()} == {2, 3}
    assert files.after(df, "v", 2).count() == 1 and files.after(df, "v", 2, inclusive=True).count() == 2 and files.after(df, "v", None).count() == 3
    assert files.read_current(spark, str(tmp_path / "snap")) is None and files.read_snapshot(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.latest_run(df.limit(0))
    with pytest.raises(FileNotFoundError):
        files.read_metadata(spark, str(tmp_path))
    files.write_metadata(df, R.run_suite(df, "x", R.Suite(("v",))), str(tmp_path), "x", new_watermark=None)
    about = files.read_metadata(spark, str(tmp_path)).first()
    assert (about["record_count"], about["passed"], about["fields"], about["new_watermark"]) == (3, True, ["run_id", "v"], None)
    files.materialise({"made": df}, str(tmp_path / "gold"), "1")
    assert spark.table("made").count() == 3
    files.write_snapshot(df, str(tmp_path / "snap"), "001")
    files.write_snapshot(df.limit(1), str(tmp_path / "snap"), "002")
    assert files.read_current(spark, str(tmp_path / "snap")).count() == 1
    files.append_log(df, str(tmp_path / "log"), ["run_id"])
    files.append_log(df.limit(0), str(tmp_path / "log"), ["run_id"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    bad = spark.createDataFrame([("d", "r", "1", '{"a":1}', "c", "e")], "dataset string, run_id string, record_id string, raw_record string, failing_check_name string, error_reason string")
    files.write_quarantine(bad, str(tmp_path / "q"))
    assert [r["raw_record"] for r in files.read_quarantine(spark, str(tmp_path / "q"), "d").collect()] == ['{"a":1}'] and files.read_quarantine(spark, str(tmp_path / "none"), "d").count() == 0


def test_parts_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(2024, 1, 5)], "year int, month int, v int")
    files.append_part(df, str(tmp_path / "fx"), ["year", "month"], "run_1")
    with pytest.raises(FileExistsError):
        files.append_part(df, str(tmp_path / "fx"), ["year", "month"], "run_1")
    files.append_part(df, str(tmp_path / "fx"), ["year", "month"], "run_2")
    assert spark.read.parquet(str(tmp_path / "fx")).count() == 2


def test_upsert_rows_of_a_hot_key(spark):
    batch = spark.createDataFrame([("k", s % 50, f"d{s % 7}", s) for s in range(5000)], "k string, s int, d string, o int")
    x = merge.fresh_upsert_rows(spark.createDataFrame([("k", 3, "d9"), ("z", 1, "q")], "k string, s int, d string"), batch, "k", "s", "d", "o")
    now, want = (3, "d9"), {}
    for s in range(5000):
        a, d = s % 50, f"d{s % 7}"
        want[s] = "unchanged" if d == now[1] else "upsert_conflict" if a == now[0] else "updated" if a > now[0] else "stale_skipped"
        if want[s] == "updated":
            now = a, d
    assert {r["o"]: r["disposition"] for r in x.filter("NOT is_last").collect()} == want
    assert {r["k"]: (r["s"], r["d"]) for r in x.filter("is_last").collect()} == {"k": now, "z": (1, "q")}


def test_versions_and_snapshot_diff(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, s int")
    assert {(r["k"], r["effective_from"], r["effective_to"], r["is_current"]) for r in merge.versions(df, "k", "s").collect()} == {("a", 1, 3, False), ("a", 3, None, True), ("b", 2, None, True)}
    assert [r["k"] for r in merge.snapshot_diff(df.select("k").distinct(), df.filter("k = 'a'"), "k").collect()] == ["b"]
    first, rest = dedupe.keep_first(df, ["k"], ["s"])
    assert first.count() == 2 and rest.count() == 1


def test_column_tests_and_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "k string, v int")
    assert {r["test"]: r["n_failures"] for r in gates.column_tests(df, ["k"], ["k", "v"]).collect()} == {"unique_k": 1, "not_null_k": 1, "not_null_v": 1}
    assert gates.count_identity("x", df, df.limit(1)).first()["n_violations"] == 2
    with pytest.raises(gates.GateError, match="one; two"):
        gates.require_all(["one", "two"])


def test_mart_is_written_only_if_it_adds_up(spark, tmp_path):
    fact = spark.createDataFrame([("a", D("1.50")), ("b", D("2.00"))], "g string, v decimal(18,2)")
    mart = fact.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("t"))
    assert marts.write_reconciled(mart, fact, str(tmp_path / "m"), "n", "t", "v", "1") == 2
    with pytest.raises(gates.GateError):
        marts.write_reconciled(mart.limit(1), fact, str(tmp_path / "m"), "n", "t", "v", "2")
    assert marts.missing_marts(spark, str(tmp_path), {"m": ["g", "n", "q"], "x": ["a"]}) == ["m: lacks q", "x: there is none"]


MART = "client_id string, month date, n long, total decimal(18,2)"
CONFIG = delivery.Extract("sales_mart", ("client_id", "month", "n", "total"), ("client_id", "month"), "2", client_column="client_id", control="total", period=("month", None))


@pytest.fixture
def mart(spark):
    return spark.createDataFrame([("c1", dt.date(2024, 1, 1), 2, D("5.00")), ("c1", dt.date(2024, 2, 1), 1, D("2.50")), ("c2", dt.date(2024, 1, 1), 9, D("9.00"))], MART)


@pytest.fixture
def rights(spark):
    return spark.createDataFrame([("c1", "sales", ["csv", "parquet"]), ("c2", "sales", ["csv"])], "client_id string, dataset string, formats array<string>")


def test_delivery_of_a_client(spark, mart, rights, tmp_path):
    m = delivery.run(mart, rights, CONFIG, "c1", "sales", str(tmp_path), "r1", ("csv", "parquet"))
    assert m["status"] == "PASSED" and m["row_count"] == 2 and m["control_total"] == "7.5000" and (m["period_start"], m["period_end"]) == ("2024-01-01", "2024-02-01") and m["client_id"] == "c1" and m["schema_version"] == "2"
    home = tmp_path / "c1" / "sales" / "r1"
    assert spark.read.parquet(str(home / "parquet")).count() == 2 and spark.read.json(str(home / "manifest")).first()["row_count"] == 2
    again = delivery.run(mart, rights, CONFIG, "c1", "sales", str(tmp_path), "r2", ("csv",))
    assert again["run_id"] == "r1" and not (tmp_path / "c1" / "sales" / "r2").exists()
    assert delivery.run(mart, rights, CONFIG, "c1", "sales", str(tmp_path), "r3", ("csv",), force=True)["run_id"] == "r3"


def test_deliveries_that_must_not_be(spark, mart, rights, tmp_path):
    for client, kinds in (("c9", ("csv",)), ("c2", ("parquet",))):
        with pytest.raises(gates.GateError):
            delivery.run(mart, rights, CONFIG, client, "sales", str(tmp_path), "r", kinds)
    for bad in (mart.unionByName(mart), mart.drop("n"), mart.withColumn("month", F.lit(None).cast("date"))):
        with pytest.raises(gates.GateError):
            delivery.run(bad, rights, CONFIG, "c1", "sales", str(tmp_path), "r", ("csv",))
    assert not (tmp_path / "c1").exists()


def test_all_deliveries_go_on_after_a_failure(spark, mart, rights, tmp_path):
    rights = rights.unionByName(spark.createDataFrame([("c1", "other", ["csv"])], rights.schema))
    broken = delivery.Extract("gone", ("a",), ("a",), "1")
    with pytest.raises(gates.GateError, match="c1/other"):
        delivery.run_all({"sales_mart": mart}, rights, {"sales": CONFIG, "other": broken}, str(tmp_path), "r1")
    assert (tmp_path / "c1" / "sales" / "r1").exists() and (tmp_path / "c2" / "sales" / "r1").exists()


def test_jobs_from_raw_rows_to_summaries(spark, tmp_path):
    from lodestone.plans import entities, jobs

    raw = entities.dirty_transactions(spark, "/root/testdata/sf0.001")
    counts = {r["disposition"]: r["n_rows"] for r in jobs.bronze_to_silver(raw, str(tmp_path), "1").collect()}
    assert sum(counts.values()) == raw.count() and counts["silver"] > 0 and counts["duplicate_transaction_id"] > 0
    good = files.read_current(spark, str(tmp_path / "silver"))
    jobs.silver_to_gold(good, str(tmp_path / "gold"), "1")
    fact, merchants = (files.read_current(spark, str(tmp_path / "gold" / n)) for n in ("fact_transactions", "dim_merchant"))
    rows = jobs.gold_to_consumption(fact, merchants, str(tmp_path / "marts"), "1")
    assert len(rows) == 7 and rows["transaction_status_summary"] == 3
    with pytest.raises(gates.GateError):
        jobs.silver_to_gold(good.unionByName(good), str(tmp_path / "gold"), "2")
    assert not (tmp_path / "gold" / "dim_date" / "version=2").exists()


def test_run_names_and_key_texts(spark):
    spec, _ = cdc_tables.specs()["clients"]
    assert values(spark, [("C1",)], "client_id string", cdc_tables.key_text(spec)) == [('["C1"]',)]
    assert values(spark, [(dt.datetime(2024, 1, 2, 3, 4, 5),)], "t timestamp", X.run_id(F.col("t"))) == [("run_20240102T030405Z",)]
    assert values(spark, [("true",), ("yes",)], "a string", R.strict_bool(F.col("a"))) == [(True,), (None,)]
