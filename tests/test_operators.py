import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.operators import cdc, checks, dedupe, gates, keys, merge
from lodestone.plans import rules
from lodestone.streaming import changes


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("value,expected", [(" a\t", "a"), ("  ", None), (None, None), ("", None)])
def test_trim_or_null(spark, value, expected):
    assert one(spark, value, "string", X.trim_or_null) == expected


def test_casts_never_fail(spark):
    assert one(spark, "N/A", "string", X.decimal_or_null) is None
    assert one(spark, "12.5", "string", X.int_or_null) is None
    assert one(spark, " 7 ", "string", X.int_or_null) == 7
    assert one(spark, "2026-13-40", "string", X.date_or_null) is None
    assert str(one(spark, "19723", "string", X.date_from_days)) == "2024-01-01"
    assert one(spark, ["", " b "], "array<string>", X.clean_array) == ["b"]


def test_hash_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string").select(X.record_hash(["x", "y"]).alias("h"))
    assert df.distinct().count() == 2


def test_verdict_and_rejections(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, " ", -1), (3, None, None)], "id int, name string, n int")
    out = checks.with_verdict(df, {"required_name": checks.required(F.col("name")), "positive_n": checks.positive(F.col("n"))})
    got = {r["id"]: (r["is_valid"], r["failing_check_name"], r["error_reason"]) for r in out.collect()}
    assert got == {1: (True, None, None), 2: (False, "required_name", "required_name; positive_n"), 3: (False, "required_name", "required_name; positive_n")}
    bad = checks.rejections(checks.split_valid(out)[1], ["id", "name"], "d", "r", "id").collect()
    assert {b["raw_record"] for b in bad} == {'{"id":2,"name":" "}', '{"id":3,"name":null}'}


def test_keep_first_and_merge(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), (None, 3, "y"), (None, 4, "z")], "k string, s int, v string")
    first, rest = dedupe.keep_first(df, ["k"], ["s"])
    assert {r["s"] for r in first.collect()} == {1, 3} and {r["s"] for r in rest.collect()} == {2, 4}
    assert {r["k"]: r["v"] for r in dedupe.merge_first_known(df, "k", "s", ["v"]).collect()} == {"a": "x", None: "y"}


def test_keys_are_stable(spark):
    old = spark.createDataFrame([("m", 1)], "name string, surrogate_key int")
    got = keys.assign_keys(spark.createDataFrame([("b",), ("m",), ("a",), (None,)], "name string"), old, "name")
    assert {r[0]: r[1] for r in got.collect()} == {"m": 1, "a": 2, "b": 3}
    df = keys.lookup(spark.createDataFrame([("a",), ("?",), (None,)], "n string"), "n", got, "name", "surrogate_key", "k", keep_null=True)
    assert {r["n"]: r["k"] for r in df.collect()} == {"a": 2, "?": -1, None: None}


def test_fresh_upsert_folds_in_order(spark):
    state = spark.createDataFrame([("a", 5, "x")], "k string, s int, d string")
    batch = spark.createDataFrame([("a", 4, "y", 0), ("a", 6, "y", 1), ("a", 6, "z", 2), ("b", None, "q", 3)], "k string, s int, d string, o int")
    got = {r["k"]: (r["dispositions"], r["s"], r["d"]) for r in merge.fresh_upsert(state, batch, "k", "s", "d", "o").collect()}
    assert got == {"a": (["stale_skipped", "updated", "upsert_conflict"], 6, "y"), "b": (["inserted"], None, "q")}


def test_immutable_append_inside_a_batch(spark):
    pub = spark.createDataFrame([("a", 1)], "k string, v int")
    batch = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 7, 2), ("b", 8, 3), ("b", 7, 4)], "k string, v int, o int")
    got = {r["o"]: r["disposition"] for r in merge.append_immutable(pub, batch, ["k"], "v", "o").collect()}
    assert got == {0: "unchanged", 1: "immutability_conflict", 2: "appended", 3: "immutability_conflict", 4: "unchanged"}


def _events(n=400, seed=3):
    r = random.Random(seed)
    return [(r.randrange(12), k, r.choice("rcud"), r.randrange(60), r.choice("xyz")) for k in range(n)]


def test_current_state_fold_matches_rows(spark):
    rows = _events()
    df = spark.createDataFrame([(*x, "{}") for x in rows], "id long, kafka_offset long, operation string, source_lsn long, digest string, record string")
    got = cdc.fold_current_state(df, "id").collect()
    state, say = {}, {}
    for key, off, op, lsn, digest in rows:
        say[off], state[key] = changes.apply_event(state.get(key), op, lsn, digest)
    assert {d["off"]: d["disposition"] for r in got for d in r["dispositions"]} == say
    for r in got:
        s = state[r["id"]]
        assert (None if s is None else s) == (None if r["state"]["lsn"] is None else (r["state"]["lsn"], r["state"]["deleted"], r["state"]["digest"]))


def test_unchanged_does_not_move_the_position(spark):
    df = spark.createDataFrame([(1, 0, "c", 5, "m", ""), (1, 1, "u", 9, "m", ""), (1, 2, "u", 7, "n", "")], "id long, kafka_offset long, operation string, source_lsn long, digest string, record string")
    assert [d["disposition"] for d in cdc.fold_current_state(df, "id").first()["dispositions"]] == ["inserted", "unchanged", "updated"]


def test_folds_hold_no_group_of_a_key(spark):
    r, far = random.Random(4), 1 << 60
    rows = [(7 if k % 3 else k % 5, k, r.choice("rcud"), far + r.randrange(60_000), r.choice("xyz")) for k in range(60_000)]
    rows += [(9, 60_000, "u", far + 5, "x"), (10, 60_001, "d", far + 9, "x")]
    df = spark.createDataFrame([(*x, f"{x[1]}") for x in rows], "id long, kafka_offset long, operation string, source_lsn long, digest string, record string")
    old = {9: (far + 5, False, "y", "o"), 11: (far, True, None, None)}
    stored = spark.createDataFrame(list(old.items()), "id long, state struct<lsn:bigint,deleted:boolean,digest:string,record:string>")
    got = cdc.fold_rows(df, "id", stored)
    state, say, log, active = {k: v[:3] for k, v in old.items()}, {}, {}, {}
    for key, off, op, lsn, digest in rows:
        say[off], state[key] = changes.apply_event(state.get(key), op, lsn, digest)
        log[off] = "duplicate_primary_key" if op != "d" and active.get(key) else "appended"
        active[key] = op != "d"
    assert {x["kafka_offset"]: x["disposition"] for x in got.filter("NOT is_last").collect()} == say
    assert {x["id"]: tuple(x["state"])[:3] for x in got.filter("is_last").collect()} == state
    assert {x["kafka_offset"]: x["disposition"] for x in cdc.fold_event_log(df, "id").collect()} == log
    for x in (got, cdc.fold_event_log(df, "id")):
        assert "collect_list" not in x._jdf.queryExecution().toString()


def test_streaming_state_goes_on_between_runs(spark, tmp_path):
    rows = _events()
    schema = "id long, kafka_offset long, operation string, source_lsn long, digest string"
    for part in (rows[:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = changes.current_state(changes.source(spark, str(tmp_path / "in"), schema), "id")
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    state, say = {}, {}
    for key, off, op, lsn, digest in rows:
        say[off], state[key] = changes.apply_event(state.get(key), op, lsn, digest)
    assert {r["kafka_offset"]: r["disposition"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == say


def test_gates(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "p int")
    report = gates.reference_report({"c": gates.orphans(child, "k", parent, "p")})
    assert report.first()["n_violations"] == 1
    with pytest.raises(gates.GateError):
        gates.require(report, "n_violations = 0", "orphans")


def test_reward_rules(spark):
    offers = spark.createDataFrame([(2, 1, None, "2024-01-01", "2024-12-31", "FIXED_AMOUNT", 3, 1), (1, 1, "X", "2024-01-01", "2024-12-31", "CASHBACK_PCT", 1, 1)], "offer_id int, program_id int, eligible_mcc string, valid_from string, valid_to string, offer_type string, offer_value int, min_amount int")
    offers = offers.withColumns({"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})
    txns = spark.createDataFrame([(1, 1, "X", "APPROVED"), (2, 1, "Y", "APPROVED"), (3, 1, "X", "DECLINED")], "transaction_id int, program_id int, mcc string, status string")
    txns = txns.withColumns({"txn_date": F.to_date(F.lit("2024-06-01")), "amount": F.lit(10).cast("decimal(18,2)")})
    assert {r["transaction_id"]: r["offer_id"] for r in rules.qualify_offers(txns, offers).collect()} == {1: 1, 2: 2}
