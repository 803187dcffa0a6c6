"""The job over the captured tables: whatever step a run dies at, the next one ends where a clean run ends."""

import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cdc_tables
from lodestone.plans import captured
from lodestone.sources.ledger import Ledger
from lodestone.sources.stored import shared_dir

EVENT = "source_topic string, source_table string, kafka_partition int, kafka_offset long, operation string, before string, after string, source_lsn long"
IMAGE = {
    "programs": {"program_id": "P1", "client_id": "C1", "program_name": "n", "program_type": "LOYALTY", "currency_code": "EUR", "status": "s", "start_date": 9000, "source_type": "t"},
    "transaction_events": {"event_id": "E1", "transaction_id": "T1", "event_type": "CAPTURE", "event_timestamp": 1_700_000_000_000_000, "event_status": "OK", "source_type": "t"},
}


def events(name, seed, first, last):
    """Events at offsets first to last of two partitions, a key in one of them; the same for the same seed."""
    rng, key, out = random.Random(f"{name}{seed}"), cdc_tables.specs()[name][0].key, []
    for off in range(60):
        k = rng.randrange(8)
        image = IMAGE[name] | {key: f"K{k}", "source_type": rng.choice(["t", "u", "v"])}
        image |= {"status": " "} if name == "programs" and rng.random() < 0.1 else {}
        op = rng.choice(["c", "u", "u", "r", "d", "t"])
        text = json.dumps(image) if rng.random() > 0.05 else None
        out.append((f"db.{name}", name, k % 2, off, op, text if op == "d" else None, text if op not in "dt" else None, off - rng.choice([0, 0, 9])))
    return [x for x in out if first <= x[3] <= last]


@pytest.fixture
def bronze(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, EVENT).repartition(2).write.mode("append").partitionBy("source_table", "kafka_partition").parquet(f"file://{tmp_path}/bronze")
        return spark.read.parquet(f"file://{tmp_path}/bronze")

    return write


def outcome(spark, root, name):
    """All that a reader sees of a table."""
    ledger = Ledger(spark, f"{root}/{name}")
    last = ledger.last()
    rows = captured.appended(spark, root, name) if name == "transaction_events" else captured.current(spark, root, name)
    bad = spark.read.parquet(*[f"{ledger.root}/{f}" for f in last["quarantine"]])
    totals = {}
    for n in ledger.numbers():
        for k, v in ledger.read(n)["dispositions"].items():
            totals[k] = totals.get(k, 0) + v
    return sorted(map(str, rows.collect())), sorted(map(str, bad.collect())), last["checkpoint"], totals


class Died(Exception):
    pass


STEPS = {"programs": ["read", "processed", "states", "rows", "quarantine", "counted", "committed"], "transaction_events": ["read", "processed", "states", "log", "quarantine", "counted", "committed"]}


@pytest.mark.parametrize("name", list(STEPS))
def test_a_run_that_dies_anywhere_is_run_again(spark, bronze, tmp_path, name):
    root, clean = f"file://{tmp_path}/out", f"file://{tmp_path}/clean"
    bronze(events(name, 1, 0, 29))
    captured.run_table(spark, bronze(events(name, 1, 30, 39)), clean, name)
    captured.run_table(spark, bronze(events(name, 1, 40, 59)), clean, name)
    want = outcome(spark, clean, name)
    assert want[0] and want[1] and len(want[3]) > 2
    whole = spark.read.parquet(f"file://{tmp_path}/bronze")
    captured.run_table(spark, whole.filter("kafka_offset < 40"), root, name)
    for step in STEPS[name]:

        def die(done, step=step):
            if done == step:
                raise Died(step)

        before = Ledger(spark, f"{root}/{name}").numbers()
        with pytest.raises(Died):
            captured.run_table(spark, whole, root, name, on_step=die)
        assert (Ledger(spark, f"{root}/{name}").numbers() == before) == (step != "committed")
    captured.run_table(spark, whole, root, name)
    assert outcome(spark, root, name) == want
    assert Ledger(spark, f"{root}/{name}").numbers() == [1, 2]
    assert captured.sweep(spark, root, name) > 5 and captured.sweep(spark, root, name) == 0
    assert outcome(spark, root, name) == want
    once = f"file://{tmp_path}/once"
    captured.run_table(spark, whole, once, name)
    assert outcome(spark, once, name)[0] == want[0]


def test_states_are_merged_and_of_two_runs_one_wins(spark, bronze, tmp_path):
    root = f"file://{tmp_path}/out"
    for first in (0, 20, 40):
        entry = captured.run_table(spark, bronze(events("programs", 2, first, first + 19)), root, "programs", compact=2)
    assert len(entry["states"]) == 1 and entry["number"] == 3
    whole = spark.read.parquet(f"file://{tmp_path}/bronze")
    captured.run_table(spark, whole, f"file://{tmp_path}/once", "programs")
    assert outcome(spark, root, "programs")[0] == outcome(spark, f"file://{tmp_path}/once", "programs")[0]
    late = bronze([("db.programs", "programs", 0, 900, "d", json.dumps({"program_id": "K0"}), None, 9000)])

    def other(step):
        if step == "read":
            captured.run_table(spark, late, root, "programs")

    seen = Ledger(spark, f"{root}/programs")
    with pytest.raises(FileExistsError):
        captured.run_table(spark, late, root, "programs", on_step=other)
    assert seen.last()["number"] == 4 and seen.last()["dispositions"] == {"deleted": 1}
    assert captured.run_table(spark, late, root, "programs") == seen.last()


def test_scan_is_pruned_by_the_checkpoint(spark, bronze):
    whole = bronze(events("programs", 3, 0, 59) + events("transaction_events", 3, 0, 59))
    x = captured.unread(whole.filter("source_table = 'programs'"), [["db.programs", 0, 40], ["db.programs", 1, 50]])
    assert sorted((r["kafka_partition"], r["kafka_offset"]) for r in x.collect()) == sorted((e[2], e[3]) for e in events("programs", 3, 0, 59) if e[3] > (40, 50)[e[2]])
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = captured.unread(whole.filter("source_table = 'programs'"), [["db.programs", 0, 40], ["db.programs", 1, 50]])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(kafka_offset,40)" in plan and "GreaterThan(kafka_offset,50)" in plan and "(source_table#" in plan
    more = whole.filter("source_table = 'programs'").withColumn("kafka_partition", F.col("kafka_partition") + 1)
    assert captured.unread(more, [["db.programs", 1, 59]]).filter("kafka_partition = 2").count() == captured.unread(more, [["db.programs", 1, 59]]).count() > 0


def test_all_tables_are_tried(spark, bronze, tmp_path):
    whole = bronze(events("programs", 4, 0, 59) + events("transaction_events", 4, 0, 59))
    out = captured.run_all(spark, whole, f"file://{tmp_path}/out")
    assert len(out) == 11 and out["clients"]["number"] == 0 and out["programs"]["number"] == out["transaction_events"]["number"] == 1
    assert captured.current(spark, f"file://{tmp_path}/out", "clients").count() == captured.appended(spark, f"file://{tmp_path}/out", "reward_events").count() == 0


def test_a_run_stores_each_event_twice_at_most(spark, bronze, tmp_path):
    """Judged and folded; names that don't compress show how often."""
    rng = random.Random(5)
    rows = [("db.programs", "programs", 0, n, "c", None, json.dumps(IMAGE["programs"] | {"program_id": f"K{n}", "program_name": rng.randbytes(300).hex()}), n) for n in range(2000)]
    size = lambda path: sum(p.stat().st_size for p in path.rglob("*.parquet"))
    whole, shared = bronze(rows), Path(shared_dir(spark).removeprefix("file://"))
    before = size(shared)
    captured.run_table(spark, whole, f"file://{tmp_path}/out", "programs")
    assert 0 < size(shared) - before < 2 * size(tmp_path / "bronze")
    assert captured.current(spark, f"file://{tmp_path}/out", "programs").count() == 2000


def test_states_with_columns_in_another_order_are_the_same(spark):
    spec, mode = cdc_tables.specs()["programs"]
    e = [("db.programs", "programs", 0, n, "u", None, json.dumps(IMAGE["programs"] | {"status": s}), n) for n, s in ((7, "s"), (8, "S"))]
    record = json.dumps(IMAGE["programs"] | {"start_date": "1994-08-23"})
    state = spark.createDataFrame([("P1", (3, False, "any", record))], "program_id string, state struct<lsn:bigint,deleted:boolean,digest:string,record:string>")
    done = cdc_tables.process(spark.createDataFrame(e, EVENT), spec, mode, state)
    assert {r["kafka_offset"]: r["disposition"] for r in done.filter("NOT is_last").collect()} == {7: "unchanged", 8: "updated"}
    held = cdc_tables.state_of(done, spec).first()["state"]
    assert json.loads(held["record"]) == json.loads(record) | {"status": "S"} and held["digest"] == hashlib.sha256(held["record"].encode()).hexdigest()
