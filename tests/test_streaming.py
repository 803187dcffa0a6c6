"""Streams of change events give the dispositions of the batch fold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cdc
from lodestone.plans import captured
from lodestone.streaming import changes

EVENT = "k string, kafka_offset long, operation string, source_lsn long, digest string, record string"
STATE = "k string, state struct<lsn:bigint,deleted:boolean,digest:string,record:string>"
FAR = 1 << 60


def log(rng, n):
    return [(rng.choice([None, "a", "b", "c", "a"]), off, rng.choice(["c", "u", "r", "d", "t", None]), rng.choice([None, FAR + off, FAR + off, FAR + off - 9]), rng.choice(["x", "x", "y", None]), "r") for off in range(n)]


@pytest.mark.parametrize("carried", [False, True])
def test_keyed_state(spark, tmp_path, carried):
    rows = log(random.Random(11 + carried), 300)
    state = spark.createDataFrame([("a", (FAR + 5, False, "x", "old")), ("b", (FAR + 9, True, None, None)), ("c", (None, None, None, None))], STATE) if carried else None
    for part in (rows[:140], rows[140:]):
        spark.createDataFrame(part, EVENT).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        q = changes.current_state(changes.source(spark, str(tmp_path / "in"), EVENT), "k", state)
        q = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    got = {r["kafka_offset"]: r["disposition"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = cdc.fold_rows(spark.createDataFrame(rows, EVENT), "k", state).filter("NOT is_last").collect()
    assert got == {r["kafka_offset"]: r["disposition"] for r in want} and len(got) == sum(r[2] != "t" for r in rows)


def test_keeping_up_with_bronze(spark, tmp_path):
    kind = "source_topic string, source_table string, kafka_partition int, kafka_offset long, operation string, before string, after string, source_lsn long"
    image = lambda k, v: json.dumps({"program_id": k, "client_id": "C", "program_name": v, "program_type": "LOYALTY", "currency_code": "EUR", "status": "s", "start_date": 1, "source_type": "t"})
    rng, rows = random.Random(12), []
    for off in range(80):
        op, text = rng.choice("cuurd"), image(f"K{rng.randrange(6)}", rng.choice("vwx"))
        rows.append(("t", "programs", 0, off, op, text if op == "d" else None, None if op == "d" else text, off - rng.choice([0, 0, 7])))
    root, bronze = f"file://{tmp_path}/out", f"file://{tmp_path}/bronze"
    for first in (0, 40):
        spark.createDataFrame(rows[first : first + 40], kind).coalesce(1).write.mode("append").parquet(bronze)
        # a new checkpoint folder: the second query reads the first events again, which the job knows
        q = changes.keep_up(spark, bronze, kind, root, "programs", f"file://{tmp_path}/ck{first}")
        assert q.awaitTermination(200) and q.exception() is None
    once = f"file://{tmp_path}/once"
    captured.run_table(spark, spark.createDataFrame(rows, kind), once, "programs")
    seen = [sorted(map(str, captured.current(spark, r, "programs").collect())) for r in (root, once)]
    assert seen[0] == seen[1] and seen[0]
    assert captured.current(spark, root, "programs").agg(F.max("source_lsn")).first()[0] > 40
