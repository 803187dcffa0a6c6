"""Window folds against the same folds in order, a row at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cdc, merge

EVENT = "k string, kafka_offset long, operation string, source_lsn long, digest string, record string"
STATE = "k string, state struct<lsn:bigint,deleted:boolean,digest:string,record:string>"


def log(rng, n_keys, n, order):
    """Events with nulls, tombstones, repeats, deletes and late positions."""
    out = []
    for off in range(n):
        k = rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"[:n_keys], "a", "a"])
        lsn = {"late": off - rng.choice([0, 0, 0, 5, 40]), "random": rng.randint(0, 30), "falling": 1000 - off if off else 2000}[order]
        digest = rng.choice(["x", "x", "y", None, "z"])
        out.append((k, off, rng.choice(["c", "u", "u", "r", "d", "t", None]), None if rng.random() < 0.05 else lsn, digest, f"{digest}{off}"))
    return out + out[:5]


def settled(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("order", ["late", "random", "falling"])
@pytest.mark.parametrize("limits", [{}, {"rounds": 1, "passes": 1}, {"rounds": 2, "passes": 2, "split": 50}])
def test_current_state(spark, order, limits):
    rng = random.Random(f"{order}{limits}")
    events = spark.createDataFrame(log(rng, 6, 500, order), EVENT).repartition(3)
    events = events.withColumn("kafka_offset", F.col("kafka_offset") * 40_000)  # chunks of 25 rows
    state = spark.createDataFrame([("a", (5, False, "x", "old")), ("b", (9, True, None, None)), ("q", (1, False, "z", "kept")), (None, (3, None, "y", "r")), ("c", (None, None, None, None))], STATE)
    for given in (None, state) if order == "late" else (state,):
        assert settled(cdc.fold_rows(events, "k", given, **limits)) == settled(cdc.fold_in_order(events, "k", given))
    assert cdc.fold_rows(events.limit(0), "k").count() == 0


def test_settled_folds_need_no_python(spark):
    events = spark.createDataFrame(log(random.Random(1), 20, 500, "late"), EVENT)
    plan = cdc.fold_rows(events, "k", passes=20)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("limits", [{"split": 20}, {"rounds": 1, "passes": 1}])
def test_freshness(spark, limits):
    rng = random.Random(7)
    rows = [(rng.choice([None, "a", "b", "c", "d", "a"]), 40_000 * i, rng.choice([None, i, i - 7, 50]), rng.choice(["x", "y", "z", None])) for i in range(400)]
    batch = spark.createDataFrame(rows, "k string, o long, s long, d string").repartition(3)
    state = spark.createDataFrame([("a", 5, "x"), ("b", None, "y"), ("e", 3, "z"), (None, 1, "x")], "k string, s long, d string")
    want = merge._upsert_in_order(merge._with_state(state, batch, "k", "s", "d", "o"), "k", "s", "d", "o")
    assert settled(merge.fresh_upsert_rows(state, batch, "k", "s", "d", "o", **limits)) == settled(want)
