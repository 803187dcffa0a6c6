"""Versions over time, and offers in buckets of their own width."""

import datetime
import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import history
from lodestone.plans import rules
from lodestone.plans.gold import DATES, DAYS_OF, Star

HISTORY = "k string, name string, effective_from date, effective_to date, is_current boolean"
D = datetime.date


def merged(spark, old, changes):
    batch = spark.createDataFrame(changes, "k string, name string, since date, seq long")
    out = history.merge_changes(spark.createDataFrame(old, HISTORY), batch, "k", "since", ["name"], "seq")
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[2]))


def test_changes_close_open_or_do_nothing(spark):
    old = [("a", "x", D(2020, 1, 1), None, True), ("b", "y", D(2020, 1, 1), D(2021, 1, 1), False), ("b", "z", D(2021, 1, 1), None, True)]
    assert merged(spark, old, [("a", "x", D(2022, 1, 1), 1), (None, "q", D(2022, 1, 1), 2), ("a", "q", None, 3)]) == old
    assert merged(spark, old, [("a", "v", D(2022, 1, 1), 1), ("c", None, D(2019, 1, 1), 2)]) == [
        ("a", "x", D(2020, 1, 1), D(2022, 1, 1), False), ("a", "v", D(2022, 1, 1), None, True), *old[1:], ("c", None, D(2019, 1, 1), None, True),
    ]
    # a late change splits an interval; the last of a day counts, and replaces a version of that day
    assert merged(spark, old, [("b", "w", D(2020, 6, 1), 1), ("b", "u", D(2021, 1, 1), 2), ("b", "t", D(2021, 1, 1), 3)]) == [
        old[0], ("b", "y", D(2020, 1, 1), D(2020, 6, 1), False), ("b", "w", D(2020, 6, 1), D(2021, 1, 1), False), ("b", "t", D(2021, 1, 1), None, True),
    ]
    assert merged(spark, old, []) == old and merged(spark, [], []) == []


def test_many_batches_give_what_one_gives(spark):
    rng = random.Random(5)
    changes = [(rng.choice("abc"), rng.choice("xyz"), D(2020, 1, 1) + datetime.timedelta(days=rng.randrange(60)), n) for n in range(60)]
    once, old = merged(spark, [], changes), []
    for lo in range(0, 60, 20):
        old = merged(spark, old, changes[lo : lo + 20])
    # dropping a version that says nothing new loses its day: batches can differ only by what a later split would have restored
    for k in "abc":
        days = lambda rows, k=k: {r[2] for r in rows if r[0] == k}
        assert min(days(once)) == min(days(old))
        rows = [r for r in old if r[0] == k]
        assert all(x[3] == y[2] and x[1] != y[1] for x, y in zip(rows, rows[1:], strict=False)) and rows[-1][3] is None and rows[-1][4]


def test_as_of(spark):
    versions = spark.createDataFrame([("a", 1, D(2020, 1, 1), D(2021, 1, 1)), ("a", 2, D(2021, 1, 1), None), ("b", 3, D(2021, 6, 1), None)], "k string, s int, effective_from date, effective_to date")
    facts = spark.createDataFrame([(1, "a", D(2020, 12, 31)), (2, "a", D(2021, 1, 1)), (3, "a", D(2019, 1, 1)), (4, "b", D(2030, 1, 1)), (5, "c", D(2021, 1, 1)), (6, None, D(2021, 1, 1)), (7, "a", None)], "id int, k string, day date")
    got = {r["id"]: r["key"] for r in history.lookup_as_of(facts, "k", "day", versions, "k", "s", "key").collect()}
    assert got == {1: 1, 2: 2, 3: -1, 4: 3, 5: -1, 6: -1, 7: -1}


def test_offers_of_any_length_against_all_pairs(spark):
    rng = random.Random(6)
    day = lambda n: D(1990, 1, 1) + datetime.timedelta(days=n)
    offers = [(k, rng.randrange(3), rng.choice([None, "m1", "m2"]), day(a := rng.randrange(9000)), day(a + rng.choice([0, 1, 6, 60, 364, 10_957, -1])), "FIXED_AMOUNT", 1, 0) for k in range(150)]
    txns = [(k, rng.randrange(3), rng.choice(["m1", "m2", "m3"]), rng.choice(["APPROVED", "APPROVED", "DECLINED"]), day(rng.randrange(12_000))) for k in range(400)]
    o = spark.createDataFrame(offers, "offer_id int, program_id int, eligible_mcc string, valid_from date, valid_to date, offer_type string, offer_value int, min_amount int")
    t = spark.createDataFrame(txns, "transaction_id int, program_id int, mcc string, status string, txn_date date").withColumn("amount", F.lit(10).cast("decimal(18,2)"))
    want = {}
    for k, p, m, s, d in txns:
        hit = [x[0] for x in offers if s == "APPROVED" and x[1] == p and x[2] in (None, m) and x[3] <= d <= x[4]]
        if hit:
            want[k] = min(hit)
    assert {r["transaction_id"]: r["offer_id"] for r in rules.qualify_offers(t, o).collect()} == want and len(want) > 100
    assert rules.qualify_offers(t, o.limit(0)).count() == 0


def _each(seq):
    return [seq.apply(n) for n in range(seq.size())]


def test_transactions_dont_meet_all_offers_that_fit(spark):
    n = 3000
    o = spark.range(n).selectExpr("CAST(id AS INT) AS offer_id", "1 AS program_id", "CAST(NULL AS STRING) AS eligible_mcc", "date_add(DATE '2000-01-01', CAST(id % 30 AS INT)) AS valid_from", "DATE '2000-12-31' AS valid_to", "'FIXED_AMOUNT' AS offer_type", "1 AS offer_value", "0 AS min_amount")
    t = spark.range(n).selectExpr("id AS transaction_id", "1 AS program_id", "'m1' AS mcc", "'APPROVED' AS status", "date_add(DATE '2000-03-01', CAST(id % 20 AS INT)) AS txn_date", "CAST(10 AS DECIMAL(18,2)) AS amount")
    out = rules.qualify_offers(t, o)
    assert [tuple(r) for r in out.groupBy("offer_id").count().collect()] == [(0, n)]
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    values = store.executionMetrics(run)
    rows = [m.accumulatorId() for node in _each(store.planGraph(run).allNodes()) if "Join" in node.name() for m in _each(node.metrics()) if m.name() == "number of output rows"]
    found = [int(values.get(k).get().replace(",", "")) for k in rows if values.get(k).isDefined()]
    assert found and max(found) <= 2 * n


def test_calendar_without_entities_that_cant_widen_it(spark, tmp_path):
    """Days of rewards are days of transactions, also with repeated ids, nulls, times of day and offers of every day; so the calendar reads no offers."""
    for name in ("region", "nation", "customer", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.withColumns({"p_size": F.lit(7), "p_partkey": F.col("p_partkey") * 2}).write.parquet(str(tmp_path / "part.parquet"))
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("o_orderstatus", F.lit("F")).filter("o_orderkey % 1009 <> 0")
    late = orders.withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL '23:59:59' HOUR TO SECOND"))
    odd = orders.limit(5).withColumn("o_orderdate", F.lit(None).cast(orders.schema["o_orderdate"].dataType))
    orders.unionByName(late).unionByName(odd).write.parquet(str(tmp_path / "orders.parquet"))
    star = Star(spark, str(tmp_path))
    assert DAYS_OF and {*DAYS_OF, *DAYS_OF.values()} <= {e for e, _ in DATES}
    day = {e: star.entity(e).select(F.col(c).cast("date").alias("day")).distinct() for e, c in DATES}
    for entity, source in DAYS_OF.items():
        assert day[entity].count() > 10 and day[entity].join(day[source], "day", "left_anti").count() == 0
    got = star.dimension("date")
    ends = reduce(DataFrame.unionByName, day.values()).agg(F.min("day"), F.max("day")).first()
    assert tuple(got.agg(F.min("full_date"), F.max("full_date"), F.count("*")).first()) == (*ends, (ends[1] - ends[0]).days + 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" not in plan and "Join" not in plan
