"""Gates that read their tables few times find what single checks find, and raise."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import gates, watermarks
from lodestone.plans import dataset_gate
from lodestone.plans.gold import Star

SMALL = "/root/testdata/sf0.001"


def test_named_keys_and_orphans(spark):
    child = spark.createDataFrame([(1, "a", 5), (2, "b", -1), (2, None, None), (3, "z", 9), (3, "z", 9)], "k int, p string, q int")
    parent = spark.createDataFrame([("a",), ("b",), ("b",)], "p string")
    other = spark.createDataFrame([(5,)], "q int")
    keyed = gates.named_keys(child, {"one": ["k"], "both": ["k", "p"], "none": ["k", "p", "q"]})
    assert {r[0]: r[1] for r in gates.repeats_by_name(keyed, ["one", "both", "none", "absent"]).collect()} == {"one": 2, "both": 1, "none": 1, "absent": 0}
    got = gates.orphan_counts(child, {"p": ("p", parent, "p", None), "q": ("q", other, "q", -1)}, {"n": F.count("*")}).first()
    assert got.asDict() == {"p": 2, "q": 2, "n": 5}
    for column, table, key, exempt in (("p", parent, "p", None), ("q", other, "q", -1)):
        assert gates.orphans(child, column, table, key, exempt).count() == got[column]
    empty = gates.orphan_counts(child.limit(0), {"p": ("p", parent, "p", None)}, {"n": F.count("*")}).first()
    assert (empty["p"], empty["n"]) == (0, 0)


def test_dataset_gate_raises(spark):
    star = Star(spark, SMALL)
    found = {r["check_name"]: r["n_violations"] for r in dataset_gate.report(star).collect()}
    assert sum(n.startswith("reference ") for n in found) == len(dataset_gate.REFERENCES) == 20
    bad = tuple(n for n, v in found.items() if v)
    assert bad
    with pytest.raises(gates.GateError, match="not sound"):
        dataset_gate.require(star, bad[1:])
    dataset_gate.require(star, bad)


def test_star_gate_reads_each_fact_at_most_twice(spark):
    star = Star(spark, SMALL)
    plan = star.gate()._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "Relation" in line]
    # a fact is the only stored table with these columns
    for own in ("transaction_status#", "event_count#", "fee_amount#", "match_status#", "qualification_status#"):
        assert sum(own in line and "date_key#" in line for line in reads) <= 2, own


def test_marks_are_literals_in_the_scan(spark, tmp_path):
    spark.sql("SELECT id, timestamp'2024-01-01' + make_dt_interval(id) AS at FROM range(100)").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    marks = spark.createDataFrame([("a", "2024-03-31")], watermarks.MARKS)
    x = watermarks.after_mark(df, "at", marks, "a")
    assert x.count() == 9 and watermarks.after_mark(df, "at", marks, "b").count() == 100
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at" in plan and "Join" not in plan


def test_domain_counts_against_single_checks(spark):
    child = spark.createDataFrame([(1, "a", 5), (2, "b", None), (2, None, None), (3, "z", 9), (3, "z", 9)], "k int, p string, q int")
    parent = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,)], "p string")
    uses = [(child, [(0, 1, F.col("p")), (1, 0, F.col("q")), (2, 0, F.col("k"))]), (parent, [(0, 0, F.col("p"))]), (parent.filter("p = 'a'"), [(3, 0, F.col("p"))]), (child, [(3, 1, F.col("p"))]), (child.limit(0), [(4, 0, F.col("k"))])]
    got = {r["domain"]: r for r in gates.domain_counts(uses).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for domain, place, df, c in ((0, 0, parent, "p"), (0, 1, child, "p"), (1, 0, child, "q"), (2, 0, child, "k")):
        assert got[domain]["repeats"][place] == gates.repeated_keys(df, [c]).count()
        assert got[domain]["nulls"][place] == df.filter(F.col(c).isNull()).count()
    assert got[0]["orphans"][1] == gates.orphans(child, "p", parent, "p").count() == 2
    assert got[3]["orphans"][1] == gates.orphans(child, "p", parent.filter("p = 'a'"), "p").count() == 3


def test_dataset_gate_joins_no_parents(spark):
    """The report has no join beside those that the entities are made by, and makes each entity once, so what is shuffled doesn't hang on how large a parent is."""
    star = Star(spark, SMALL)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    entities = {*dataset_gate.KEYS, *(parent for _, _, parent, *_ in dataset_gate.REFERENCES)}
    assert joins(dataset_gate.report(star)) <= sum(joins(star.entity(e)) for e in entities)
