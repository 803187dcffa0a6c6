"""Registries that outlive runs: keys stay, and writers that meet give no key twice."""

import pytest

from lodestone.operators.keys import LastingKeys
from lodestone.plans import gold, jobs


def test_keys_stay_and_registries_are_merged(spark, tmp_path):
    lasting, seen = LastingKeys(spark, f"file://{tmp_path}/k", compact=2), {}
    for n in (5, 5, 9, 30, 31, 60):
        got = {r["name"]: r["surrogate_key"] for r in lasting.extend("d", spark.range(n).selectExpr("concat('v', 97 * id % 61) AS name", "id").unionByName(spark.createDataFrame([(None, 0)], "name string, id long")), "name").collect()}
        assert seen.items() <= got.items() and sorted(got.values()) == list(range(1, n + 1))
        new = sorted(got.keys() - seen.keys())
        assert [got[k] for k in new] == list(range(len(seen) + 1, n + 1))
        seen = got
    assert {r["name"]: r["surrogate_key"] for r in LastingKeys(spark, f"file://{tmp_path}/k").read("d", "name").collect()} == seen
    assert len(lasting._ledger("d").last()["keys"]) <= 2


def test_two_writers_at_once(spark, tmp_path):
    lasting, other = (LastingKeys(spark, f"file://{tmp_path}/k") for _ in range(2))
    lasting.extend("d", spark.createDataFrame([("a",)], "name string"), "name")
    met = []

    def meet():
        if not met:
            met.append(other.extend("d", spark.createDataFrame([("b",), ("d",)], "name string"), "name"))

    got = {r["name"]: r["surrogate_key"] for r in lasting.extend("d", spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), "name", on_write=meet).collect()}
    assert got == {"a": 1, "b": 2, "d": 3, "c": 4}
    with pytest.raises(FileExistsError):
        met.clear()
        lasting.extend("d", spark.createDataFrame([("e",)], "name string"), "name", tries=1, on_write=lambda: other.extend("d", spark.createDataFrame([("f",)], "name string"), "name"))


def test_rebuilds_keep_their_keys(spark, tmp_path):
    """A rebuild, and another over a larger copy of the tables: dimensions and facts keep every key that was given out."""
    small, root = "/root/testdata/sf0.001", f"file://{tmp_path}/gold"
    star = gold.Star(spark, small)
    allow = tuple(r["check_name"] for r in star.gate().filter("n_violations > 0").collect())
    jobs.rebuild_gold(spark, small, root, "1", allow)
    old = {n: {r[0]: r[1] for r in spark.read.parquet(f"{root}/dim_{n}/version=1").select(d.natural, f"{n}_key").collect()} for n, d in gold.DIMENSIONS.items()}
    again = gold.Star(spark, "/root/testdata/sf0.01", LastingKeys(spark, f"{root}/_keys"))
    for n in ("merchant", "offer", "card_token", "mcc"):
        new = {r[0]: r[1] for r in again.dimension(n).select(gold.DIMENSIONS[n].natural, f"{n}_key").collect()}
        both = old[n].keys() & new.keys()
        assert both and all(old[n][k] == new[k] for k in both) and len(set(new.values())) == len(new)
    tokens = {r["token_id"]: r["card_token_key"] for r in again.dimension("card_token").collect()}
    assert {r["card_token_key"] for r in again.fact("transactions").select("card_token_key").distinct().collect()} <= {*tokens.values(), -1}
