"""The pipeline over a small corpus, each stage held against a brute-force version or planted rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "The first question asks about rivers and lakes of the north. The answer names seven of them by length."


def prose(seed: int, n: int = 120) -> list[str]:
    rng = random.Random(seed)
    common = "the of and to in is it was for on that with as by at from".split()
    return [w + "." if k % 11 == 10 else w for k, w in enumerate(rng.choice(common) if rng.random() < 0.35 else f"w{rng.randrange(4000)}" for _ in range(n))]


def corpus():
    """(rows, ids of junk, of near copies, of documents with the item)."""
    texts = {k: " ".join(prose(k)) + "." for k in range(40)}
    for k in range(40, 46):
        base = prose(k - 40)
        base[60] = f"changed{k}"
        texts[k] = " ".join(base) + "."
    texts[46] = texts[7]
    for k in (50, 51):
        texts[k] = " ".join([*prose(k), ITEM, *prose(k + 100)])
    texts |= {60: None, 61: "", 62: " \n\t", 63: "too short", 64: "#$ %& <> | " * 60}
    rows = [(k, t, "en", ("a", "b", None)[k % 3], len(t or "")) for k, t in texts.items()]
    return [*rows, rows[3]], {60, 61, 62, 63, 64}, set(range(40, 47)), {50, 51}


@pytest.fixture
def home(spark, tmp_path):
    spark.createDataFrame(corpus()[0], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def jaccard_groups(rows):
    """Smallest id of each group of texts with a similarity of 0.8 or more, over all pairs."""
    sets = {r["doc_id"]: set(zip(*(r["text"].split()[j:] for j in range(5)), strict=False)) for r in rows}
    group = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[group[k]] == group[k] for k in group):
            break
    return set(group.values())


def test_stages(spark, home):
    _, junk, copies, leaks = corpus()
    docs = spark.read.parquet(f"{home}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, home)
    rows = good.collect()
    assert good.columns == docs.columns and {r["doc_id"] for r in rows} == {*range(47), 50, 51} and not junk & {r["doc_id"] for r in rows}
    assert Counter(r["doc_id"] for r in rows)[3] == 2
    alone = stages["near duplicates"](spark, good, home)
    rows = alone.collect()
    assert alone.columns == docs.columns and len(rows) == len({r["doc_id"] for r in rows})
    assert {r["doc_id"] for r in rows} == jaccard_groups(good.collect()) and not copies & {r["doc_id"] for r in rows}
    clean = stages["benchmark decontamination"](spark, alone, home)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in rows} - leaks
    mixed = stages["source mixing"](spark, clean, home)
    taken, size = Counter(), Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    for r in clean.collect():
        size[r["source"]] += len(r["text"].split())
    assert mixed.columns == docs.columns
    want, weights = {}, {"a": 5, "b": 2, None: 1}
    left, open_ = sum(size.values()), set(weights)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * size[s]}
        want |= {s: 3 * size[s] for s in full} if full else {s: level * weights[s] for s in open_}
        left, open_ = left - sum(want[s] for s in full), open_ - full if full else set()
    assert all(abs(taken[s] - want[s]) <= 120 for s in want)


def test_run_keeps_what_the_stages_keep(spark, home):
    rows = corpus_pipeline.run(spark, home).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots.get(k, ())) for k in range(24)) <= 1
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
    assert not {r["doc_id"] for r in rows} & set().union(*corpus()[1:])
    again = corpus_pipeline.run(spark, home)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, home):
    """Columns named like the operators' own come through a stage with their values."""
    names = ("n_words", "KEPT", "size", "copies", "target", "_key", "_range", "shard", "slot", "_part", "_h")
    docs = spark.read.parquet(f"{home}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, home)
        rows = got.collect()
        assert rows, name
        if name != "uniform sharding":
            assert got.columns == docs.columns, name
            assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
        else:
            assert all(r["shard_in"] == f"shard{r['doc_id']}" and r["_part"] == f"_part{r['doc_id']}" for r in rows)
