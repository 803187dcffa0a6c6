"""Periodic runs, exact copies and centroid clustering against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import centroids, extendible, periodic, registry
from lodestone.llm.common import spool

WHOLE = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string"
CYCLE = " ".join(f"w{k % 5}" for k in range(60))
ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (4, CYCLE, "en", "a"), (4, CYCLE, "en", "a"), (5, CYCLE.upper(), "fr", "a"), (None, CYCLE, "de", "c"), (7, "a " * 30_000, "en", "c"), (8, "x" * 50_000, "en", "a")]


def brute_runs(words, least=24, times=3):
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x, out = np.array([code[w] for w in words], np.int64), []
    for q in range(1, len(x) // times + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            n = j - i + q
            if n >= max(least, times * q) and not any(q % d == 0 and (x[i + d : i + n] == x[i : i + n - d]).all() for d in range(1, q)):
                out.append((i, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(3)
    for _ in range(500):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6 and len(words) > 9:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange((len(words) - a) // 3 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        for least, times in ((24, 3), (2, 2), (7, 3)):
            assert periodic.find_runs(words, least, times) == brute_runs(words, least, times)


def test_common_extensions_and_order_of_suffixes():
    rng = random.Random(4)
    for _ in range(100):
        x = [1 + rng.randrange(3) for _ in range(rng.randint(2, 60))]
        tree = periodic.SuffixTree(x)
        ranks = tree.ranks()
        assert np.argsort(ranks).tolist() == sorted(range(len(x) + 1), key=lambda i: x[i:])
        i, j = (np.array([a for a in range(len(x)) for b in range(len(x)) if a != b]), np.array([b for a in range(len(x)) for b in range(len(x)) if a != b]))
        want = [next((k for k in range(len(x)) if max(a, b) + k >= len(x) or x[a + k] != x[b + k]), 0) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert tree.common(i, j).tolist() == want


def test_runs_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOC).withColumn("runs", F.lit("own"))
    rows = periodic.with_runs(odd, keep=("doc_id", "lang")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert (r["n_words"], r["runs"], r["collapsed"]) == (0, [], "")
        elif r["doc_id"] == 8:
            assert (r["n_words"], r["runs"], len(r["collapsed"])) == (1, [], 50_000)
        else:
            n, p = (30_000, 1) if r["doc_id"] == 7 else (60, 5)
            assert [tuple(x) for x in r["runs"]] == [(0, n, p)] and len(r["collapsed"].split()) == p
    out = periodic.collapse_repeats(odd)
    assert out.columns == odd.columns and {r["runs"] for r in out.collect()} == {"own"}
    assert periodic.with_runs(odd.limit(0)).count() == 0 and periodic.collapse_repeats(odd.limit(0)).count() == 0


def test_op11_whole(spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["op11_periodic_runs"](spark, WHOLE).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{WHOLE}/documents.parquet").collect()}
    assert set(got) == set(texts)
    with_some = 0
    for k, t in texts.items():
        words, h = t.encode().split(), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        with_some += bool(runs)
        keep = [True] * n
        for s, length, q in runs:
            for i in range(s + q, s + length):
                keep[i] = False
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want = (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4))
        r = got[k]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for w, keep_it in zip(words, keep, strict=True) if keep_it)).hexdigest()
    assert with_some > 50


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda t: F.pmod(F.xxhash64(t), F.lit(3)), lambda t: F.shiftleft(F.pmod(F.xxhash64(t), F.lit(50)), 58)])
def test_copies_of_odd_rows_and_colliding_keys(spark, hashed):
    rows = [*ODD, (9, "É", "fr", "a"), (10, "é", "fr", "a"), *[(100 + k, f"text {k % 40}", "en", "a") for k in range(200)]]
    docs = extendible.numbered(spark.createDataFrame(rows, DOC).withColumn("key", F.lit(1)).withColumn("chain", F.lit("own")))
    out, index = extendible.classes(docs, hashed, capacity=4, doublings=3)
    got = out.collect()
    assert sorted(r["_row"] for r in got) == sorted(r["_row"] for r in docs.collect())
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[lowered(t)].append(k)
    text_of = {r["_row"]: lowered(r["text"]) for r in docs.collect()}
    for r in got:
        t = text_of[r["_row"]]
        ids = [k for k in groups[t] if k is not None]
        assert (r["keep_id"], r["group_size"], r["text_sha256"], r["n_bytes"]) == (max(ids, default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest(), len(t.encode()))
    kept = Counter(text_of[r["_row"]] for r in got if r["kept"])
    assert kept == {t: 1 for t in groups} and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    entries = index.collect()
    assert len(entries) == len(groups) and all((e["text"] is None) == (e["chain_length"] == 1) for e in entries)
    by_key = Counter(e["key"] for e in entries)
    assert all(e["chain_length"] == by_key[e["key"]] for e in entries)
    assert all((e["key"] % (1 << 64)) >> (64 - e["depth"]) == e["bucket"] for e in entries)


def test_directory_doubles_only_where_buckets_are_overfull(spark):
    keys = spark.range(64).select(F.when(F.col("id") < 48, F.col("id")).otherwise(F.shiftleft(F.col("id"), 58)).alias("key"))
    slots, depth = extendible.directory(spool(keys, "keys"), capacity=16, doublings=4)
    rows = slots.collect()
    assert depth > 2 and sorted(r["slot"] for r in rows) == sorted({r["slot"] for r in rows})
    assert all(r["slot"] >> (depth - r["depth"]) == r["bucket"] for r in rows) and len({r["depth"] for r in rows}) > 1


def test_drop_copies(spark):
    docs = spark.createDataFrame(ODD, DOC).withColumn("kept", F.lit("own"))
    out = extendible.drop_copies(docs)
    rows = out.collect()
    assert out.columns == docs.columns and {r["kept"] for r in rows} == {"own"}
    assert sorted(lowered(r["text"]) for r in rows) == sorted({lowered(t) for _, t, *_ in ODD})
    assert extendible.drop_copies(docs.limit(0)).count() == 0


def test_no_python_runs_for_copies_and_clusters(spark):
    for name in ("op12_extendible_dedup", "op13_centroid_clustering"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(own[i]) for col in zip(*own[i], strict=True)] if own[i] else x for i, x in enumerate(c)]
    return sorted(((i is None, i or 0), *near(v)[::-1]) for i, v in kept), c


def test_clusters_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(150)]
    rows += [(200 + k, [0.5, -0.25, 0.0, 1.0]) for k in range(80)] + [(None, [0.1] * 4), (7, [0.2] * 4)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [float("inf")] * 4), (306, [-0.001] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("own"))
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for k in (6, 400):
        out, got = centroids.cluster(df, k=k, rounds=3, dim=4)
        want, c = brute_clusters(exact, k, 3, 4)
        r = out.collect()
        assert sorted(((x["vec_id"] is None, x["vec_id"] or 0), x["cluster"], x["distance"]) for x in r) == want
        assert [list(x) for x in got] == c
        total = Counter()
        for x in r:
            total[x["cluster"]] += x["distance"]
        assert all(x["cluster_inertia"] == total[x["cluster"]] and x["inertia"] == sum(total.values()) for x in r)
    out, got = centroids.cluster(df.limit(0), dim=4)
    assert out.count() == 0 and got == []
