import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, extract, graph, jaccard, lattice, mixing, quality, sharding, substrings, templates, warc
from lodestone.llm.common import shared_path, words

DOC = "doc_id long, text string, lang string, source string"
WHOLE = "/root/testdata/sf0.01"
LONG, BIG = " ".join(f"word{k}" for k in range(60)), (1 << 53) + 1
ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (4, LONG, "en", "a"), (4, LONG, "en", "a"), (5, LONG, "fr", "a"), (6, LONG + " tail", "de", "c"), (7, "one two", "en", "c"), (8, "x" * 50_000, "en", "a")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_communication_matrix_is_exact():
    parts, shards = [7, 0, 13, 30], [10, 20, 20]
    m = sharding.communication_matrix(parts, shards, 1)
    assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == shards
    draws = [sharding.hypergeometric(np.random.default_rng(k), 2_000_000_000, 2_000_000_000, 1000) for k in range(200)]
    assert abs(np.mean(draws) - 500) < 5


def test_sharding(odd, empty):
    rows = sharding.hypergeometric_shuffle(odd, 4).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(ODD) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.hypergeometric_shuffle(empty, 4).count() == 0
    clash = sharding.hypergeometric_shuffle(odd.withColumn("slot", F.col("doc_id") * 10), 4)
    assert clash.columns == [*odd.columns, "slot_in", "shard", "slot"] and all(r["slot_in"] == 10 * r["doc_id"] for r in clash.collect())


def test_large_hypergeometric_draws_are_exact():
    import fractions

    exact = lambda n: sum(math.log(fractions.Fraction(k)) for k in range(2, n + 1))
    assert math.isclose(float(sharding.log_factorial(5000)), exact(5000), rel_tol=1e-13)
    # 200 draws of half of a population of 5e10: mean and spread are those of the law
    n = 50_000_000_000
    draws = np.array([sharding.hypergeometric(np.random.default_rng(k), n // 2, n // 2, 4_000_000) for k in range(200)], float)
    assert abs(draws.mean() - 2_000_000) < 5 * 1000 / math.sqrt(200) and 800 < draws.std() < 1200


def test_equal_rows_are_shuffled_independently(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "'same text' AS text").crossJoin(spark.range(3).select())
    rows = sharding.hypergeometric_shuffle(docs, 24).collect()
    at = {}
    for r in rows:
        at.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    together = sum(len({s for s, _ in x}) == 1 for x in at.values())
    near = sum(a != b and a[0] == b[0] and abs(a[1] - b[1]) == 1 for x in at.values() for a in x for b in x) / 2
    # a uniform shuffle: 1000 / 24^2 = 1.7 triples in one shard, 3000 pairs with 2 / 3000 each side by side
    assert together <= 10 and near <= 12 and max(Counter(s for x in at.values() for s, _ in x).values()) == 125


def test_mixing(odd, empty):
    weight = lambda size: mixing.quality_weight(F.col("text"), size)
    rows = mixing.mix(odd, words(F.col("text")), weight).collect()
    assert len(rows) == len(ODD) and all(0 <= r["copies"] <= 3 for r in rows)
    total = {}
    for r in rows:
        total.setdefault((r["source"], r["target"]), []).append(r["copies"] * r["size"])
    assert math.isclose(sum(t for _, t in total), sum(r["size"] for r in rows))
    assert mixing.mix(empty, words(F.col("text")), weight).count() == 0
    clash = mixing.mix(odd.withColumn("target", F.lit("x")), words(F.col("text")), weight, keep=("target",))
    assert all(r["target_in"] == "x" and r["target"] >= 0 for r in clash.collect())


def test_mixing_of_equal_rows(spark):
    """Of rows that are equal, so many are taken as the budget says, not all or none."""
    docs = spark.createDataFrame([(1, "a b c d", "s")] * 90 + [(2, "x y", "t")] * 10, DOC.replace("lang string, ", ""))
    rows = mixing.mix(docs, words(F.col("text")), lambda size: F.lit(1.0)).collect()
    for s in ("s", "t"):
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 2


@pytest.mark.parametrize("weight", [0.05, 0.5, 1.0])
def test_key_ranges_are_even_for_all_weights(spark, weight):
    """Ranges follow the keys' order, and none holds more than about its share, whatever the weights."""
    n, share = 200_000, 5_000
    keys = spark.range(n).select((-F.log(F.rand(3)) / weight).alias("k"))
    ranged = keys.select("k", mixing.key_range(F.col("k"), n * mixing.ROWS_PER_RANGE // share).alias("r"))
    sizes = sorted((r["r"], r["count"], r["lo"], r["hi"]) for r in ranged.groupBy("r").agg(F.count("*").alias("count"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    assert max(x[1] for x in sizes) < 1.3 * share
    assert all(a[3] < b[2] for a, b in zip(sizes, sizes[1:]))


def test_quality_counts_against_brute_force():
    text = "a b c d a b c x\nline\nline\n\n# * %"
    s = quality.stats_of(text)
    found = text.split()
    grams = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    assert s[:5] == (len(found), sum(map(len, found)), 3, 1, len(inside))


def test_quality_verdicts(odd, empty):
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {4, 5, 6}
    assert quality.filter_quality(empty).count() == 0
    patterns = {(1,) * 8: 900, (-1,) * 8: 100, (1, 1, 1, 1, 0, 0, 0, -1): 5}
    share, rates = quality.fit(patterns)
    p = quality.posterior(np.array(list(patterns)) + 1, share, rates)
    assert p[0] > 0.9 and p[1] < 0.1


def test_near_duplicates(odd, empty):
    got = {(r["doc_id"], r["class_id"], r["group_id"], r["n_links"]) for r in jaccard.near_duplicates(odd).collect()}
    assert {(4, 4, 4, 3), (5, 4, 4, 3), (6, 6, 4, 3), (1, 1, 1, 0), (2, 2, 2, 0), (7, 7, 7, 0)} <= got
    assert sorted(r["doc_id"] for r in jaccard.one_of_each_group(odd).collect()) == [1, 2, 3, 4, 7, 8]
    assert jaccard.near_duplicates(empty).count() == 0


def test_links_in_a_component_of_several_blocks(spark):
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:k % 150], f"new{k}", *base[k % 150 + 1 :]]) for k in range(600)]
    got = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in texts]
    for a in range(0, 600, 37):
        n = sum(5 * len(sets[a] & s) >= 4 * len(sets[a] | s) for s in sets) - 1
        assert got[a] == (0, n)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    other = " ".join(f"else{k}" for k in range(60))
    rows = [(4, LONG, "x"), (4, LONG, "x"), (4, other, "x"), (None, LONG + " tail", "x"), (None, other, "x"), (None, "alone here", "x"), (None, None, "x"), (BIG, other + " end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = Counter((r["doc_id"], r["class_id"], r["group_id"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect())
    # LONG has 3 texts (two equal), other has 3 (two equal); the last two have nobody
    assert got == {(4, 4, 4, 2): 3, (None, None, 4, 2): 1, (None, 4, 4, 2): 1, (BIG, BIG, 4, 2): 1, (None, None, None, 0): 2}
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(4, LONG), (4, other), (None, "alone here"), (None, None)])


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[95] == got[100] == 90


def brute_removed(texts):
    seen, out = set(), []
    for t in texts:
        gone = set()
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(t[i : i + 100])
        out.append(bytes(b for k, b in enumerate(t) if k not in gone))
    return out


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 100, 900).astype(np.uint8)).decode()
    texts = ["a" * 300, "ab" * 150 + "é" * 60, None, "", base, base[100:400] + "Z" + base[300:700], base[50:149], "q" + base[700:] + base[:250], "a" * 130]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, kept in enumerate(brute_removed([(t or "").encode() for t in texts])):
        assert bytes(got[k]["kept"]) == kept and got[k]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substrings_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(6)
    a, b, c, d, e = (bytes(rng.integers(97, 123, 500).astype(np.uint8)).decode() for _ in range(5))
    rows = [(3, a), (3, a), (3, b), (7, c[:150] + a[:200]), (7, d), (None, e[:250] + e[:250]), (None, c[150:] + b[:150]), ((1 << 63) - 1, d + c[:50]), (3, None), (None, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # no text depends on the order of others with its id, but that one of the two equal rows stays whole
    kept = brute_removed([(t or "").encode() for _, t in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], bytes(r["kept"])) for r in got), key=key) == sorted(((i, k) for (i, _), k in zip(rows, kept, strict=True)), key=key)


def test_substrings_around_a_common_phrase(spark):
    """A phrase in a third of all texts: its grams are found to be common, and the result is what brute force gives."""
    rng = np.random.default_rng(12)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    phrase, passage = letters(60), letters(150)
    texts = [letters(80) + (phrase if k % 3 == 0 else passage if k % 3 == 1 else letters(60)) + letters(90) for k in range(300)] + [letters(30) + passage * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot = substrings.common_grams(docs.select(F.col("doc_id").alias("row"), F.encode("text", "UTF-8").alias("data")), 10_000)
    inside = substrings.gram_hashes(np.frombuffer(phrase.encode(), np.uint8))[: 60 - 24 + 1]
    assert set(inside.tolist()) <= set(hot.tolist())
    c = substrings.contexts([texts[0].encode()], substrings.Hot(hot))
    assert (c["anchor"] < 1 << 63).all()
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.remove_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute_removed([t.encode() for t in texts])


def test_suffix_array_is_sorted():
    text = np.frombuffer(b"banana", np.uint8) + np.uint8(1)
    code = np.append(text, 0).astype(np.uint8)
    order = substrings.suffix_array(code, 6 - np.arange(7))
    assert order.tolist() == sorted(range(7), key=lambda k: bytes(code[k:]))


def brute_marginal(word, at, w):
    """Sum over all segmentations of the marked word; a character that is no piece goes to its bytes."""
    text, n = "\u2581" + word, len(at)
    total = 0.0
    for cuts in range(1 << (len(text) - 1)):
        parts, start = [], 0
        for k in range(len(text)):
            if k == len(text) - 1 or cuts >> k & 1:
                parts.append(text[start : k + 1])
                start = k + 1
        p = 1.0
        for x in parts:
            p *= math.exp(w[at[x]]) if x in at else math.prod(math.exp(w[n + b]) for b in x.encode()) if len(x) == 1 else 0.0
        total += p
    return total


def test_lattice_sums_all_segmentations():
    rng = np.random.default_rng(4)
    pieces = ["\u2581a", "\u2581", "a", "b", "ab", "ba", "\u2581ab", "bab", "\u00e9b"]
    weights = np.log(rng.dirichlet(np.ones(len(pieces) + 256), 2))
    table = lattice.Pieces(pieces)
    model = lattice.Lattice(table, weights)
    words = ["ab", "b", "abab", "babba", "\u00e9b", "a\u00e9x", "bb" * 4] * 4
    got = model.score(words)
    for r, word in enumerate(words[:7]):
        for k in range(2):
            assert math.isclose(math.exp(got[r, k]), brute_marginal(word, table.at, weights[k]), rel_tol=1e-9)
            assert math.isclose(got[r, k], model._one(word, k, None))
    many, one = np.zeros(len(pieces) + 256), np.zeros(len(pieces) + 256)
    model.expect(words, 1, many)
    for word in words:
        model._one(word, 1, one)
    assert np.allclose(many, one) and many.sum() > len(words)


def test_pieces_are_found_by_their_hashes():
    pieces = [f"p{k}" for k in range(40_000)]
    table = lattice.Pieces(pieces)
    assert (table.find(table.hashes) == np.arange(40_000)).all()
    assert (table.find(np.array([lattice.Pieces._hash(f"q{k}") for k in range(1000)], np.uint64)) == -1).all()


def test_words_are_split_as_the_rule_says(spark):
    import pyarrow as pa

    from lodestone.llm.common import word_of

    texts = [None, "", " ", "a  B\tc\n", "\x1cx\xa0y \x0bZ\x0c\r", "\u00c9t\u00c9 \u00e9", "a" * 100]
    words, token, ends = lattice.split(pa.array(texts))
    words, start = words.to_pylist(), 0
    for t, stop in zip(texts, ends.tolist(), strict=True):
        assert [words[k] for k in token[start:stop]] == [w.translate({k: k + 32 for k in range(65, 91)}) for w in word_of.findall(t or "")]
        start = stop


def test_scores_against_counts_and_held_out(spark):
    """Base columns by brute force; the model beats the base on held-out text of a given table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in lattice.QUERIES["op2_lattice_likelihood"](spark, "/root/testdata/sf0.01").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    assert set(rows) == set(texts)
    low = {k: k + 32 for k in range(65, 91)}
    from lodestone.llm.common import word_of

    words = {k: [w.translate(low) for w in word_of.findall(t)] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    counts = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = counts.total() + ends, len(counts) + 1
    for k, ws in words.items():
        r = rows[k]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    mine = [r for r in rows.values() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in mine)
    assert sum(r["score"] for r in mine) / tokens > sum(r["base_score"] for r in mine) / tokens


def test_score_of_a_text_by_hand(spark):
    """Two training texts in one language: each token's probability from counts, pieces and the text so far."""
    docs = spark.createDataFrame([(1, "aa bb aa", "en"), (2, "aa cc", "en"), (3, "aa zz zz", "en")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in lattice.score(docs, F.col("doc_id") == 3).collect()}
    assert rows[3]["train_tokens"] == 7 and rows[3]["n_known"] == 2
    vocabulary, first = lattice.load_pieces()
    table, w = lattice.Pieces(vocabulary), first
    for _ in range(lattice.ROUNDS):
        sums = np.zeros(len(w))
        lattice.Lattice(table, w).expect(["aa", "bb", "cc"], 0, sums)
        w = np.log((sums + 0.01) / (sums + 0.01).sum())
    model = lattice.Lattice(table, w)
    d, n, v = 0.95, 7, 3  # two words once, none twice

    def p(word, count, k, before):
        lam = lattice.MEMORY * k / (k + 20)
        return (1 - lam) * (max(count - d, 0) + d * v * math.exp(model._one(word, 0, None))) / n + (lam * before / k if k else 0)

    want = math.log10(p("aa", 3, 0, 0)) + math.log10(p("zz", 0, 1, 0)) + math.log10(p("zz", 0, 2, 1)) + math.log10((1 - lattice.MEMORY * 3 / 23) * 2 / n)
    assert math.isclose(rows[3]["score"], want, rel_tol=1e-5)


def test_rows_that_repeat_often_are_told_apart(spark, monkeypatch):
    """Scores don't hang on whether repeats are numbered, and numbered ones go to several blocks."""
    docs = spark.createDataFrame([(7, "one two three", "en", "a")] * 40 + ODD, DOC)
    held_out = F.coalesce(F.col("doc_id") == 4, F.lit(False))
    rows = lambda: sorted((tuple(r) for r in lattice.score(docs, held_out).collect()), key=repr)
    plain = rows()
    monkeypatch.setattr(lattice, "REPEATS", 10)
    numbered, keys = lattice._numbered(docs)
    assert keys and numbered.select(F.pmod(F.xxhash64("doc_id", "text", *keys), F.lit(8))).filter("doc_id = 7").distinct().count() > 1
    for a, b in zip(plain, rows(), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-9) and math.isclose(a[6], b[6], abs_tol=1e-4)


def test_scores(odd, empty):
    held = F.col("doc_id") == 7
    rows = lattice.score(odd.select("doc_id", "text", "lang"), held).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}


def test_templates(spark, empty):
    rows = [(k, f"Body text number {k} is alone here\nUser {k} logged in from host h{k}\nend {k * 'z'}") for k in range(12)] + [(99, None)]
    got = {r["doc_id"]: r for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("logged in" not in got[k]["kept_text"] for k in range(12)) and got[99]["n_lines"] == 0
    assert templates.drop_recurring(empty).count() == 0


def test_templates_keep_other_lines_as_they_are(spark, odd):
    got = {(r["doc_id"], r["kept_text"]) for r in templates.drop_recurring(odd).collect()}
    # texts 4 and 5 are copies; text 6 is another with a line of 61 words
    assert got == {(r[0], r[1]) for r in ODD}
    rows = [(k, f"  alpha\tbeta {k}\n\nown {'y' * k} line\n \t\nalpha beta x{k}  \n") for k in range(10)]
    got = {r["doc_id"]: r for r in templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["kept_text"] == f"\nown {'y' * k} line\n \t\n" and got[k]["n_dropped"] == 2 for k in range(1, 10))
    long = spark.createDataFrame([(k, "\n".join(["same line here", *(f"row{'q' * j} {k}" for j in range(3000))])) for k in range(10)], "doc_id long, text string")
    assert {(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in templates.drop_recurring(long).collect()} == {(3001, 3001, "")}


def test_long_lines_stay_in_one_text(spark):
    """A line of 60 words in three texts stays in one of them, with a changed word too; short ones stay in all."""
    said = [a + b + c for a in "kmnp" for b in "aeiou" for c in "rst"]
    LONG, short, other = " ".join(said), "only five words are here", " ".join(["other" if w == said[30] else w for w in said])
    texts = [f"{LONG}\nfirst text\n{short}", f"second text\n{short}\n{LONG}", f"third text {'t' * 9}\n{other}", f"{LONG}\nfirst text\n{short}"]
    clash = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "doc_id long, text string, n_lines string")
    got = {r["doc_id"]: r for r in templates.drop_recurring(clash).collect()}
    whole = [k for k in range(4) if got[k]["n_dropped"] == 0]
    assert whole in ([0, 3], [1], [2]) and all(got[k]["n_lines_in"] == "mine" for k in range(4))
    assert all((said[29] in got[k]["kept_text"].split()) == (k in whole) for k in range(4))
    assert all(short in got[k]["kept_text"] for k in (0, 1, 3)) and got[0]["kept_text"] == got[3]["kept_text"]


def test_templates_against_sql(spark):
    import random

    import duckdb
    import pandas as pd

    rng = random.Random(3)
    pool = [" ".join(rng.choice(["alpha", "beta", "gamma", "d1", "22", "eps"]) for _ in range(rng.choice([2, 5, 9, 14]))) for _ in range(60)]
    pool += [" ".join(["server", "node", "event", *(rng.choice("abcdef") for _ in range(9))]) for _ in range(40)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for k in range(120)] + [(200, None), (201, ""), (3, rng.choice(pool))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = templates.drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", F.length("kept_text").cast("long").alias("kept_chars"), F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("documents", documents)
    key = lambda r: tuple(map(str, r))
    want = con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_chars, kept_md5 FROM ({templates.TEMPLATES_SQL})").fetchall()
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key) and 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_decontamination(spark, odd):
    item = "The first question asks about rivers and lakes of the north. The answer names seven of them by length."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    docs = odd.unionByName(spark.createDataFrame([(50, LONG + " " + item.upper() + " " + LONG, "en", "z"), (51, item[:60], "en", "z")], DOC))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(50, 1)}
    assert 50 not in {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}


def test_decontamination_is_the_same_in_one_shard_and_many(spark, monkeypatch):
    rng = np.random.default_rng(8)
    said = [[f"w{k}" for k in np.minimum(rng.zipf(1.3, rng.integers(12, 60)), 500)] for _ in range(80)]
    bench = spark.createDataFrame([(k, " ".join(w[:-6]) + ". " + " ".join(w[-6:]) + ".") for k, w in enumerate(said)], "item_id long, text string")
    partly = [(k, " ".join([*w[: len(w) // 3 * (k % 2)], *w[len(w) // 3 :], *(f"w{x}" for x in rng.integers(1, 500, 300))])) for k, w in enumerate(said)]
    docs = spark.createDataFrame(partly, "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 4000)
    monkeypatch.setattr(decontaminate, "SHARDS_PER_PASS", 2)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == one and 40 <= len(one)


def test_retrieval_against_all_scores():
    """What the pruned index retrieves in each window is what BM25 over all items gives."""
    rng = np.random.default_rng(11)
    said = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.25, rng.integers(1, 40)), 300)) for _ in range(70)]
    index = decontaminate.Index(list(enumerate(said)))
    bags = [Counter(decontaminate.words_of(x)) for x in said]
    mean, n = sum(b.total() for b in bags) / len(bags), len(bags)

    def scores(terms):
        out = []
        for b in bags:
            each = []
            for w in b:
                if w in terms:
                    have = sum(w in x for x in bags)
                    each.append(math.log(1 + (n - have + 0.5) / (have + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean)))
            out.append(math.fsum(each))
        return out

    own = [scores(set(b))[k] for k, b in enumerate(bags)]
    total = 0
    for _ in range(30):
        text = [f"w{k}" for k in np.minimum(rng.zipf(1.2, 400), 300)]
        for k in rng.integers(0, n, 3).tolist():
            at = int(rng.integers(0, 300))
            text[at:at] = decontaminate.words_of(said[k])[: int(rng.integers(1, 40))]
        step = index.window // 2
        ids = np.array([index.terms.get(w, len(index.terms)) for w in text])
        n_windows = 1 + max(0, -(-(len(text) - index.window) // step))
        have, found = np.zeros(len(index.terms) + 1, bool), {}
        for w, terms, blocks in index._open(ids, 0, n_windows):
            found[w] = {k: s for k, s in index.retrieve(terms, blocks, have)}
        for w in range(n_windows):
            want = {k: s for k, s in enumerate(scores(set(text[w * step : w * step + index.window]))) if s >= 0.6 * own[k] * (1 + 1e-12)}
            got = found.get(w, {})
            assert set(want) <= set(got) and all(math.isclose(s, want[k]) for k, s in got.items() if k in want)
            total += len(want)
    assert total > 100


def test_short_items_match_as_phrases(spark):
    bench = spark.createDataFrame([(1, "Nile river delta"), (2, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, LONG + " the nile River, DELTA " + LONG), (2, "nile delta river"), (3, LONG)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1)]


def test_large_ids_beside_nulls(spark):
    item = "The first question asks about rivers and lakes of the north. The answer names seven of them by length."
    docs = spark.createDataFrame([(None, LONG + " " + item, "en", "a"), (BIG, LONG + " " + item, "en", "a"), (BIG + 2, LONG.replace("word", "term") + ".", "en", "a")], DOC).coalesce(1)
    bench = spark.createDataFrame([(BIG, item)], "item_id long, text string")
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(None, BIG), (BIG, BIG)}
    assert ids(decontaminate.drop_contaminated(docs, bench)) == {BIG + 2}
    every = {None, BIG, BIG + 2}
    assert ids(quality.add_stats(docs)) == every and ids(quality.filter_quality(docs)) <= every
    assert ids(lattice.score(docs.select("doc_id", "text", "lang"), F.lit(False))) == every
    assert ids(mixing.mix(docs, words(F.col("text")), lambda size: F.lit(1.0))) == every and ids(sharding.hypergeometric_shuffle(docs)) == every
    # the first two are copies, so one of them goes
    assert ids(jaccard.one_of_each_group(docs)) == {BIG, BIG + 2} and ids(substrings.remove_repeats(docs)) == every and ids(templates.drop_recurring(docs)) == every
    pages = spark.createDataFrame([(None, "u", "<p>a</p>"), (BIG, "u", "<p>a</p>"), (BIG + 2, "u", None)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in extract.extract_text(pages).collect()} == every
    home = shared_path(spark, "warc-ids")
    warc.write_monolithic(warc.records_of(pages), f"{home}/a")
    warc.normalise(spark, f"{home}/a", f"{home}/b")
    got = {r["page_id"]: r for r in warc.read_records(spark, f"{home}/b", warc.index_of(spark, f"{home}/b")).collect()}
    assert set(got) == every and got[None]["refers_to"] == BIG and got[BIG]["record_type"] == "response"


def test_columns_named_like_the_operators_own(spark, odd):
    clash = odd.withColumns({"n_words": F.lit("mine"), "text_": F.lit("mine"), "kept": F.lit("mine")})
    assert all(r["n_words_in"] == "mine" for r in quality.add_stats(clash, keep=("doc_id", "n_words")).collect())
    assert quality.filter_quality(clash).columns == clash.columns


def test_decontamination_of_scripts_without_blanks(spark):
    item = "\u5730\u7403\u4e0a\u6700\u957f\u7684\u6cb3\u6d41\u662f\u54ea\u4e00\u6761\uff1f\u5c3c\u7f57\u6cb3\u662f\u6700\u957f\u7684\u6cb3\u6d41\u3002"
    bench = spark.createDataFrame([(1, item), (2, item[:6])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "\u4eca\u5929" * 50 + item + "\u660e\u5929" * 50), (2, item[:12]), (3, LONG)], "doc_id long, text string")
    # item 2 is short: six characters, three words; it is matched as a phrase
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 1), (1, 2), (2, 2)}


def test_min_cut_against_all_labellings():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = 7
        s, t = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(a, b, float(rng.random() / 2)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        cost = lambda side: sum(t[k] if side[k] else s[k] for k in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: E731, B023
        best = min(cost([bool(x >> k & 1) for k in range(n)]) for x in range(1 << n))
        assert math.isclose(cost(extract.max_flow(n, s, t, edges)), best, abs_tol=1e-9)


def test_extraction():
    w = extract.fit([])
    page = "<html><head><title>T</title><script>x<p></script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>Some <b>bold</b>\n text, which is here.<br>More.</p><div class='ad'>Buy now</div></article><div id=comments><p>Nice article, thank you very much.</p></div><footer>c</footer></body></html>"
    assert extract.extract(page, w) == "A & B\n\nSome bold text, which is here. More."
    assert extract.extract(None, w) == "" and extract.extract("", w) == ""


def test_cut_overrules_single_blocks():
    """On pages without telling elements, neighbours put right what blocks alone get wrong."""
    rng = np.random.default_rng(9)
    said = lambda n: " ".join(["good", "words", "make", "text"][k % 4] for k in range(n))
    wrong_alone = wrong_cut = differ = 0
    for _ in range(60):
        page, want = ["<div>"], []
        for _ in range(8):
            page.append(f"<a href=/x>{said(2)}</a><hr>")
            want.append(False)
        page.append("</div><div>")
        for _ in range(12):
            n = int(rng.choice([1, 2, 3, 25, 40]))
            page.append(f"<p>{said(n)}{rng.choice(['.', ''])}</p>")
            want.append(True)
        page.append("</div><div>\u00a9 2024 Example. All rights reserved</div>")
        want.append(False)
        found = extract.blocks_of("".join(page))
        side, odds = extract.label(found, extract.START)
        assert len(found) == len(want)
        differ += sum(s != (o > 0) for s, o in zip(side, odds, strict=True))
        wrong_alone += sum((o > 0) != w for o, w in zip(odds, want, strict=True))
        wrong_cut += sum(s != w for s, w in zip(side, want, strict=True))
    assert differ > 50 and wrong_cut * 3 < wrong_alone


@pytest.mark.parametrize("wrap", ["<div class='content-with-sidebar'>", "<div class='main-menu-wrap'>", "<div class='comments-open'><article>", "<div class='ad-free'>", "<div>"])
def test_misleading_names_do_not_sink_a_page(wrap):
    art = ["One long sentence of the article, which ends here and says a good deal.", "Yes.", "Another long sentence of the article, with what it has to say, ends here."]
    page = f"<nav><a href=/>Home</a> <a href=/>News</a></nav>{wrap}{''.join(f'<p>{x}</p>' for x in art)}</div><div>\u00a9 2024 Example. All rights reserved</div>"
    assert extract.extract(page, extract.fit([])) == "\n\n".join(art)


NAV = "<nav><a href=/>Home</a> <a href=/>News</a></nav>"
SAID = ("One long sentence of the recipe, which ends here and says a good deal to all who read it.", "Another long sentence of the recipe, with what it has to say, ends here and goes on for a while.")
REMARK = "Nice recipe, thank you very much, I have tried it with my family and all of them liked it."


@pytest.mark.parametrize("page", [
    "<article>{a}<div class='alert'>{b}</div></article>",
    "<article>{a}{b}<div class='notice'><p>We use cookies. Sign in to accept our privacy policy.</p></div></article>",
    "<form id=aspnetForm action=x>{nav}<main>{a}{b}</main><footer>f</footer></form>",
    "<form action=x>{nav}<div class=content>{a}{b}</div></form>",
    "<div class=widget><main>{a}{b}</main></div>",
    "<article>{a}</article><div><h3>3 Comments</h3><div>{c}</div><div>{c}</div></div>{b}",
    "<article>{a}{b}<h3>Comments</h3><div>{c}</div></article>",
    "<article>{a}{b}</article><div><p>Anna wrote:</p>{c}<a href=/r>Reply</a></div>",
    "<article>{a}{b}<div><p>Anna wrote:</p>{c}<p><a href=/r>Reply</a></p></div></article>",
    "<article>{a}{b}<a href=/r>Reply</a></article>",
    "<article>{a}{b}<form><p>Sign up for our mail. Subscribe.</p><label>Mail</label><input></form></article>",
])
def test_wrappers_notices_and_comments_without_names(page):
    part = {"nav": NAV, "a": f"<p>{SAID[0]}</p>", "b": f"<p>{SAID[1]}</p>", "c": f"<p>{REMARK}</p>"}
    text = extract.extract(NAV + page.format(**part), extract.fit([]))
    assert text.removesuffix("\n\nReply") == "\n\n".join(SAID)


def test_cut_on_the_given_pages_without_telling_elements():
    """With article, nav, footer and names taken away, the cut still finds the articles, and is right more often than its blocks' own odds."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{WHOLE}/pages.parquet")["html"].to_pylist()
    w, wrong_alone, wrong_cut, blocks, differ = extract.fit(pages), 0, 0, 0, 0
    for page in pages:
        truth = [b.structure > 0 for b in extract.blocks_of(page)]
        found = extract.blocks_of(re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", re.sub(r" class=\"[^\"]*\"", "", page or "")))
        side, odds = extract.label(found, w) if found else ([], [])
        assert len(side) == len(truth)
        blocks += len(truth)
        changed = [s != (o > 0) for s, o in zip(side, odds, strict=True)]
        differ += any(changed)
        wrong_alone += sum((o > 0) != t for o, t in zip(odds, truth, strict=True))
        wrong_cut += sum(s != t for s, t in zip(side, truth, strict=True))
    print("pages", len(pages), "changed by the cut", differ, "blocks", blocks, "wrong alone", wrong_alone, "wrong with the cut", wrong_cut)
    assert differ and wrong_cut < wrong_alone


def test_long_and_deep_pages():
    import time

    w, rng, start = extract.fit([]), np.random.default_rng(1), time.time()
    flat = "".join(f"<p>{'word ' * int(rng.integers(1, 30))}{'.' if rng.random() < 0.5 else ''}</p>" for _ in range(100_000))
    deep = "".join(f"<div>text {k}." for k in range(100_000)) + "</p></div>" * 100_000
    replies = "<div>" + "<p>word</p><a href=/>Reply</a>" * 50_000
    assert extract.extract(flat, w) and extract.extract(deep, w) and extract.extract(replies, w) is not None
    assert time.time() - start < 60


def test_extraction_of_odd_tables(spark):
    kind, said = "page_id long, url string, html string", "One long sentence of the article, which ends here."
    page, n = f"<article><p>{said}</p></article>", len(said)
    assert extract.extract_text(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, None, None), (None, "u", ""), (None, "u", page), (2, "v", page), (2, "v", page)]
    got = [(r["page_id"], r["n_chars"]) for r in extract.extract_text(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (None, 0), (None, n), (2, n), (2, n)], key=str)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c/", None), (4, "http://d/\r\nX: y", "q" * 100_000)]
    home = shared_path(spark, "warc-test")
    warc.write_monolithic(warc.records_of(spark.createDataFrame(rows, "page_id long, url string, html string")), f"{home}/a")
    warc.normalise(spark, f"{home}/a", f"{home}/b")
    index = warc.index_of(spark, f"{home}/b")
    got = {r["page_id"]: r for r in warc.read_records(spark, f"{home}/b", index).collect()}
    for k, _, html in rows:
        payload = (html or "").encode()
        assert got[k]["payload_bytes"] == len(payload) and got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")


def test_monolithic_streams_are_inflated_once():
    one = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert list(warc.inflated(z.compress(one * 5000) + z.flush())) == [one] * 5000
    with pytest.raises(ValueError):
        list(warc.inflated(zlib.compress(one[:-9], 6, 31)))


def test_unclosed_tags_take_linear_time():
    import time

    for piece in ("<a ", '<a "', "<!", "<a '\"", "<", "</a ", '<a "\' ', "<![CDATA"):
        for end in ("", ">", '">', "'>x"):
            page = piece * (1_000_000 // len(piece)) + end
            start = time.time()
            extract.blocks_of(page)
            assert time.time() - start < 4, (piece, end)


def test_scanner_against_a_pattern():
    """On random pages the scanner finds what a pattern that starts again at each < finds."""
    import random
    import re

    tag = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
    rng = random.Random(8)
    for _ in range(3000):
        page = "".join(rng.choice(["<", ">", '"', "'", "a", "b ", "/", "!", "--", "<a ", "</b>", "<!--", "-->", "<![CDATA[", "]]>", "?"]) for _ in range(rng.randint(0, 25)))
        scanner, at, got = extract.Scanner(page), 0, []
        while (m := scanner.after(at)) is not None:
            got.append((m.start, m.end, m.closes, m.name, m.attributes))
            at = m.end
        assert got == [(m.start(), m.end(), bool(m[1]), m[2] and m[2].lower(), m[3] or "") for m in tag.finditer(page)], page


def test_long_items_change_no_match_of_others(spark):
    """A passage's size hangs on the item alone: pieces scattered over 1,800 words are no match, whatever other items are there."""
    rng = np.random.default_rng(3)
    say = lambda n: [f"v{k}" for k in rng.integers(0, 4000, n).tolist()]
    items = [" ".join(say(20)) + ". " + " ".join(say(8)) for _ in range(39)]
    parts = [items[0].replace(".", "").split()[k : k + 7] for k in range(0, 28, 7)]
    scattered = [w for part in parts for w in (*say(450), *part)]
    docs = spark.createDataFrame([(1, " ".join(scattered), "en", "a"), (2, " ".join([*say(300), *items[1].split(), *say(300)]), "en", "a"), (3, " ".join(say(900)), "en", "a")], DOC)
    for more in ([], [" ".join(f"x{k}" for k in range(8000))], [" ".join(f"x{k}" for k in range(100)), " ".join(say(70))]):
        bench = spark.createDataFrame(list(enumerate([*items, *more])), "item_id long, text string")
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(2, 1)}
    long_item = " ".join(f"y{k}" for k in range(500))
    bench = spark.createDataFrame([(7, long_item), (8, items[1])], "item_id long, text string")
    held = docs.unionByName(spark.createDataFrame([(4, " ".join([*say(333), long_item, *say(50)]), "en", "a")], DOC))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(held, bench).collect()} == {(2, 8), (4, 7)}
