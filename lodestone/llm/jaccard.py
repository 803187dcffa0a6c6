"""All pairs of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Documents with equal shingle sets form a class and are compared once. Candidates share a band of
MinHash values (BANDS bands of ROWS: a pair at the threshold is missed with a probability under
1e-5); the bands tie classes into candidate components. Inside a component each pair is compared
by MinHash values, ROUND at a time: with m of n equal, the similarity's posterior is
Beta(m + 1, n - m + 1), and the pair is dropped once the probability of reaching the threshold is
under TOLERANCE. What is left is verified exactly on the shingle sets.

Components are dealt to tasks in blocks of about BLOCK classes; a component with more classes is
compared block against block in as many tasks as there are pairs of blocks, and no pair of
documents is ever a row: a task returns each class's number of links and the smallest class it
is tied to. So groups of copies and of near copies of any size neither fill a task nor a shuffle.

Words are runs of non-blanks, as they are. A text of 1 to 4 words is one shingle. Texts without a word
(and null) have no shingles: no links, a class each. Where ids are null or repeat, rows are numbered
by id (nulls last) and by a hash of their text and stored once, so that all are compared, each with a row of
its own; a class that a row without an id stands for has a null class_id. Repeated rows are members of one class.
Empty table: empty result. Other columns, whatever their names, are not read, and pass through one_of_each_group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, put_back, set_aside, slices, spool, table, word_of
from .graph import components

SHINGLE, NUM, DEN = 5, 4, 5
BANDS, ROWS, ROUND, TOLERANCE, BLOCK = 30, 5, 30, 1e-5, 256
HASHES = BANDS * ROWS


@lru_cache(1)
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, np.uint64)


class Hasher:
    """Shingle hashes of texts; keeps the hashes of words it has seen, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def shingles(self, text: str | None, n: int = SHINGLE) -> np.ndarray:
        """Sorted distinct hashes."""
        found = word_of.findall(text or "")
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        hashed = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashed.append(h)
        h = np.array(hashed, np.uint64)
        n = min(n, len(h))
        size = len(h) - n + 1
        out = np.full(size, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values."""
    a, b = _coefficients()
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, (a[:, None] * shingles[None, at : at + 4096] + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands_of(sig: np.ndarray) -> list[int]:
    """One hash for each band."""
    return [xxhash.xxh3_64_intdigest(sig[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)]


@lru_cache(1)
def least_matches() -> dict[int, int]:
    """By number of values compared: the fewest equal ones with which a pair is kept."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(ROUND, HASHES + 1, ROUND):
        for m in range(n + 1):
            density = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(density - density.max())
            if density[s >= NUM / DEN].sum() >= TOLERANCE * density.sum():
                out[n] = m
                break
    return out


def links(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs left[k], right[k]: those that reach the threshold."""
    equal = np.zeros(len(left), np.int64)
    for n, least in least_matches().items():
        equal += (sig[left, n - ROUND : n] == sig[right, n - ROUND : n]).sum(axis=1)
        keep = equal >= least
        left, right, equal = left[keep], right[keep], equal[keep]
    if not len(left):
        return left, right
    sizes = np.array([len(x) for x in sets])
    if len(left) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)])
    else:
        common = _common(sets)[left, right]
    union = sizes[left] + sizes[right] - common
    keep = DEN * common >= NUM * union
    return left[keep], right[keep]


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices."""
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    row, column = row[keep], shared[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    width = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index in each component (indexes in order of class ids)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Links inside a set of whole components, or between two blocks of one."""
    out = []
    for _, one in group.groupby("comp", sort=False):
        one = one.drop_duplicates("class_id").sort_values("class_id")
        sig = np.stack([np.frombuffer(x, np.uint32) for x in one["sig"]])
        sets = [np.frombuffer(x, np.uint64) for x in one["shingles"]]
        left, right = np.triu_indices(len(one), 1)
        block = one["block"].to_numpy()
        i, j = one["i"].iloc[0], one["j"].iloc[0]
        if i != j:
            keep = block[left] != block[right]
            left, right = left[keep], right[keep]
        left, right = links(sig, sets, left, right)
        docs, ids = one["n_docs"].to_numpy(), one["class_id"].to_numpy()
        n = np.bincount(left, weights=docs[right], minlength=len(one)) + np.bincount(right, weights=docs[left], minlength=len(one))
        found = n > 0
        root = ids[_roots(len(one), left, right)]
        whole = bool(one["whole"].iloc[0])
        out.append(pd.DataFrame({"class_id": ids[found], "n": n[found].astype(np.int64), "root": root[found], "whole": whole}))
    return pd.concat(out)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with _row, unique and in the order of ids: the ids themselves if they are unique, else numbers, stored once; and whether they are the ids."""
    most, nulls = docs.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
    if most < 2 and not nulls:
        return docs.withColumn("_row", F.col("doc_id").cast("long")), True
    order = [F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_nth"]
    x = docs.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return spool(x.drop("_nth").withColumn("_row", F.monotonically_increasing_id()), "rows"), False


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, group_id, n_links: see the module's text. group_id: the smallest id that links lead to."""
    rows, are_ids = keyed(docs.select("doc_id", "text"))
    found = links_of(rows.select(F.col("_row").alias("doc_id"), "text"))
    if are_ids:
        return found
    ids = rows.select("_row", F.col("doc_id").alias("_id"))
    for c in ("class_id", "group_id", "doc_id"):
        found = found.join(ids, F.col(c) == F.col("_row")).drop(c, "_row").withColumnRenamed("_id", c)
    return found.select("doc_id", "class_id", "group_id", "n_links")


def links_of(docs: DataFrame) -> DataFrame:
    """near_duplicates() of docs (doc_id, text) whose ids are unique and never null."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            texts = b["text"].tolist()
            for i, j in slices(texts):
                rows = []
                for d, t in zip(b["doc_id"].iloc[i:j], texts[i:j], strict=True):
                    s = hasher.shingles(t)
                    rows.append((d, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands_of(signature(s))) if len(s) else (d, None, None))
                yield pd.DataFrame(rows, columns=["doc_id", "key", "bands"])

    sketches = spool(docs.mapInPandas(sketch, "doc_id long, key binary, bands array<long>"), "sketches")
    classes = spool(sketches.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs")), "classes")
    reps = sketches.join(classes.select("class_id", "key"), [sketches["key"] == classes["key"], sketches["doc_id"] == classes["class_id"]], "left_semi")
    banded = reps.select(F.explode("bands").alias("band"), "doc_id")
    # What is joined by band and by component is stored, so that one with very many classes can be split.
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").select("band", "first")
    banded, shared = spool(banded, "banded"), spool(shared, "bands")
    candidates = components(banded.join(shared, "band").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))

    candidates = spool(candidates, "candidates")
    sizes = spool(candidates.groupBy("comp").agg(F.count("*").alias("size")), "sizes")
    placed = candidates.join(sizes, "comp").join(classes.withColumnRenamed("class_id", "node"), "node")
    placed = spool(placed.select(F.col("node").alias("doc_id"), "comp", "size", "n_docs", "key"), "placed")
    discard(banded, shared, candidates, sizes)
    tasks = max(8, placed.count() // BLOCK)

    def payload(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            texts = b["text"].tolist()
            for i, j in slices(texts):
                part = b.iloc[i:j]
                sets = [hasher.shingles(t) for t in texts[i:j]]
                right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, part["key"], strict=True)]
                part = part.assign(sig=[signature(s).tobytes() for s in sets], shingles=[s.tobytes() for s in sets])[right]
                yield part.drop(columns=["text", "key"])

    full = docs.join(placed.hint("merge"), "doc_id").mapInPandas(payload, "doc_id long, comp long, size long, n_docs long, sig binary, shingles binary")
    full = full.withColumnRenamed("doc_id", "class_id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    full = full.withColumn("whole", F.col("blocks") == 1).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.expr("CASE WHEN whole THEN array(0) ELSE sequence(0, blocks - 1) END"))
    full = full.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    full = full.withColumn("task", F.when(F.col("whole"), F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.col("comp")))
    found = full.select("whole", "task", "i", "j", "comp", "block", "class_id", "n_docs", "sig", "shingles").groupBy("whole", "task", "i", "j")
    found = spool(found.applyInPandas(_compare, "class_id long, n long, root long, whole boolean"), "links")

    tied = components(found.filter(~F.col("whole")).select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    groups = found.groupBy("class_id").agg(F.sum("n").alias("n"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root"))
    groups = groups.join(tied.withColumnRenamed("node", "class_id"), "class_id", "left").select("class_id", "n", F.coalesce("comp", "root").alias("root"))
    by_class = classes.join(groups, "class_id", "left")
    out = sketches.select("doc_id", "key").join(by_class, "key", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("root", "class_id", "doc_id").alias("group_id"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("n_docs", F.lit(1)) - 1).cast("long").alias("n_links"),
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The first row of each group, by id: so of repeated rows one stays, and of different texts with one id each that is no near copy of another."""
    docs, own = set_aside(docs)
    rows, _ = keyed(docs)
    found = links_of(rows.select(F.col("_row").alias("doc_id"), "text"))
    kept = found.filter("doc_id = group_id").select(F.col("doc_id").alias("_row"))
    return put_back(rows.join(kept, "_row", "left_semi").select(*docs.columns), own)


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
ORACLES: dict[str, str] = {}
