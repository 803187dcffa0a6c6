"""Periodic runs: stretches of words that repeat with one period, found by longest common extensions in suffix trees.

A run is a maximal stretch with a smallest period q; those of at least LEAST words and TIMES periods count. By the runs theorem each
run has a Lyndon root, under one of the two orders of the words, that is the longest Lyndon word
at its place. So each word gives two candidates (the distances to the next smaller and the next larger suffix), and
each is extended in both directions by the longest common extension of two places: the depth of the lowest
common ancestor of two leaves, forward in Ukkonen's tree of the words and backward in that of their reversal, as the minimum of the
depths on the Euler tour between them, in constant time.

Only words that can be in such a run become leaves. In a run of period q each GRAM words have a copy q words away in the same run
(GRAM = LEAST - LEAST // TIMES, the least that a run's length exceeds its period by), so stretches without a repeated gram hold no
run; grams are compared by hashes, which can only let more words through. The trees of a text take
about 1 KB a word of such stretches, in the task that has the text; texts are dealt with one at a time.

Words are runs of non-blanks, compared byte by byte. Null and empty texts: no words, no runs, collapsed text empty. Texts of
any length are taken whole. Repeated rows: a result each. Ties between runs: all are reported. Empty table: empty result. Other
columns are not read; collapse_repeats passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import put_back, set_aside, table

LEAST, TIMES, OUT_BYTES = 24, 3, 4 << 20
BLOCK = 16


class Minima:
    """Range minima: inside blocks by running minima from both ends, over whole blocks by a sparse table."""

    def __init__(self, values: np.ndarray) -> None:
        n_blocks = -(-len(values) // BLOCK)
        whole = np.full(n_blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        whole[: len(values)] = values
        rows = whole.reshape(n_blocks, BLOCK)
        self.values = whole
        self.upto = np.minimum.accumulate(rows, axis=1).ravel()
        self.since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 2 * (1 << (len(self.table) - 1)) <= n_blocks:
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo..hi], both ends included."""
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.since[lo], self.upto[hi])
        near = np.flatnonzero(first == last)
        if len(near):
            at, end = lo[near], hi[near]
            least = self.values[at]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(at + k, end)])
            out[near] = least
        far = np.flatnonzero(last - first > 1)
        if len(far):
            a, b = first[far] + 1, last[far]
            level = np.log2(b - a).astype(np.int64)
            for k in np.unique(level):
                own = level == k
                x, y = a[own], b[own] - (1 << int(k))
                out[far[own]] = np.minimum(out[far[own]], np.minimum(self.table[k][x], self.table[k][y]))
        return out


class SuffixTree:
    """Ukkonen's suffix tree of numbers above 0; a 0 is put at the end. Leaves are made in the order of their suffixes."""

    def __init__(self, numbers: Sequence[int]) -> None:
        text = [*numbers, 0]
        n, width = len(text), max(text) + 1
        start, end, link, depth, parent = [0], [0], [0], [0], [-1]
        child: dict[int, int] = {}
        leaves: list[int] = []
        node = edge = length = left = 0
        for i, c in enumerate(text):
            left += 1
            open_link = 0
            while left:
                if not length:
                    edge = i
                key = node * width + text[edge]
                v = child.get(key)
                if v is None:
                    child[key] = leaf = len(start)
                    above = node
                else:
                    span = end[v] - start[v]
                    if length >= span:
                        edge += span
                        length -= span
                        node = v
                        continue
                    at = start[v] + length
                    if text[at] == c:
                        length += 1
                        if open_link:
                            link[open_link] = node
                        break
                    child[key] = above = len(start)
                    start.append(start[v])
                    end.append(at)
                    link.append(0)
                    depth.append(left - 1)
                    parent.append(node)
                    start[v], parent[v] = at, above
                    child[above * width + text[at]] = v
                    leaf = above + 1
                    child[above * width + c] = leaf
                if open_link:
                    link[open_link] = above
                open_link = above if v is not None else 0
                leaves.append(leaf)
                start.append(i)
                end.append(n)
                link.append(0)
                depth.append(n - len(leaves) + 1)
                parent.append(above)
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self._tour(np.array(text), np.array(start), depth, parent, leaves)

    def _tour(self, text: np.ndarray, start: np.ndarray, depth: list[int], parent: list[int], leaves: list[int]) -> None:
        """Euler tour with children in the order of their edges' first numbers."""
        above = np.array(parent)
        order = np.lexsort((text[start], above))[1:]
        kids, ends = order.tolist(), np.searchsorted(above[order], np.arange(len(parent)), side="right").tolist()
        following = [0, *ends[:-1]]
        tour, at, v = [0], [0] * len(parent), 0
        while True:
            k = following[v]
            if k < ends[v]:
                following[v] = k + 1
                v = kids[k]
                at[v] = len(tour)
            elif v:
                v = parent[v]
            else:
                break
            tour.append(depth[v])
        self.place = np.array(at)[leaves]
        self.minima = Minima(np.array(tour, np.int32))

    def ranks(self) -> np.ndarray:
        """Each suffix's place among all suffixes in order, the one of the end alone included."""
        out = np.empty(len(self.place), np.int64)
        out[np.argsort(self.place)] = np.arange(len(self.place))
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension from places i and j, which differ."""
        a, b = self.place[i], self.place[j]
        return self.minima.between(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def lyndon_candidates(ranks: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the longest Lyndon word at each place in either order: up to the next smaller, and to the next larger suffix."""
    n = len(ranks)
    smaller, larger = [n] * n, [n] * n
    low: list[int] = []
    high: list[int] = []
    for i, r in enumerate(ranks):
        while low and ranks[low[-1]] > r:
            smaller[low.pop()] = i
        low.append(i)
        while high and ranks[high[-1]] < r:
            larger[high.pop()] = i
        high.append(i)
    place = np.arange(n)
    return np.concatenate([place, place]), np.concatenate([np.array(smaller) - place, np.array(larger) - place])


def all_runs(numbers: Sequence[int]) -> np.ndarray:
    """Rows (start, period, length) of all runs of two periods or more, by start and period."""
    n = len(numbers)
    if n < 2:
        return np.empty((0, 3), np.int64)
    forward, backward = SuffixTree(numbers), SuffixTree(numbers[::-1])
    i, p = lyndon_candidates(forward.ranks().tolist())
    inside = i + p <= n
    i, p = i[inside], p[inside]
    right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    more = np.flatnonzero(i + p < n)
    right[more] = forward.common(i[more], i[more] + p[more])
    more = np.flatnonzero(i > 0)
    left[more] = backward.common(n - i[more], n - i[more] - p[more])
    length = left + p + right
    found = np.stack([i - left, p, length], axis=1)[length >= 2 * p]
    return np.unique(found, axis=0)


def gram_size(least: int, times: int) -> int:
    return min(max(least, times * q) - q for q in range(1, least + 1))


def stretches(words: Sequence[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(from, to) of the stretches that can hold runs: covered by grams that recur inside them."""
    n, size = len(words), gram_size(least, times)
    if n < least:
        return []
    gram = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    have, factor = 1, 0x9E3779B97F4A7C15
    while have < size:
        step = min(have, size - have)
        gram = gram[:-step] * np.uint64(factor) + gram[step:]
        have, factor = have + step, (factor * factor + 2) % (1 << 64) | 1

    def again(values: np.ndarray) -> np.ndarray:
        ordered = np.sort(values)
        repeated = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(repeated):
            return repeated.astype(np.int64)
        spot = np.minimum(np.searchsorted(repeated, values), len(repeated) - 1)
        return np.flatnonzero(repeated[spot] == values)

    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        hits = again(gram[a : b - size + 1])
        if not len(hits):
            continue
        gaps = np.flatnonzero(np.diff(hits) > size)
        parts = [(a + int(f), a + int(t) + size) for f, t in zip(hits[np.r_[0, gaps + 1]], hits[np.r_[gaps, len(hits) - 1]], strict=True)]
        if parts == [(a, b)]:
            out.append((a, b))
        else:
            todo += [(f, t) for f, t in parts if t - f >= least]
    return sorted(out)


def find_runs(words: Sequence[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` words and `times` periods, by start and period."""
    places, numbers, known = [], [], {}
    for a, b in stretches(words, least, times):
        numbers += [known.setdefault(w, len(known) + 1) for w in words[a:b]]
        places += range(a, b)
        known[a] = len(known) + 1  # a number of its own parts this stretch from the next
        numbers.append(known[a])
        places.append(b)
    runs = all_runs(numbers)
    runs = runs[(runs[:, 2] >= least) & (runs[:, 2] >= times * runs[:, 1])] if len(runs) else runs
    return [(places[s], length, p) for s, p, length in runs.tolist()]


def collapsed(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def with_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns in keep of docs (with text), and n_words, runs (array of start, length, period), collapsed (the text without repetitions)."""
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = [*keep, "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").cast(pa.binary())
            begun, size, counts, found, texts_out = 0, 0, [], [], []
            for i in range(len(texts)):
                words = (texts[i].as_py() or b"").split()  # bytes split at the six blanks of the word rule
                runs = find_runs(words, least, times)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts_out.append(collapsed(words, runs))
                size += len(texts_out[-1]) + 64 * (len(runs) + 1)
                if size >= OUT_BYTES or i == len(texts) - 1:
                    own = [b.column(c).slice(begun, i + 1 - begun) for c in keep]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(found, shape), pa.array(texts_out, pa.string())], names=names)
                    begun, size, counts, found, texts_out = i + 1, 0, [], [], []

    read = docs.select(*keep, F.col("text").alias("_text"))
    found = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = read.select(*keep).schema.add("n_words", T.LongType()).add("runs", found).add("collapsed", T.StringType())
    return read.mapInArrow(run, schema)


def collapse_repeats(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with each text collapsed; a null text becomes empty."""
    docs, own = set_aside(docs)
    keep = tuple(c for c in docs.columns if c != "text")
    return put_back(with_runs(docs, keep, least, times).withColumnRenamed("collapsed", "text").select(*docs.columns), own)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; ties: the first, then the one of the shortest period. Ratios are told apart in texts of up to 10^8 words."""
    ranked = F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("ratio"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r.alias("run")))
    return F.array_max(ranked)["run"]


def repeated_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the texts of every tenth id, by crc32, rewritten so that they repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    x = docs.withColumn("_g", F.floor(h / 10).cast("long")).withColumn("_w", F.when(h % 10 == 0, F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")))
    x = x.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.expr("_g % _n"))).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(_w, int(_a + 1), int(_p)), int((_n - _a + _p - 1) div _p))), 1, int(_n - _a))")
    text = F.when(F.col("_a").isNotNull(), F.concat_ws(" ", F.expr("slice(_w, 1, int(_a))"), tail)).otherwise(F.col("text"))
    return x.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = with_runs(repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
