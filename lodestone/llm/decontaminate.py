"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The items are the indexed side; each training passage is a query, and all items with a score of at
least SHARE times their own score (that of the item as a query for itself) are retrieved. Postings
hold BM25 impacts; items lie in blocks of BLOCK, and each term has its largest impact in each block.

1. WAND: a passage whose terms' largest impacts anywhere sum up to less than the lowest threshold is skipped.
2. Block maxima: of the other passages, the blocks are skipped whose maxima over the passage's terms
   sum up to less than the lowest threshold of the block's items. Maxima of terms that are in many
   blocks are a dense matrix, those of the others a sparse one; all windows of a stretch are summed up at once.
3. Scores: of the items of the blocks that are left.

Nothing in this is approximate: what is retrieved is what scoring every item would retrieve. Each retrieved item
is then checked: of the word 3-grams of its question and of those of its answer, OVERLAP or more
must be in the passage. The answer is the last sentence, or the second half where there is one
sentence only. An item of fewer than MIN_ITEM_WORDS words must be in the passage as a phrase, whole.

Passages are windows over the whole text, of twice the words of an item's class, moved by half of that, so each item lies whole in
one passage. Classes are items of up to CLASS words, of up to twice that, and so on, with an index each: how far a
match may be scattered hangs on the item alone, not on what else is in the table. The index is sparse and built in shards of about SHARD_BYTES of item text, so what is
broadcast has a fixed bound; a text is split into words once for all shards of a pass
(SHARDS_PER_PASS). Number of items, mean length and document frequencies are those of
all items in every shard and class, and scores are exactly rounded sums, so the shards change no result.

In scripts without blanks each character is a word, and two of them count as one towards
MIN_ITEM_WORDS. Null and empty texts match nothing; null and empty items are never matched.
Repeated documents or items each get their rows. Null ids stay null. Empty tables: empty result.
Other columns, whatever their names, pass through drop_contaminated untouched and are not read by
contaminated.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool, table

K1, B, BLOCK, SHARE, OVERLAP, GRAM, MIN_ITEM_WORDS, SHARD_BYTES, SHARDS_PER_PASS = 1.2, 0.75, 4, 0.6, 0.6, 3, 5, 4 << 20, 4
#: Windows that are bounded at once; a term in more than one in COMMON blocks is in the dense matrix.
STRETCH, COMMON = 256, 8
#: Words of the items of the first class.
CLASS = 64
#: Thai, Lao, Myanmar, Khmer, kana and Han.
UNSPACED = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ecd\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_spaced, _mixed, _unspaced = re.compile(r"\w+"), re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+"), re.compile(f"[{UNSPACED}]")
_sentence = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f\uff61])\s*")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (_spaced if text.isascii() or not _unspaced.search(text) else _mixed).findall(text)


def long_enough(found: list[str]) -> bool:
    return len(found) >= MIN_ITEM_WORDS and len(found) - sum(map(bool, map(_unspaced.match, found))) / 2 >= MIN_ITEM_WORDS


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    sentences = [w for w in (words_of(s) for s in _sentence.split(text.strip())) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    found = sentences[0] if sentences else []
    return found[: (len(found) + 1) // 2], found[(len(found) + 1) // 2 :]


def grams(found: list[str], n: int) -> set[tuple[str, ...]]:
    return set(zip(*(found[k:] for k in range(n)), strict=False))


class Block(NamedTuple):
    """A block's first item, its terms in order, and impacts (terms x items)."""

    first: int
    terms: np.ndarray
    impacts: np.ndarray


Whole = tuple[int, float, dict[str, int]]


def class_of(n_words: int) -> int:
    """The most words of an item of this one's class."""
    bound = CLASS
    while bound < n_words:
        bound *= 2
    return bound


def indexes(items: list[tuple[int, str]], whole: Whole | None = None) -> list["Index"]:
    """An index for each class of a shard's items."""
    classes: dict[int, list[tuple[int, str]]] = {}
    bags = []
    for i, t in items:
        q, a = parts_of(t or "")
        if q or a:
            bags.append(q + a)
            classes.setdefault(class_of(len(bags[-1])), []).append((i, t))
    whole = whole or (len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(w for bag in bags for w in set(bag)))
    return [Index(classes[bound], whole) for bound in sorted(classes)]


class Index:
    """Blocks, maxima and thresholds of items of one class and shard; whole: number and mean length of all items and document frequencies of the shard's words among them (if None, these are all)."""

    def __init__(self, items: list[tuple[int, str]], whole: Whole | None = None):
        split = [(i, parts_of(t or "")) for i, t in items]
        split = [(i, q, a) for i, (q, a) in split if q or a]
        self.ids, self.parts = [i for i, _, _ in split], [(q, a) for _, q, a in split]
        bags = [q + a for q, a in self.parts]
        self.short = [not long_enough(bag) for bag in bags]
        counts = [Counter(bag) for bag in bags]
        if whole is None:
            whole = len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(w for c in counts for w in c)
        n_items, mean, have = whole
        self.window = 2 * class_of(max(map(len, bags), default=1))
        self.terms = {w: t for t, w in enumerate(sorted({w for c in counts for w in c}))}
        rows = []
        for c, bag in zip(counts, bags, strict=True):
            length = K1 * (1 - B + B * len(bag) / mean)
            rows.append({self.terms[w]: math.log(1 + (n_items - have[w] + 0.5) / (have[w] + 0.5)) * tf * (K1 + 1) / (tf + length) for w, tf in c.items()})
        self.impacts = rows
        self.least = np.array([SHARE * math.fsum(x.values()) for x in rows])
        self.blocks: list[Block] = []
        for lo in range(0, len(rows), BLOCK):
            some = rows[lo : lo + BLOCK]
            terms = np.array(sorted(set().union(*some)), np.int64)
            impacts = np.array([[x.get(t, 0.0) for x in some] for t in terms.tolist()])
            self.blocks.append(Block(lo, terms, impacts))
        if not rows:
            return
        n_terms = len(self.terms)
        term = np.concatenate([b.terms for b in self.blocks])
        block = np.repeat(np.arange(len(self.blocks)), [len(b.terms) for b in self.blocks])
        top = np.concatenate([b.impacts.max(axis=1) for b in self.blocks])
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, len(rows), BLOCK)) * (1 - 1e-4)
        self.top = np.zeros(n_terms)
        np.maximum.at(self.top, term, top)
        uses = np.bincount(term, minlength=n_terms)
        common = np.flatnonzero(uses * COMMON > len(self.blocks))
        self.dense_row = np.full(n_terms, -1)
        self.dense_row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(self.blocks)), np.float32)
        often = self.dense_row[term] >= 0
        self.dense[self.dense_row[term[often]], block[often]] = top[often]
        order = np.flatnonzero(~often)[np.argsort(term[~often], kind="stable")]
        self.sparse_n = np.where(self.dense_row >= 0, 0, uses)
        self.sparse_from = np.cumsum(self.sparse_n) - self.sparse_n
        self.sparse_block, self.sparse_top = block[order], top[order]

    def retrieve(self, terms: np.ndarray, blocks: np.ndarray, have: np.ndarray) -> list[tuple[int, float]]:
        """Items of the blocks with their scores, where these reach the threshold; terms are distinct, have is all False."""
        found = []
        have[terms] = True
        for b in blocks.tolist():
            block = self.blocks[b]
            here = have[block.terms]
            score = block.impacts[here].sum(axis=0)
            for k in (block.first + np.nonzero(score >= self.least[block.first : block.first + BLOCK] * (1 - 1e-9))[0]).tolist():
                exact = math.fsum(x for t, x in self.impacts[k].items() if have[t])
                if exact >= self.least[k]:
                    found.append((k, exact))
        have[terms] = False
        return found

    def _open(self, ids: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Windows lo to hi whose bounds reach a threshold: each with its terms and the blocks to score."""
        step, n_terms, n_blocks = self.window // 2, len(self.terms), len(self.blocks)
        part = ids[lo * step : (hi - 1) * step + self.window]
        at = np.flatnonzero(part < n_terms)
        # a word lies in the window that begins in its own step and in the one before
        window = np.concatenate([at // step, at // step - 1])
        inside = (window >= 0) & (window < hi - lo)
        window, term = np.divmod(np.unique(window[inside] * n_terms + np.concatenate([part[at], part[at]])[inside]), n_terms)
        wand = np.bincount(window, self.top[term], hi - lo) >= self.block_least.min()
        keep = wand[window]
        window, term = window[keep], term[keep]
        row = self.dense_row[term]
        have = np.zeros((hi - lo, len(self.dense)), np.float32)
        have[window[row >= 0], row[row >= 0]] = 1
        bound = have @ self.dense
        n = self.sparse_n[term]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.sparse_from[term], n)
        bound += np.bincount(np.repeat(window, n) * n_blocks + self.sparse_block[within], self.sparse_top[within], (hi - lo) * n_blocks).reshape(hi - lo, n_blocks)
        open_ = bound >= self.block_least
        for k in np.flatnonzero(open_.any(axis=1)).tolist():
            i, j = np.searchsorted(window, (k, k + 1))
            yield lo + k, term[i:j], np.flatnonzero(open_[k])

    def matches(self, found: list[str]) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage) of the best passage for each item; found: a text's words."""
        best: dict[int, tuple[float, float, float, int]] = {}
        if not found or not self.ids:
            return []
        none, step = len(self.terms), self.window // 2
        ids = np.fromiter(map(self.terms.get, found, repeat(none)), np.int64, len(found))
        have = np.zeros(none + 1, bool)
        n_windows = 1 + max(0, -(-(len(found) - self.window) // step))
        for lo in range(0, n_windows, STRETCH):
            for window, terms, blocks in self._open(ids, lo, min(lo + STRETCH, n_windows)):
                start = window * step
                for item, score in self.retrieve(terms, blocks, have):
                    shares = self._shares(item, found[start : start + self.window])
                    if min(shares) >= OVERLAP and score > best.get(item, (0.0,))[0]:
                        best[item] = (score, *shares, start)
        return [(self.ids[i], *rest) for i, rest in sorted(best.items())]

    def _shares(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Of the item's question and of its answer, how much of it is in the passage."""
        if self.short[item]:
            q, a = self.parts[item]
            whole = f" {' '.join(q + a)} " in f" {' '.join(passage)} "
            return float(whole), float(whole)
        return tuple(self._share(p, passage) for p in self.parts[item])

    @staticmethod
    def _share(part: list[str], passage: list[str]) -> float:
        n = min(GRAM, len(part))
        if not n:
            return 1.0
        wanted = grams(part, n)
        return len(wanted & grams(passage, n)) / len(wanted)


def _words_of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        bags = [q + a for q, a in map(parts_of, b["text"])]
        yield pd.DataFrame([(k, len(w), sorted(set(w))) for k, w in zip(b["shard"], bags, strict=True) if w], columns=["shard", "n", "words"])


def shards_of(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Indexes over shards of the items of about SHARD_BYTES each, one a class."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-max(1, size) // SHARD_BYTES)
    whole = None
    if n > 1:
        items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        bags = spool(items.filter("text IS NOT NULL").mapInPandas(_words_of_items, "shard long, n long, words array<string>"), "items")
        n_items, total = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        uses = bags.select("shard", F.explode("words").alias("word")).groupBy("shard", "word").agg(F.count("*").alias("n"))
        have = spool(uses.join(uses.groupBy("word").agg(F.sum("n").alias("have")), "word").select("shard", "word", "have"), "frequencies")
    for k in range(n):
        here = items
        if n > 1:
            here = items.filter(F.col("shard") == k)
            whole = n_items, total / max(1, n_items), {r[0]: r[1] for r in have.filter(F.col("shard") == k).select("word", "have").collect()}
        yield indexes(sorted(((r[0], r[1]) for r in here.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), whole)


def passes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The shards' indexes, those of SHARDS_PER_PASS shards at a time."""
    some: list[list[Index]] = []
    for shard in shards_of(benchmark):
        some.append(shard)
        if len(some) == SHARDS_PER_PASS:
            yield [index for shard in some for index in shard]
            some = []
    if some:
        yield [index for shard in some for index in shard]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, passage_start for each item that a document holds."""
    out = None
    for indexes in passes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, rows = [], []
                for k, t in enumerate(b.column("text")):
                    found = words_of(t.as_py() or "")
                    for index in sent.value:
                        for m in index.matches(found):
                            at.append(k)
                            rows.append(m)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)

        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long")
        out = got if out is None else out.unionByName(got)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold an item; rows are judged where they lie, so nothing is shuffled."""
    place = docs.columns.index("text")
    for indexes in passes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = []
                for t in b.column(place):
                    found = words_of(t.as_py() or "")
                    clean.append(not any(index.matches(found) for index in sent.value))
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_bm25_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_bm25_decontamination": op10_bm25_decontamination}
ORACLES: dict[str, str] = {}
