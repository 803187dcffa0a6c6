"""Language-model scores from a subword lattice.

A text's lattice has, for each word, an arc for each piece of an existing vocabulary that matches, and beside these
ways through the word two arcs over the whole of it: one for words seen in training, one for words that
this text has had already. A forward recursion in log space sums over all segmentations; as every path passes
each word's end, the text's marginal is the product of its words' marginals, and each distinct
word's ways through the pieces are summed once. The vocabulary's own scores (ranks) give the pieces' first
weights; ROUNDS of expectation-maximisation over all distinct training words of a language replace them.
Characters that no piece covers fall back to byte pieces, so that every word has a path.

A word's probability in a language is its training count, less a discount, over the language's
tokens; the discounted mass goes to the pieces. (Pieces drawn independently score held-out text worse than
counted words do.) After k words of a text, MEMORY * k / (k + 20) of the probability goes to these k words.
A text's probability is the sum over languages of the language's share times the product over its words and its
end. Languages are those of the training documents' lang column, the largest MAX_LANGS - 1
of them, with all others pooled; the text's own lang is not used in scoring it.

Counts cover all training documents: words whose crc32(doc_id) mod 5 is not 1. Distinct words
and their counts never leave the executors; documents are gathered and scored in blocks of about BLOCK_BYTES, each joined with
the rates of its own distinct words. The driver sees one number for each piece and language.

Null text: empty, which is one end token. Null ids are no held-out ones, and stay null. Repeated rows score
alike and count as often as they come; where an id has over REPEATS rows, all are numbered and stored once, so that
no block gathers them. Empty table, or one without
training documents: the lattice's first weights. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, n_tasks, spool, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS, MAX_LANGS, BLOCK_BYTES, LONG_WORD, MEMORY, STRETCH, REPEATS = 3, 8, 24 << 20, 40, 0.1, 500_000, 100
MARK, LOG10 = "▁", math.log(10)


def load_pieces(path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Pieces that lower-cased words can have, then the 256 bytes; log weights from the scores' order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        if plain and MARK not in p[1:] and p != "" and p == p.encode().lower().decode():
            found.append((-model.get_score(i), p))
    found.sort()
    weights = np.array([1 / (rank + 10.0) for rank in range(len(found))] + [1e-5] * 256)
    return [p for _, p in found], np.log(weights / weights.sum())


class Pieces:
    """The vocabulary, with a table from hashes of strings to piece numbers."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.at = pieces, {p: i for i, p in enumerate(pieces)}
        self.longest, self.bytes_from = max(map(len, pieces), default=1), len(pieces)
        hashes = self.hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.tables, left = [], np.arange(len(pieces))
        for bits in (18, 16, 14, 14, *[12] * 30):
            slot = (hashes[left] >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            ids = np.full(1 << bits, -1, np.int32)
            ids[slot[first]] = left[first]
            self.tables.append((np.uint64(64 - bits), ids))
            left = np.delete(left, first)
            if not len(left):
                break
            hashes = hashes * MIX
        if len(left):
            raise ValueError(f"pieces with equal hashes: {[pieces[k] for k in left]}")

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = ((h ^ ord(c)) * int(STEP)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        x = h
        for shift, ids in self.tables:
            found = ids[(x >> shift).astype(np.int64)]
            hit = (found >= 0) & (self.hashes[found] == h)
            out[hit] = found[hit]
            x = x * MIX
        return out


STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(2)
def pieces_of(vocabulary: tuple[str, ...]) -> Pieces:
    """Made once in a worker."""
    return Pieces(list(vocabulary))


class Lattice:
    """Forward and backward sums over all segmentations of words, under weights by language (languages x (pieces and bytes), log)."""

    def __init__(self, pieces: Pieces, weights: np.ndarray):
        self.pieces, self.w = pieces, np.atleast_2d(weights)

    @lru_cache(100_000)  # noqa: B019
    def _bytes(self, char: str) -> np.ndarray:
        """Byte pieces of a character that is no piece."""
        return np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) + self.pieces.bytes_from

    def _arcs(self, words: list[str], size: int) -> list[tuple[int, int, np.ndarray, np.ndarray, list | None]]:
        """(from, to, rows, piece numbers, or byte pieces of each row) of words of one size, behind the mark."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)
        codes = np.concatenate([np.full((len(words), 1), ord(MARK), np.uint32), codes], axis=1).T.astype(np.uint64)
        out = []
        for i in range(size + 1):
            h = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(size + 1, i + self.pieces.longest) + 1):
                h = (h ^ codes[j - 1]) * STEP
                h ^= h >> np.uint64(29)
                ids = self.pieces.find(h)
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    out.append((i, j, hit, ids[hit], None))
                if j == i + 1 and len(hit) < len(words):
                    miss = np.flatnonzero(ids < 0)
                    out.append((i, j, miss, None, [self._bytes(chr(c)) for c in codes[i][miss].tolist()]))
        return out

    def _weights(self, k: int, arc: tuple) -> np.ndarray:
        return self.w[k][arc[3]] if arc[4] is None else np.array([self.w[k][b].sum() for b in arc[4]])

    def score(self, words: list[str], languages: list[int] | None = None) -> np.ndarray:
        """Natural log marginals, words x languages."""
        languages = list(range(len(self.w))) if languages is None else languages
        out = np.empty((len(words), len(languages)))
        for size, rows in self._by_size(words):
            some = [words[r] for r in rows]
            if size > LONG_WORD:
                out[rows] = [[self._one(x, k, None) for k in languages] for x in some]
                continue
            arcs = sorted(self._arcs(some, size), key=lambda a: a[1])
            for c, k in enumerate(languages):
                out[rows, c] = self._forward(arcs, [self._weights(k, a) for a in arcs], len(some), size + 1)[-1]
        return out

    def expect(self, words: list[str], k: int, sums: np.ndarray) -> None:
        """Adds the expected piece counts of words, each once, under language k's weights."""
        for size, rows in self._by_size(words):
            some = [words[r] for r in rows]
            if size > LONG_WORD:
                for x in some:
                    self._one(x, k, sums)
                continue
            m = size + 1
            arcs = sorted(self._arcs(some, size), key=lambda a: a[1])
            weights = [self._weights(k, a) for a in arcs]
            alpha = self._forward(arcs, weights, len(some), m)
            beta = np.full((m + 1, len(some)), -np.inf)
            beta[m] = 0
            for n in sorted(range(len(arcs)), key=lambda n: -arcs[n][0]):
                (i, j, hit, ids, spelled), w = arcs[n], weights[n]
                onward = beta[j, hit] + w
                beta[i, hit] = np.logaddexp(beta[i, hit], onward)
                share = np.exp(alpha[i, hit] + onward - alpha[m, hit])
                if spelled is None:
                    sums += np.bincount(ids, weights=share, minlength=len(sums))
                else:
                    for b, x in zip(spelled, share, strict=True):
                        np.add.at(sums, b, x)

    @staticmethod
    def _by_size(words: list[str]) -> Iterator[tuple[int, list[int]]]:
        by_size: dict[int, list[int]] = {}
        for k, x in enumerate(words):
            by_size.setdefault(len(x), []).append(k)
        for size, rows in by_size.items():
            for lo in range(0, len(rows), 20_000):
                yield size, rows[lo : lo + 20_000]

    @staticmethod
    def _forward(arcs: list[tuple], weights: list[np.ndarray], n: int, m: int) -> np.ndarray:
        alpha = np.full((m + 1, n), -np.inf)
        alpha[0] = 0
        for (i, j, hit, _, _), w in zip(arcs, weights, strict=True):
            alpha[j, hit] = np.logaddexp(alpha[j, hit], alpha[i, hit] + w)
        return alpha

    def _one(self, word: str, k: int, sums: np.ndarray | None) -> float:
        """The marginal of one word of any length; adds its expected piece counts to sums."""
        text, w, at = MARK + word, self.w[k], self.pieces.at
        alpha, arcs = [0.0], []
        for j in range(1, len(text) + 1):
            ways = []
            for i in range(max(0, j - self.pieces.longest), j):
                p = at.get(text[i:j])
                if p is not None or j - i == 1:
                    weight = float(w[p]) if p is not None else float(w[self._bytes(text[i])].sum())
                    ways.append(alpha[i] + weight)
                    arcs.append((i, j, p, weight))
            top = max(ways)
            alpha.append(top + math.log(sum(math.exp(x - top) for x in ways)))
        if sums is not None:
            beta = [-math.inf] * len(text) + [0.0]
            for i, j, p, weight in sorted(arcs, key=lambda a: -a[0]):
                x = beta[j] + weight
                beta[i] = x if beta[i] == -math.inf else max(x, beta[i]) + math.log1p(math.exp(-abs(x - beta[i])))
                share = math.exp(alpha[i] + x - alpha[-1])
                np.add.at(sums, [p] if p is not None else self._bytes(text[i]), share)
        return alpha[-1]


def split(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words with A-Z in lower case, each token's word, where each text's tokens end)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, sizes = parts.values, np.diff(parts.offsets.to_numpy())
    keep = pc.greater(pc.binary_length(found), 0)
    if pc.all(keep).as_py() is False:
        owner = np.repeat(np.arange(len(sizes)), sizes)[keep.to_numpy(zero_copy_only=False)]
        found, sizes = found.filter(keep), np.bincount(owner, minlength=len(sizes))
    coded = found.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), sizes.cumsum()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of rows or more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def gather(dealt: DataFrame, langs: int) -> DataFrame:
    """(block, word, c0, ...): the distinct words of each block of dealt (text, block, k), counted by language k; k = langs is not counted."""

    def run(part: pa.Table) -> pa.Table:
        words, token, ends = split(part["text"])
        k = np.repeat(part["k"].to_numpy(), np.diff(ends, prepend=0))
        counts = np.bincount(k * len(words) + token, minlength=(langs + 1) * len(words)).reshape(langs + 1, len(words))
        columns = {"block": pa.array(np.full(len(words), part["block"][0].as_py(), np.int32)), "word": words}
        return pa.table(columns | {f"c{n}": pa.array(counts[n]) for n in range(langs)})

    return dealt.groupBy("block").applyInArrow(run, "block int, word string, " + ", ".join(f"c{n} long" for n in range(langs)))


def train(asked: DataFrame, ends: list[int], vocabulary: list[str], first: np.ndarray) -> tuple[DataFrame, dict]:
    """(word, count, logs: log10 by language as float32 bytes) of every word that was asked for, and the model's totals; ends: training documents by language."""
    spark, langs = asked.sparkSession, len(ends)
    names = [f"c{k}" for k in range(langs)]
    words = spool(asked.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]), "words")
    any_count = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    sums = [F.sum(c).alias(f"n{k}") for k, c in enumerate(names)]
    for k, c in enumerate(names):
        sums += [F.count_if(F.col(c) > 0).alias(f"v{k}"), F.count_if(F.col(c) == 1).alias(f"one{k}"), F.count_if(F.col(c) == 2).alias(f"two{k}")]
    totals = {k: int(v or 0) for k, v in words.agg(F.count_if(any_count > 0).alias("v"), *sums).first().asDict().items()}
    n = [totals[f"n{k}"] + ends[k] for k in range(langs)]
    discount = [min(0.95, max(0.05, totals[f"one{k}"] / (totals[f"one{k}"] + 2 * totals[f"two{k}"]))) if totals[f"one{k}"] else 0.5 for k in range(langs)]
    model = {"tokens": sum(n), "types": totals["v"] + (sum(ends) > 0), "ends": sum(ends), "n": n, "end": ends}

    weights = np.tile(first, (langs, 1))
    for _ in range(ROUNDS if totals["v"] else 0):
        sent = spark.sparkContext.broadcast((tuple(vocabulary), weights))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces, weights = sent.value
            lattice, sums = Lattice(pieces_of(pieces), weights), np.zeros(weights.shape)
            for b in _gathered(batches):
                words = b["word"].to_pylist()
                for k, c in enumerate(names):
                    lattice.expect([words[r] for r in np.flatnonzero(b[c].to_numpy() > 0).tolist()], k, sums[k])
            k, at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(sums[k, at])], names=["k", "piece", "s"])

        got = words.filter(any_count > 0).select("word", *names).mapInArrow(expect, "k long, piece long, s double").groupBy("k", "piece").agg(F.sum("s"))
        new = np.full(weights.shape, 0.01)
        for k, piece, x in got.collect():
            new[k, piece] += x
        weights = np.log(new / new.sum(axis=1, keepdims=True))

    sent = spark.sparkContext.broadcast((tuple(vocabulary), weights))
    v = [totals[f"v{k}"] for k in range(langs)]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weights = sent.value
        lattice = Lattice(pieces_of(pieces), weights)
        for b in _gathered(batches):
            sub = lattice.score(b["word"].to_pylist()) / LOG10
            count = np.stack([b[c].to_numpy() for c in names], axis=1)
            logs = np.empty(sub.shape, np.float32)
            for k in range(langs):
                if v[k]:
                    own, rest = np.maximum(count[:, k] - discount[k], 0) / n[k], math.log10(discount[k] * v[k] / n[k]) + sub[:, k]
                    logs[:, k] = np.where(own > 0, np.log10(own + np.power(10.0, np.maximum(rest, -300)), where=own > 0, out=np.zeros(len(own))), rest)
                else:
                    logs[:, k] = sub[:, k]
            yield pa.RecordBatch.from_arrays([b["word"].combine_chunks(), pa.array(count.sum(axis=1)), pa.array([r.tobytes() for r in logs], pa.binary())], names=["word", "count", "logs"])

    rates = spool(words.mapInArrow(rate, "word string, count long, logs binary"), "rates")
    discard(words)
    return rates, model


def said_before(text: np.ndarray, token: np.ndarray) -> np.ndarray:
    """How often each token's word came earlier in its text; texts are numbered in order."""
    order = np.argsort(text * (int(token.max(initial=0)) + 1) + token, kind="stable")
    t, x = token[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1])
    place = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def sums_of(token: np.ndarray, ends: np.ndarray, logs: np.ndarray, p: np.ndarray, each: np.ndarray) -> np.ndarray:
    """(languages + 1) sums of each text's tokens: log10 probabilities by language, and of each (a value a word). logs, p: log10 and plain probability, words x languages."""
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(ends), logs.shape[1] + 1))
    lo = 0
    while lo < len(ends):
        first = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + STRETCH, side="right")))
        t = token[first : int(ends[hi - 1])]
        text = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        k = np.arange(len(t)) - np.repeat(ends[lo:hi] - sizes[lo:hi] - first, sizes[lo:hi])
        lam = MEMORY * k / (k + 20)
        # words said before can come from memory; the others stay in log space, where nothing is lost
        again = said_before(text, t)
        seen = np.flatnonzero(again)
        got = np.empty((len(t), logs.shape[1] + 1))
        got[:, :-1] = logs[t] + np.log10(1 - lam)[:, None]
        got[seen, :-1] = np.log10((1 - lam[seen])[:, None] * p[t[seen]] + (lam[seen] * again[seen] / k[seen])[:, None])
        got[:, -1] = each[t]
        for c in range(got.shape[1]):
            out[lo:hi, c] = np.bincount(text, weights=got[:, c], minlength=hi - lo)
        lo = hi
    return out


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs, and the columns that tell rows with equal ids and texts apart: none while no id has over REPEATS rows, else a number stored with the rows."""
    most = docs.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return (docs, []) if most <= REPEATS else (spool(docs.withColumn("_nth", F.monotonically_increasing_id()), "numbered"), ["_nth"])


def score(docs: DataFrame, held_out, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; docs: doc_id, text, lang."""
    spark = docs.sparkSession
    by_lang = docs.groupBy("lang").agg(F.count_if(~held_out).alias("n"), F.sum(F.when(~held_out, F.octet_length("text"))).alias("b"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"))
    by_lang = spool(by_lang, "languages")
    top = by_lang.filter("n > 0").orderBy(F.col("b").desc_nulls_last(), F.col("lang").asc_nulls_last()).limit(MAX_LANGS - 1).collect()
    rest, size = by_lang.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ends = [r["n"] for r in top]
    if rest > sum(ends) or not ends:
        ends.append(rest - sum(ends))
    langs = len(ends)
    at = F.lit(langs - 1)
    for k, r in enumerate(top):
        at = F.when(F.col("lang").eqNullSafe(F.lit(r["lang"])), k).otherwise(at)
    blocks = max(2 * n_tasks(spark), size // BLOCK_BYTES)
    docs, numbers = _numbered(docs.withColumn("_held", held_out))
    block = F.pmod(F.xxhash64("doc_id", "text", *numbers), F.lit(blocks)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_held").alias("held_out"), F.when(F.col("_held"), langs).otherwise(at).cast("int").alias("k"), block.alias("block"))
    asked = spool(gather(dealt.select("text", "k", "block"), langs), "asked")
    rates, model = train(asked, ends, *load_pieces(path))
    known = asked.select("block", "word").join(rates, "word")
    n = model["tokens"]
    shift = math.log10(n + 0.5 * (model["types"] + 1))
    base_end = math.log10(model["ends"] + 0.5) - shift
    used = [k for k in range(langs) if model["end"][k]] or [0]
    share = np.array([math.log10(model["end"][k] / model["ends"]) if model["ends"] else 0.0 for k in used])
    end = np.array([math.log10(model["end"][k] / model["n"][k]) if model["ends"] else 0.0 for k in used])

    def rate(part: pa.Table, rates: pa.Table) -> pa.Table:
        words, token, stops = split(part["text"])
        rates = rates.combine_chunks()
        at = pc.index_in(words, value_set=rates["word"].combine_chunks() if len(rates) else pa.array([], pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = rates["count"].to_numpy()[at]
        logs = np.frombuffer(b"".join(rates["logs"].to_pylist()), np.float32).reshape(-1, langs)[at][:, used].astype(float)
        sizes = np.diff(stops, prepend=0)
        sums = sums_of(token, stops, logs, np.power(10.0, np.maximum(logs, -300)), np.log10(counts + 0.5) - shift)
        known_words = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=counts[token] > 0, minlength=len(sizes)).astype(np.int64)
        each = sums[:, :-1] + share + end + np.log10(1 - MEMORY * sizes / (sizes + 20))[:, None]
        top = each.max(axis=1)
        total = top + np.log10(np.power(10.0, each - top[:, None]).sum(axis=1))
        made = {"n_tokens": sizes + 1, "n_known": known_words + (model["ends"] > 0), "train_tokens": np.full(len(sizes), n), "base_score": sums[:, -1] + base_end, "score": total}
        return pa.table({"doc_id": part["doc_id"], "held_out": part["held_out"]} | {k: pa.array(v) for k, v in made.items()})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.select("doc_id", "text", "held_out", "block").groupBy("block").cogroup(known.select("block", "word", "count", "logs").groupBy("block")).applyInArrow(rate, schema)


def op2_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return score(docs, held_out)


QUERIES = {"op2_lattice_likelihood": op2_lattice_likelihood}
ORACLES: dict[str, str] = {}
