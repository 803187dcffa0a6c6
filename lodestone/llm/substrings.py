"""Removes every byte covered by a 100-byte string that also starts earlier in the corpus.

Strings can only be equal if they hold the same anchor: the smallest hash among their 24-byte
grams (each 100-byte string has one, by its content alone), where grams that very many texts have
come last: they are found in a sample of SAMPLE_BYTES, at most MOST_HOT of them, and are anchors only of
strings that have no others. So a common phrase doesn't gather all its neighbourhoods in one place, whatever
is in the sample, and no result depends on it. Neighbouring strings with one anchor form a context. Contexts are dealt to buckets by anchor, as two hashes and a place:

1. Of contexts that are equal as a whole, all but the first are covered. Those equal inside one
   slice (SLICE_BYTES) of a task are told apart there, so a text with very many copies sends one row a slice.
2. Where an anchor has several different contexts (or one that repeats inside itself), the bytes
   of the first of each are sent, and sorted as suffixes in two stages: suffixes that are smaller than
   their successors are sorted directly, the others are induced by a scan over the buckets of first
   bytes; common prefixes of neighbours then show which 100-byte strings are equal, and all but the first of
   those are covered.

A bucket holds about BUCKET_BYTES of text's anchors, and suffixes are sorted in parts of a bucket.

Earlier means a smaller doc_id, or the same document and an earlier start; null ids come last. Rows
with equal or null ids count as one document each, in the order of a hash of their texts. Null text:
empty, nothing removed. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_tasks, spool, table

LENGTH, GRAM, BUCKET_BYTES, PARTS, SLICE_BYTES = 100, 24, 16 << 20, 64, 1 << 19
#: Sample for grams that are common: its bytes, the most grams, and how often one is in a slice, and in how large a share of the sample's texts.
SAMPLE_BYTES, MOST_HOT, HOT_IN_SLICE, HOT_SHARE = 64 << 20, 100_000, 4, 0.005
SPAN = LENGTH - GRAM + 1
_M = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as big-endian numbers; zeros follow the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x[: len(data)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on."""
    w = words8(data)
    h = w[:-16] * _M[0]
    h ^= h >> np.uint64(31)
    for k in (1, 2):
        h = (h ^ w[8 * k : len(w) - 16 + 8 * k]) * _M[k]
        h ^= h >> np.uint64(29)
    return h


class Hot:
    """Which hashes are among the common ones: a table of bits says no to nearly all others at once."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def last(self, h: np.ndarray) -> np.ndarray:
        """h with the common ones behind all others; order is kept among each."""
        out = h >> np.uint64(1)
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at[self.hashes[found] == h[at]]] |= np.uint64(1 << 63)
        return out


def contexts(texts: list[bytes], hot: Hot) -> dict[str, np.ndarray]:
    """anchor, whole (hash of the context), doc (index), start, n (strings), again (repeats inside itself)."""
    sizes = np.array([len(x) for x in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    empty = {k: np.empty(0, t) for k, t in (("anchor", np.uint64), ("whole", np.uint64), ("doc", np.int64), ("start", np.uint32), ("n", np.uint8), ("again", np.uint8))}
    if sizes.max(initial=0) < LENGTH:
        return empty
    h = hot.last(gram_hashes(data))
    m, width = h, 1
    while width * 2 <= SPAN:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (SPAN - width)], m[SPAN - width :])
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - LENGTH + 1, 0))
    at = np.arange(len(doc)) + (offsets[:-1] - np.concatenate([[0], np.cumsum(np.maximum(sizes - LENGTH + 1, 0))])[:-1])[doc]
    low = m[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    first = np.nonzero(new)[0]
    run = np.arange(len(at)) - first[np.cumsum(new) - 1]
    new |= run % SPAN == 0
    first = np.nonzero(new)[0]
    n = np.diff(np.append(first, len(at)))
    start, low, doc = at[first], low[first], doc[first]
    power, inverse = _powers(1 << max(16, int(len(h)).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    whole = (sums[start + n + SPAN - 1] - sums[start]) * inverse[start]
    whole ^= whole >> np.uint64(32)
    # strings may repeat inside a context if two neighbouring anchors in it have one hash
    top, width = np.concatenate([np.zeros(SPAN - 1, np.uint64), m, np.zeros(SPAN - 1, np.uint64)]), 1
    while width * 2 <= SPAN:
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    top = np.maximum(top[: len(top) - (SPAN - width)], top[SPAN - width :])
    anchors = np.nonzero(h[: len(top)] == top[: len(h)])[0]
    near = anchors[:-1][(h[anchors[1:]] == h[anchors[:-1]]) & (np.diff(anchors) <= SPAN)]
    again = (np.searchsorted(near, start + n + SPAN - 1) > np.searchsorted(near, start)).astype(np.uint8)
    return {"anchor": low, "whole": whole, "doc": doc, "start": (start - offsets[:-1][doc]).astype(np.uint32), "n": n.astype(np.uint8), "again": again}


def stretches(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Runs of about limit bytes, with (index of the text, where in it) of each: a longer text is cut into stretches that overlap by one byte less than a string."""
    parts: list[bytes] = []
    places: list[tuple[int, int]] = []
    size = 0
    for k, x in enumerate(texts):
        for at in range(0, max(1, len(x) - LENGTH + 1), limit):
            parts.append(x[at : at + limit + LENGTH - 1])
            places.append((k, at))
            size += len(parts[-1])
            if size >= limit:
                yield parts, places
                parts, places, size = [], [], 0
    if parts:
        yield parts, places


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of text in order of their first LENGTH codes or more; left: codes up to the next separator (code 0)."""
    size = len(text)
    eight = words8(text)
    short = left < 8
    eight[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))) - np.uint64(1)) if short.any() else np.uint64(0)
    eight[left == 0] = 0
    change = np.nonzero(np.append(text[1:] != text[:-1], True))[0]
    end = change[np.searchsorted(change, np.arange(size))]
    after = np.append(text, 0)[end + 1]
    small = (text < after) | (text == 0)
    # stage one: directly sort the suffixes that are smaller than their successors
    b = np.nonzero(small)[0]
    b = b[np.argsort(eight[b], kind="stable")]
    key = eight[b]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
    for off in range(8, LENGTH + 4, 8):
        tied = np.concatenate([[False], group[1:] == group[:-1]])
        tied[:-1] |= tied[1:]
        tied &= left[b] >= off
        rows = np.nonzero(tied)[0]
        if len(rows) < 2:
            break
        at = b[rows]
        key = eight[np.minimum(at + off, size - 1)]
        order = np.lexsort((key, group[rows]))
        b[rows] = at[order]
        key, old = key[order], group[rows]
        split = np.zeros(len(b), np.int64)
        split[rows[1:]] = (old[1:] == old[:-1]) & (key[1:] != key[:-1])
        edge = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(edge | split)
    # stage two: induce the others, first byte by first byte
    edges = np.searchsorted(text[b], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        found = [wave]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == c) & ~small[wave]]
            found.append(wave)
        here = np.concatenate([*found, b[edges[c] : edges[c + 1]]])
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        before = before[text[before] > c]
        codes = text[before]
        before = before[np.argsort(codes, kind="stable")]
        counts = np.bincount(codes, minlength=256)
        at = 0
        for d in np.nonzero(counts)[0]:
            waiting[d].append(before[at : at + counts[d]])
            at += counts[d]
    return np.concatenate(out)


def covered_strings(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the strings in pieces that also start earlier in one of them."""
    sizes = np.array([len(x) for x in pieces], np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).copy()
    ends = np.cumsum(sizes + 1) - 1
    begin = ends - sizes
    code = text + np.uint8(1)
    code[ends] = 0
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    left = ends[piece] - np.arange(len(code))
    order = suffix_array(code, left)
    order = order[left[order] >= LENGTH]
    # adjacent common prefixes, as far as they matter
    eight = words8(code)
    equal = np.arange(len(order) - 1) if len(order) else np.empty(0, np.int64)
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        equal = equal[eight[order[equal] + off] == eight[order[equal + 1] + off]]
    new = np.ones(len(order), bool)
    new[equal + 1] = False
    first = np.nonzero(new)[0]
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    where = starts[piece[order]] + order - begin[piece[order]]
    place = (np.unique(docs, return_inverse=True)[1][piece[order]].astype(np.int64) << 32) | where
    least = np.minimum.reduceat(place, first)[np.cumsum(new) - 1]
    gone = order[place > least]
    return piece[gone], gone - begin[piece[gone]]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(data) // size, 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


PLACES = ("<u8", "<u8", "<i8", "<u4", "u1", "u1")
FOUND = "row long, bucket int, covered binary, wanted binary"


def _runs(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of following starts (sorted by doc, start): doc, first start, number."""
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.nonzero(new)[0]
    return docs[first], starts[first], np.diff(np.append(first, len(docs)))


def _by_doc(docs: np.ndarray) -> Iterator[tuple[int, slice]]:
    if len(docs):
        cut = np.concatenate([[0], np.nonzero(docs[1:] != docs[:-1])[0] + 1, [len(docs)]])
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield int(docs[i]), slice(i, j)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row: unique, in the order of ids, then of hashes of the texts; only once stored does it stay the same."""
    keys = ["no_id", "doc_id", "_hash", "_nth"]
    x = docs.withColumns({"_hash": F.xxhash64("data"), "_nth": F.monotonically_increasing_id()})
    return x.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "no_id", "data", F.monotonically_increasing_id().alias("row"))


def common_grams(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of grams that are in many texts of a sample of docs (row, data); size: bytes of all."""
    every = max(1, size // SAMPLE_BYTES)
    sample = docs.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for parts, _ in stretches(b["data"].tolist()):
                data = np.frombuffer(b"".join(parts) + bytes(GRAM), np.uint8)
                grams, n = np.unique(gram_hashes(data), return_counts=True)
                often = n >= HOT_IN_SLICE
                yield pd.DataFrame({"gram": grams[often].view(np.int64), "n": n[often]})

    n = sample.count()
    found = sample.select("data").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(16, int(HOT_SHARE * n)))
    return np.array([r[0] for r in found.orderBy(F.desc("n"), "gram").limit(MOST_HOT).select("gram").collect()], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the remaining bytes) of docs (doc_id, text)."""
    spark = docs.sparkSession
    last = (1 << 63) - 1
    docs = docs.select(F.coalesce("doc_id", F.lit(last)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("data"))
    by_id = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("size"))
    size, most = by_id.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    docs = docs.withColumn("row", F.col("doc_id")) if most < 2 else spool(_numbered(docs), "rows")
    buckets = max(n_tasks(spark), size // BUCKET_BYTES)
    sent = spark.sparkContext.broadcast(Hot(common_grams(docs, size)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("row", kind="stable")
            data, ids = b["data"].tolist(), b["row"].to_numpy(np.int64)
            for parts, at in stretches(data):
                c = contexts(parts, sent.value)
                text, start = np.array(at, np.int64).reshape(-1, 2)[c["doc"]].T
                c["doc"], c["start"] = ids[text], (c["start"] + start).astype(np.uint32)
                order = np.lexsort((c["whole"], c["anchor"]))
                same = (c["anchor"][order][1:] == c["anchor"][order][:-1]) & (c["whole"][order][1:] == c["whole"][order][:-1])
                later = np.zeros(len(order), bool)
                later[order[1:][same]] = True
                bucket = (c["anchor"] % np.uint64(buckets)).astype(np.int64)
                bucket[later] = -1
                order = np.argsort(bucket, kind="stable")
                rows = []
                for k, part in _by_doc(bucket[order]):
                    at = order[part]
                    to = int(c["anchor"][at[0]] % np.uint64(buckets)) if k < 0 else k
                    rows.append((to, k < 0, _pack(*(c[x][at] for x in ("anchor", "whole", "doc", "start", "n", "again")))))
                yield pd.DataFrame(rows, columns=["bucket", "later", "places"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        bucket, rows = int(group["bucket"].iloc[0]), []
        for data in group.loc[group["later"], "places"]:
            _, _, doc, start, n, _ = _unpack(data, *PLACES)
            for d, part in _by_doc(doc):
                rows.append((d, bucket, _pack(start[part], n[part]), None))
        parts = [_unpack(x, *PLACES) for x in group.loc[~group["later"], "places"]]
        if parts:
            anchor, whole, doc, start, n, again = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, doc, whole, anchor))
            anchor, whole, doc, start, n, again = (x[order] for x in (anchor, whole, doc, start, n, again))
            new_anchor = np.ones(len(anchor), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new = new_anchor.copy()
            new[1:] |= whole[1:] != whole[:-1]
            kinds = np.add.reduceat(new.astype(np.int64), np.nonzero(new_anchor)[0])[np.cumsum(new_anchor) - 1]
            wanted = new & ((kinds > 1) | (again > 0))
            part_no = ((anchor >> np.uint64(40)) % np.uint64(PARTS)).astype(np.uint8)
            keep = np.nonzero(~new | wanted)[0]
            keep = keep[np.lexsort((start[keep], doc[keep]))]
            for d, part in _by_doc(doc[keep]):
                at = keep[part]
                gone, ask = at[~new[at]], at[wanted[at]]
                rows.append((d, bucket, _pack(start[gone], n[gone]) if len(gone) else None, _pack(start[ask], n[ask], part_no[ask]) if len(ask) else None))
        return pd.DataFrame(rows, columns=["row", "bucket", "covered", "wanted"]).astype({"row": "int64", "bucket": "int32"})

    placed = docs.select("row", "data").mapInPandas(place, "bucket int, later boolean, places binary")
    found = spool(placed.groupBy("bucket").applyInPandas(meet, FOUND), "contexts")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["bucket", "row", "starts", "sizes", "parts", "bytes"]
        for b in batches:
            rows = []
            for d, data, asked in zip(b["row"], b["data"], b["asked"], strict=True):
                for one in asked:
                    start, n, part = _unpack(one["wanted"], "<u4", "u1", "u1")
                    span = n.astype(np.uint32) + np.uint32(LENGTH - 1)
                    rows.append((one["bucket"], d, _pack(start), _pack(span), _pack(part), b"".join(data[s : s + x] for s, x in zip(start.tolist(), span.tolist(), strict=True))))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        pieces: list[bytes] = []
        doc, start, part = [], [], []
        for d, s, z, p, data in zip(group["row"], group["starts"], group["sizes"], group["parts"], group["bytes"], strict=True):
            at = 0
            for x in np.frombuffer(z, "<u4").tolist():
                pieces.append(data[at : at + x])
                at += x
            start.append(np.frombuffer(s, "<u4").astype(np.int64))
            part.append(np.frombuffer(p, "u1"))
            doc.append(np.full(len(start[-1]), d, np.int64))
        doc, start, part = (np.concatenate(x) for x in (doc, start, part))
        docs, starts = [], []
        for p in np.unique(part):
            rows = np.nonzero(part == p)[0]
            piece, offset = covered_strings([pieces[k] for k in rows], doc[rows], start[rows])
            docs.append(doc[rows][piece])
            starts.append(start[rows][piece] + offset)
        d, s = np.concatenate(docs), np.concatenate(starts)
        order = np.lexsort((s, d))
        d, s, n = _runs(d[order], s[order])
        out = [(x, _pack(s[k].astype("<u4"), n[k].astype("<u4"))) for x, k in _by_doc(d)]
        return pd.DataFrame(out, columns=["row", "covered"]).astype({"row": "int64"})

    asked = found.filter("wanted IS NOT NULL").groupBy("row").agg(F.collect_list(F.struct("bucket", "wanted")).alias("asked"))
    schema = "bucket int, row long, starts binary, sizes binary, parts binary, bytes binary"
    fetched = docs.select("row", "data").join(asked.hint("merge"), "row").mapInPandas(fetch, schema)
    sorted_ = fetched.groupBy("bucket").applyInPandas(compare, "row long, covered binary")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data, short, long_ in zip(b["data"], b["short"], b["long"], strict=True):
                kept, removed, spans = data, 0, 0
                if (short is not None and len(short)) or (long_ is not None and len(long_)):
                    edge = np.zeros(len(data) + 1, np.int32)
                    for lists, kinds in ((short, ("<u4", "u1")), (long_, ("<u4", "<u4"))):
                        for one in lists if lists is not None else ():
                            s, n = _unpack(one, *kinds)
                            np.add.at(edge, np.minimum(s, len(data)), 1)
                            np.add.at(edge, np.minimum(s.astype(np.int64) + n + LENGTH - 1, len(data)), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            out.insert(0, "doc_id", pd.arrays.IntegerArray(b["doc_id"].to_numpy(np.int64), b["no_id"].to_numpy(bool).copy()))
            yield out

    short = found.filter("covered IS NOT NULL").groupBy("row").agg(F.collect_list("covered").alias("short"))
    long_ = sorted_.groupBy("row").agg(F.collect_list("covered").alias("long"))
    full = docs.join(short.hint("merge"), "row", "left").join(long_.hint("merge"), "row", "left")
    return full.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op6_repeated_substrings": op6_repeated_substrings}
ORACLES: dict[str, str] = {}
