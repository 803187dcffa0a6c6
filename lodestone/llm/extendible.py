"""Exact duplicates by an extendible-hash index on shared files, in DataFrame functions only.

Texts are equal when they are the same after lower-casing A-Z. A key is a 64-bit hash of that form.
The index starts with a directory of 2^g slots (the first g bits of a key), g so that a bucket
holds CAPACITY keys on average at most. While a bucket at the directory's depth is overfull, the directory
doubles and just the overfull buckets split by the next bit; a bucket that didn't split keeps its depth, and
several slots then lead to it. After DOUBLINGS rounds an overfull bucket is left as it is:
only its size differs. The directory is a table, so it may have any number of slots.

Texts go to the owner of their slot, a range of keys, which compares bytes (it groups by key and text) and
chains the different texts that share a key. A key that many rows share is summed up where its
rows lie before it is sent: at least one in HOT of all rows must share it, so there are at most HOT such
keys, and that set is broadcast. An entry of the index has its bucket, key, place in its chain, digest, number of rows and the
id that stays; only entries of chains keep their text, for a look-up by key must compare bytes there and
nowhere else. Rows then find their entry by key.

Of equal texts the row with the largest id stays; null ids come last, and of rows with equal ids one stays: the one that comes first
in what is stored. Null text: empty, a text like any other. Very long texts are rows like any other, compared
whole. Repeated rows: members of one class. Empty table: empty result. Other columns, whatever their
names, are not read, and pass through drop_copies.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import put_back, set_aside, spool, table

CAPACITY, DOUBLINGS, HOT = 512, 8, 10_000


def normalised(text: Column) -> Column:
    """text with A-Z in lower case; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth)


def directory(keys: DataFrame, capacity: int = CAPACITY, doublings: int = DOUBLINGS) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of a table of distinct keys, and the directory's depth; bucket is the prefix of depth bits that its keys share."""
    depth = max(1, math.ceil(math.log2(max(1, keys.count() / capacity))))
    level = spool(keys.groupBy(_prefix(depth).alias("bucket")).agg(F.count("*").alias("n_keys")), "buckets")
    leaves = []
    for _ in range(doublings):
        over = level.filter(F.col("n_keys") > capacity)
        if over.isEmpty():
            break
        leaves.append(level.filter(F.col("n_keys") <= capacity).select("bucket", F.lit(depth).alias("depth")))
        parts = keys.withColumn("_parent", _prefix(depth)).join(over.select(F.col("bucket").alias("_parent")), "_parent", "left_semi")
        depth += 1
        level = spool(parts.groupBy(_prefix(depth).alias("bucket")).agg(F.count("*").alias("n_keys")), "buckets")
    leaf = level.select("bucket", F.lit(depth).alias("depth"))
    for other in leaves:
        leaf = leaf.unionByName(other)
    slots = F.expr(f"sequence(shiftleft(bucket, {depth} - depth), shiftleft(bucket + 1, {depth} - depth) - 1)")
    return spool(leaf.select(F.explode(slots).alias("slot"), "bucket", "depth"), "directory"), depth


def build(base: DataFrame, heads: DataFrame, capacity: int = CAPACITY, doublings: int = DOUBLINGS) -> DataFrame:
    """The stored index of base (doc_id, key, text): bucket, depth, key, chain, chain_length, keep_id, group_size, n_bytes, text_sha256, text (of chains), _first. heads: (key, n_rows, _first: the row that stays if the key has one text)."""
    slots, depth = directory(heads.select("key"), capacity, doublings)
    n_rows = heads.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    hot = F.broadcast(heads.filter(F.col("n_rows") >= max(2, n_rows // HOT + 1)).select("key"))
    texts = base.select("key", "text", "doc_id")
    cold = texts.join(hot, "key", "left_anti").withColumn("n", F.lit(1).cast("long"))
    summed = texts.join(hot, "key", "left_semi").groupBy("key", "text").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    sent = cold.unionByName(summed).withColumn("slot", _prefix(depth)).repartition("slot")
    owned = sent.groupBy("slot", "key", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = W.partitionBy("slot", "key")
    chained = owned.withColumns({"chain": F.row_number().over(chain.orderBy("text")), "chain_length": F.count("*").over(chain)})
    entry = chained.select(
        "slot", "key", "chain", "chain_length", "keep_id", "group_size", F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("text_sha256"), F.when(F.col("chain_length") > 1, F.col("text")).alias("text"),
    )
    return spool(entry.join(slots, "slot").drop("slot").join(heads.select("key", "_first"), "key"), "index")


def classes(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY, doublings: int = DOUBLINGS) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text, _row: a stored number of the row): (doc_id, _row, keep_id, group_size, kept, text_sha256, n_bytes, bucket, chain), and the index."""
    base = docs.select("doc_id", "_row", normalised(F.col("text")).alias("text"))
    base = spool(base.withColumn("key", hashed(F.col("text"))), "texts")
    first = F.max(F.struct("doc_id", (-F.col("_row")).alias("_row")))
    heads = spool(base.groupBy("key").agg(F.count("*").alias("n_rows"), first.alias("_first")), "heads")
    index = build(base, heads, capacity, doublings)
    known = ["keep_id", "group_size", "text_sha256", "n_bytes", "bucket", "chain"]
    kept = (F.col("_row") == -F.col("_first")["_row"]).alias("kept")
    alone = index.filter("chain_length = 1").select("key", "_first", *known)
    out = base.select("key", "doc_id", "_row").join(alone, "key").select("doc_id", "_row", *known, kept)
    several = index.filter("chain_length > 1")
    if not several.isEmpty():
        rows = base.join(several.select("key").distinct(), "key", "left_semi")
        rows = spool(rows.join(several.select("key", "text", *known), ["key", "text"]).select("key", "doc_id", "_row", *known), "chained")
        firsts = spool(rows.groupBy("key", "chain").agg(first.alias("_first")), "firsts")
        out = out.unionByName(rows.join(firsts, ["key", "chain"]).select("doc_id", "_row", *known, kept))
    return out, index


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row that stays the same, as it is stored with it."""
    return spool(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row has, which stays."""
    docs, own = set_aside(docs)
    rows = numbered(docs)
    stay = spool(classes(rows)[0].filter("kept").select("_row"), "stay")
    return put_back(rows.join(stay, "_row", "left_semi").drop("_row"), own)


def op12_extendible_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    return classes(docs)[0].select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes")


DEDUP_SQL = """
WITH base AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
grouped AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM base)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256, CAST(strlen(t) AS BIGINT) AS n_bytes FROM grouped
"""

QUERIES = {"op12_extendible_dedup": op12_extendible_dedup}
ORACLES = {"op12_extendible_dedup": DEDUP_SQL}
