"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows get numbers and are stored once with them; all draws hang on these numbers alone, so that rows
that are equal, or copies of one document, go their ways independently. Numbers are dealt to source parts by
a hash. For each part, one draw from the multivariate hypergeometric law says how many of its rows
go to each shard, given what the shards still lack; shard sizes are fixed beforehand and differ by one
at most. Each part is permuted locally (rank by a second hash) and cut along its draw; after the
exchange each shard is permuted again (rank by a third hash). Until then only numbers move; then each
row meets its shard and slot, and moves once. All choices come from hashes of stored numbers and a
seeded generator, so a task that runs again gives the same rows; a rerun does if its input comes in
the same partitions.

The driver holds counts alone: parts x shards of them, with at least ROWS_PER_PART rows a part
once there are MAX_PARTS parts. Ranks inside a shard are found in random sub-buckets, so no
task ever holds a whole shard.

Null ids and texts are values like any other; an empty table gives an empty table; columns of the
input named shard or slot get _in appended.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import put_back, set_aside, spool, table, text_bytes

MAX_PARTS, ROWS_PER_PART, ROWS_PER_BUCKET = 4096, 5_000_000, 100_000


@lru_cache(10_000)
def log_factorial(n: int) -> Decimal:
    """To 30 digits after the point or so: Stirling's series, whose first term left out is under 1e-30 from n = 1000 on."""
    with localcontext(prec=60):
        if n < 1000:
            return sum((Decimal(k).ln() for k in range(2, n + 1)), Decimal(0))
        z, half_log_2pi = Decimal(n + 1), Decimal("0.91893853320467274178032973640561763986139747363778")
        series = (Decimal(1) / (d * z**k) for d, k in ((12, 1), (-360, 3), (1260, 5), (-1680, 7), (1188, 9)))
        return (z - Decimal("0.5")) * z.ln() - z + half_log_2pi + sum(series)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement are good; exact inversion from the mode for large counts."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    mode = min(max(((n + 1) * (good + 1)) // (total + 2), low), high)

    def log_choose(a: int, b: int) -> Decimal:
        return log_factorial(a) - log_factorial(b) - log_factorial(a - b)

    with localcontext(prec=60):
        p0 = float((log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(total, n)).exp())
    u, left, right, pl, pr = rng.random(), mode, mode, p0, p0
    u -= p0
    while u > 0 and (left > low or right < high) and (pl > 0 or pr > 0):
        if right < high:
            pr *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > low:
            pl *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def communication_matrix(part_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Exact counts, parts x shards: rows sum to part_sizes, columns to shard_sizes."""
    rng, lack = np.random.default_rng(seed), list(shard_sizes)
    out = np.zeros((len(part_sizes), len(shard_sizes)), dtype=np.int64)
    for p, n in enumerate(part_sizes):
        rest = sum(lack)
        for s in range(len(lack)):
            rest -= lack[s]
            out[p, s] = k = hypergeometric(rng, lack[s], rest, n)
            lack[s] -= int(k)
            n -= int(k)
    return out


def hypergeometric_shuffle(df: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard); shard sizes differ by one at most."""
    spark = df.sparkSession
    df, own = set_aside(df)
    rows = spool(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    parts = max(64, min(MAX_PARTS, total // 20_000), total // ROWS_PER_PART)

    def mix(k: int):
        return F.xxhash64(F.lit(seed + k), "_row")

    dealt = rows.select("_row", F.pmod(mix(0), F.lit(parts)).cast("int").alias("_part"))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    names = sorted(sizes)
    wanted = [total // shards + (s < total % shards) for s in range(shards)]
    cuts = communication_matrix([sizes[p] for p in names], wanted, seed).cumsum(axis=1)
    drawn = spark.createDataFrame([(p, c.tolist()) for p, c in zip(names, cuts, strict=True)], "_part int, _cuts array<long>")

    here = W.partitionBy("_part").orderBy(mix(1), "_row")
    buckets = max(4, total // shards // ROWS_PER_BUCKET)
    sent = dealt.withColumn("_rank", F.row_number().over(here) - 1).join(drawn, "_part")
    sent = sent.select("_row", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("int").alias("shard"), F.pmod(mix(2), F.lit(buckets)).cast("int").alias("_bucket"))
    sent = spool(sent, "exchange")
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "_bucket").count().select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    within = W.partitionBy("shard", "_bucket").orderBy(mix(3), "_row")
    places = sent.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["shard", "_bucket"])
    places = places.select("_row", "shard", (F.col("_from") + F.col("_rank")).cast("long").alias("slot"))
    return put_back(rows.join(places.hint("merge"), "_row").select(*df.columns, "shard", "slot"), own)


def op4_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 24 shards under the law of rows: counts at most one apart."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (text_bytes(F.col("text")) + 8).alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32")
    )
    return hypergeometric_shuffle(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_hypergeometric_sharding": op4_hypergeometric_sharding}
ORACLES: dict[str, str] = {}
