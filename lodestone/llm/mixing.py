"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w, with u from a hash of its id and w its quality weight: taking
documents by rising key is weighted sampling without replacement. A source's target buys whole
epochs of all its documents first; what is left is spent on the documents with the smallest
keys, by prefix sums of their sizes. A document is taken into that last part when the middle
of its span lies inside the budget, which leaves each source within half a document of its
target. What is taken is thus a prefix in the order of the keys, and a source's last one taken says it all:
only keys and sizes are sorted, and the documents themselves stay where they lie.

Prefix sums run inside ranges of keys that are equally wide on a log scale, as many to each doubling as make the
fullest one hold about ROWS_PER_RANGE rows of the largest source: of keys with weight w a doubling holds at most a quarter, whatever
w is, so a source with a third of all rows is spread over tasks where its weights are small, too. The ranges' totals
are added up in a table of a row for each. The table of sources itself, a row each, is one task's.

Null text: size 0. Null source: a source of its own, last. Size-0 documents take 0 words. Rows
with equal ids share a key and are ordered by size, and by their place in what is stored. Empty table:
empty result. Columns of the input named like the results' own get _in appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import put_back, set_aside, spool, table, words

WEIGHTS, CAP, ROWS_PER_RANGE, SEED = (5, 2, 1), 3, 200_000, "mix-1"
BLANKS = " \t\n\x0b\x0c\r"
ORDER = ("_key", "doc_id", "size", "_row")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose; less by 5 times the share of markup symbols and twice that of digits, half of it if words are short or long on average; 0.05 at least. size: number of words."""
    n = F.length(text)
    without = lambda some: n - F.length(F.translate(text, some, ""))
    mean = (n - without(BLANKS)) / F.greatest(size, F.lit(1))
    share = 1.0 - (5.0 * without("#*$%&|<>") + 2.0 * without("0123456789")) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), share * F.when(mean.between(3, 10), 1.0).otherwise(0.5)), F.lit(0.05))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares by weight, stopped at cap times the size, the excess reshared.

    The end of the resharing is a level L with target = min(cap * size, L * weight). Sources in
    order of cap * size / weight: L is what the earlier ones leave over, by the weight of the others,
    at the first source that this level doesn't fill.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_room = W.orderBy("_room", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sources.withColumn("_w", pick).withColumn("_most", cap * F.col("source_size")).withColumn("_room", F.col("_most") / F.col("_w"))
    x = x.withColumns({
        "_before": F.coalesce(F.sum("_most").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("_w").over(by_room.rowsBetween(0, W.unboundedFollowing)),
        "_all": F.sum("source_size").over(everything),
    }).withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    open_level = F.min(F.when(F.col("_level") <= F.col("_room"), F.struct("_room", "_level"))).over(everything)["_level"]
    return x.withColumn("_l", open_level).select(
        "source", "source_size", F.when(F.col("_room") <= F.col("_l"), F.col("_most").cast("double")).otherwise(F.col("_l") * F.col("_w")).alias("target")
    )


def key_range(key: Column, rows: int) -> Column:
    """The range of a key, in the order of keys, where the largest source has so many rows."""
    return F.floor(F.log2(key) * max(16, rows // (4 * ROWS_PER_RANGE))).cast("int")


def mix(docs: DataFrame, size: Column, weight: Callable[[Column], Column], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns in keep, size, source_size, target, copies (long: how often the mix takes the document). weight: of the column of sizes."""
    docs, own = set_aside(docs)
    own = {k: c for k, c in own.items() if c in keep}
    keep = tuple(dict.fromkeys(["doc_id", "source", *(k for k, c in own.items()), *(c for c in keep if c in docs.columns)]))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    base = docs.withColumn("size", size).withColumn("_key", -F.log(u) / weight(F.col("size")))
    base = spool(base.select(*keep, "size", "_key", F.monotonically_increasing_id().alias("_row")), "keys")
    most = base.groupBy("source").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    keys = base.select("source", "doc_id", "size", "_key", "_row", key_range(F.col("_key"), most).alias("_range"))
    parts = spool(keys.groupBy("source", "_range").agg(F.sum("size").alias("_sum")), "ranges")
    sources = targets(parts.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = spool(sources.withColumn("_epochs", epochs), "sources")
    before = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("_from", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    starts = starts.alias("a").join(sources.alias("b"), F.expr("a.source <=> b.source")).select("a.*", (F.col("target") - F.col("_epochs") * F.col("source_size")).alias("_left"))
    within = W.partitionBy("source", "_range").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    x = keys.withColumn("_upto", F.sum("size").over(within))
    x = x.alias("a").join(starts.alias("b"), F.expr("a.source <=> b.source and a._range = b._range")).select("a.*", "_from", "_left")
    chosen = x.filter((F.col("_left") > 0) & (F.col("_from") + F.col("_upto") - F.col("size") / 2.0 <= F.col("_left")))
    last = sources.alias("a").join(chosen.groupBy("source").agg(F.max(F.struct(*ORDER)).alias("_last")).alias("b"), F.expr("a.source <=> b.source"), "left").select("a.*", "_last")
    x = base.alias("a").join(spool(last, "last").alias("b"), F.expr("a.source <=> b.source")).select("a.*", "source_size", "target", "_epochs", "_last")
    taken = (F.col("size") > 0) & F.coalesce(F.struct(*ORDER) <= F.col("_last"), F.lit(False))
    out = x.withColumn("copies", F.col("_epochs") + taken.cast("long")).select(*keep, "size", "source_size", "target", "copies")
    return put_back(out, own)


def op9_weighted_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, words(F.col("text")), lambda size: quality_weight(F.col("text"), size))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = f"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    length(text) AS n, n - length(translate(text, '#*$%&|<>', '')) AS symbols, n - length(translate(text, '0123456789', '')) AS digits,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) / CAST(greatest(size, 1) AS DOUBLE) AS mean,
    coalesce(greatest(0.05::DOUBLE, (1.0::DOUBLE - (5.0::DOUBLE * symbols + 2.0::DOUBLE * digits) / greatest(n, 1)) * CASE WHEN mean BETWEEN 3 AND 10 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 0.05::DOUBLE) AS w
  FROM documents),
keyed AS (SELECT *, -ln(u) / w AS k FROM base),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
wt AS (SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS w, 3 * source_size AS most FROM src),
room AS (SELECT *, most / CAST(w AS DOUBLE) AS room FROM wt),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    CAST(sum(w) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM room),
l AS (SELECT level AS l FROM lev WHERE level <= room ORDER BY room, level LIMIT 1),
tgt AS (SELECT source, source_size, CASE WHEN room <= l THEN CAST(most AS DOUBLE) ELSE l * w END AS target FROM lev LEFT JOIN l ON TRUE),
run AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN tgt t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND target - epochs * source_size > 0 AND upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""

QUERIES = {"op9_weighted_mixing": op9_weighted_mixing}
ORACLES = {"op9_weighted_mixing": MIX_SQL}
