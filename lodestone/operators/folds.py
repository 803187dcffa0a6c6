"""Ordered folds by key in window functions.

A row of such a fold either changes its key's state, to what the row itself says, or leaves it alone. The state
before a row is thus that of the last changing row before it, and the fold is the one set of changing rows that agrees
with itself. It is found in rounds: from a guess, each round judges every row in the state of the guess's last changing
row before it. A round that changes nothing has found the set; each settles at least one more row of a key, and mostly all,
since a changing row forgets what was before it. The guess is exact for keys whose rows come in order of position:
rows that pass all earlier ones change the state, but not between a closing and an opening one.

Keys with many rows are split into chunks by order: windows run inside chunks, and what a chunk hands on is one row, so
that a key may have any share of all rows. Keys that have not settled after all passes are left to the caller's way, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored

ROUNDS, PASSES, SPLIT = 5, 4, 1 << 20


class _Ordered:
    """Windows over a key's rows in order; in chunks if split."""

    def __init__(self, key: str, order: Sequence[str], split: bool) -> None:
        self.key, self.order, self.split = key, list(order), split
        self.rows = W.partitionBy(key, *["_chunk"] * split).orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1)

    def before(self, df: DataFrame, name: str, value: Column, largest: bool = False) -> DataFrame:
        """df with the last known value before each row as name, or the largest."""
        pick = F.max if largest else lambda c: F.last(c, ignorenulls=True)
        if not self.split:
            return df.withColumn(name, pick(value).over(self.rows))
        df = df.withColumn("_value", value)
        latest = F.max(F.when(F.col("_value").isNotNull(), F.struct(*self.order, "_value")))["_value"]
        ends = df.groupBy(self.key, "_chunk").agg((F.max("_value") if largest else latest).alias("_end"))
        so_far = pick("_end").over(W.partitionBy(self.key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
        ends = ends.select(F.col(self.key).alias("_k"), F.col("_chunk").alias("_c"), so_far.alias("_from")).filter("_from IS NOT NULL")
        x = df.join(ends, df[self.key].eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
        own = pick("_value").over(self.rows)
        x = x.withColumn(name, F.greatest(own, "_from") if largest else F.coalesce(own, "_from"))
        return stored(x.drop("_value", "_k", "_c", "_from"), "fold")


def _stored_and_counted(df: DataFrame, what: Column, name: str) -> tuple[DataFrame, int]:
    """df, stored, and an aggregate over it that is taken on the way."""
    seen = Observation()
    out = stored(df.observe(seen, what.alias("n")), name, "zstd")
    return out, seen.get["n"] or 0


def fold(
    rows: DataFrame, key: str, order: Sequence[str], becomes: Column, say: Callable[[Column], Column], changes: Sequence[str], position: Column, opens: Column | None = None,
    chunk: Column | None = None, rounds: int = ROUNDS, passes: int = PASSES, split: int = SPLIT,
) -> tuple[DataFrame, DataFrame | None]:
    """rows with _said and _changed, and the rows of keys that have not settled (None: all have).

    rows: with _given, true for a key's stored state, which comes first in order and gets no _said. becomes: a struct, the
    state after a changing row. say(state before): what is said of a row; those in changes change the state. position and
    opens (true, false or null) make the guess. chunk: a number that rises with the order; without it keys are not split.
    Rows that have a _row, a number that no two of a key share, are stored already and are not written again.
    """
    rows = rows.withColumn("_chunk", F.lit(0).cast("long") if chunk is None else F.coalesce(chunk, F.lit(-1)).cast("long"))
    if "_row" in rows.columns:
        n_rows = rows.filter("NOT _given").count() if chunk is not None else 0
    else:
        rows, n_rows = _stored_and_counted(rows.withColumn("_row", F.monotonically_increasing_id()), F.count("*"), "fold-rows")
    many = chunk is not None and n_rows > split and not rows.groupBy(key).count().filter(F.col("count") > split).isEmpty()
    o = _Ordered(key, [*order, "_row"], many)
    x = o.before(rows, "_top", position, largest=True)
    x = x.withColumn("_ahead", F.col("_given") | F.col("_top").isNull() | F.coalesce(position > F.col("_top"), F.lit(False)))
    if opens is not None:
        x = o.before(x, "_open", F.when(F.col("_ahead"), opens))
        x = x.withColumn("_ahead", F.col("_ahead") & (F.col("_given") | opens.isNotNull() | F.coalesce("_open", F.lit(True)))).drop("_open")
    x = x.withColumnRenamed("_ahead", "_changed").drop("_top")
    settled = []
    for _ in range(passes):
        for _ in range(rounds):
            x = o.before(x.withColumn("_was", F.col("_changed")), "_now", F.when(F.col("_was"), becomes))
            said = F.when(~F.col("_given"), say(F.col("_now")))
            x = x.withColumn("_said", said).withColumn("_changed", F.col("_given") | F.coalesce(F.col("_said").isin(*changes), F.lit(False))).drop("_now")
        x, n_odd = _stored_and_counted(x, F.count_if(F.col("_was") != F.col("_changed")), "folded")
        if not n_odd:
            settled.append(x)
            x = None
            break
        odd = stored(x.filter("_was <> _changed").select(F.col(key).alias("_k")).distinct(), "odd-keys")
        settled.append(x.join(odd, x[key].eqNullSafe(odd["_k"]), "left_anti"))
        x = x.join(odd, x[key].eqNullSafe(odd["_k"]), "left_semi").drop("_said", "_was")
    out = settled[0]
    for other in settled[1:]:
        out = out.unionByName(other)
    return out.drop("_was", "_chunk", "_row"), None if x is None else x.drop("_changed", "_chunk", "_row")
