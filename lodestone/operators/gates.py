"""Checks over whole tables: keys, references, totals, accounting. Each returns a small DataFrame; require() acts on one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate found violations."""


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def named_keys(df: DataFrame, checks: Mapping[str, Sequence[str]]) -> DataFrame:
    """(check_name, value): a row a check and row of df, its columns together as one value."""
    pairs = [F.struct(F.lit(name).alias("check_name"), F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")) for name, columns in checks.items()]
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def repeats_by_name(keys: DataFrame, names: Sequence[str]) -> DataFrame:
    """(check_name, n_violations) of named_keys: values that occur more than once, by check, all in one grouping."""
    found = keys.groupBy("check_name", "value").count().filter("count > 1").groupBy("check_name").agg(F.count("*").alias("n"))
    one = found.agg(*[F.coalesce(F.max(F.when(F.col("check_name") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
    return one.unpivot([], [F.col(f"`{n}`") for n in names], "check_name", "n_violations")


def domain_counts(uses: Sequence[tuple[DataFrame, Sequence[tuple[int, int, Column]]]]) -> DataFrame:
    """(domain, repeats, orphans, nulls), arrays by place: each frame puts values into places (domain, place, value), and place 0 of a domain has its keys.

    repeats: values that a place has more than once, null being one; orphans: its rows whose value isn't among the keys; nulls: its rows
    without a value. Each frame is read once, and all values are grouped once: nothing is joined, whatever the size of parents.
    """
    width = 1 + max(place for _, puts in uses for _, place, _ in puts)
    put = lambda domain, place, value: F.struct(F.lit(domain).alias("domain"), F.lit(place).alias("place"), value.cast("string").alias("value"))
    rows = [df.select(F.explode(F.array(*[put(*p) for p in puts])).alias("x")).select("x.*") for df, puts in uses]
    each = reduce(DataFrame.unionByName, rows).groupBy("domain", "value").agg(*[F.count_if(F.col("place") == k).alias(f"n{k}") for k in range(width)])
    by_place = lambda of: F.array(*[of(F.col(f"n{k}")) for k in range(width)])
    rows_where = lambda which: by_place(lambda n: F.sum(F.when(which, n).otherwise(0)))
    unknown = F.col("value").isNotNull() & (F.col("n0") == 0)
    return each.groupBy("domain").agg(by_place(lambda n: F.count_if(n > 1)).alias("repeats"), rows_where(unknown).alias("orphans"), rows_where(F.col("value").isNull()).alias("nulls"))


def orphan_counts(child: DataFrame, parents: Mapping[str, tuple[str, DataFrame, str, int | None]], more: Mapping[str, Column]) -> DataFrame:
    """One row: for each name the rows of child whose column isn't a key of the parent, and the aggregates of more, in one pass over child. parents: name -> (column, parent, key, exempt value); without an exempt value only nulls pass."""
    x, counts = child, []
    for n, (name, (column, parent, key, exempt)) in enumerate(parents.items()):
        known = parent.select(F.col(key).alias(f"_pk{n}")).distinct()
        x = x.join(known, F.col(column) == F.col(f"_pk{n}"), "left")
        bound = F.col(column).isNotNull() if exempt is None else F.col(column) != exempt
        counts.append(F.count_if(bound & F.col(f"_pk{n}").isNull()).alias(name))
    return x.agg(*counts, *[c.alias(n) for n, c in more.items()])


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, exempt=None) -> DataFrame:
    """Rows of child whose key isn't in the parent; null and exempt keys pass."""
    rows = child.filter(F.col(fk).isNotNull() if exempt is None else F.col(fk) != exempt)
    return rows.join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def reference_report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check_name, n_violations) of several frames of violations."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_violations")).select(F.lit(n).alias("check_name"), "n_violations") for n, df in checks.items()])


def accounting(df: DataFrame, disposition: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows by disposition; every row is in exactly one."""
    return df.groupBy(*groups, disposition).agg(F.count("*").alias("n_rows"))


def control_total(df: DataFrame, amount: Column, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,4)").alias(name))


def count_identity(name: str, expected: DataFrame, found: DataFrame) -> DataFrame:
    """(check_name, n_violations): by how many rows the counts differ."""
    a, b = (df.agg(F.count("*").alias(n)) for df, n in ((expected, "a"), (found, "b")))
    return a.crossJoin(F.broadcast(b)).select(F.lit(name).alias("check_name"), F.abs(F.col("a") - F.col("b")).alias("n_violations"))


def reconcile(mart: DataFrame, fact: DataFrame, count: str, total: str, amount: str) -> DataFrame:
    """One row: whether the mart's counts and totals add up to the fact's."""
    a = mart.agg(F.sum(count).alias("mart_rows"), F.sum(total).alias("mart_total"))
    b = fact.agg(F.count("*").alias("fact_rows"), F.sum(amount).alias("fact_total"))
    x = F.broadcast(a).crossJoin(F.broadcast(b))
    return x.withColumn("passed", F.col("mart_rows").eqNullSafe(F.col("fact_rows")) & F.col("mart_total").eqNullSafe(F.col("fact_total")))


def require(report: DataFrame, condition: str, message: str) -> None:
    """Raises if any row of a (small) report fails the condition."""
    bad = report.filter(f"NOT coalesce({condition}, false)").limit(5).collect()
    if bad:
        raise GateError(f"{message}: {bad}")


def require_all(problems: Sequence[str]) -> None:
    """Raises with every problem, not with the first."""
    if problems:
        raise GateError("; ".join(problems))


def references(rules: Sequence[tuple[str, str, DataFrame, DataFrame, str, bool]]) -> DataFrame:
    """(child, column_name, n_null, n_orphans) of (name, column, child, parent, key, may be null): nulls count only where they are forbidden."""
    out = []
    for name, column, child, parent, key, optional in rules:
        known = parent.select(F.col(key).alias("_pk")).distinct().withColumn("_known", F.lit(True))
        x = child.select(F.col(column).alias("_fk")).join(known, F.col("_fk") == F.col("_pk"), "left")
        n_null = F.lit(0).cast("long") if optional else F.count_if(F.col("_fk").isNull())
        one = x.agg(n_null.alias("n_null"), F.count_if(F.col("_fk").isNotNull() & F.col("_known").isNull()).alias("n_orphans"))
        out.append(one.select(F.lit(name).alias("child"), F.lit(column).alias("column_name"), "n_null", "n_orphans"))
    return reduce(DataFrame.unionByName, out)


def row_counts(tables: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table_name, source_rows, target_rows, passed)."""
    out = []
    for name, (source, target) in tables.items():
        a, b = source.agg(F.count("*").alias("source_rows")), target.agg(F.count("*").alias("target_rows"))
        out.append(a.crossJoin(F.broadcast(b)).select(F.lit(name).alias("table_name"), "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("passed")))
    return reduce(DataFrame.unionByName, out)


def column_tests(df: DataFrame, unique: Sequence[str] = (), not_null: Sequence[str] = ()) -> DataFrame:
    """(test, n_failures) of unique and not_null tests of single columns, nulls in one pass."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"not_null_{c}") for c in not_null]) if not_null else None
    out = [nulls.unpivot([], nulls.columns, "test", "n_failures")] if nulls is not None else []
    out += [repeated_keys(df.filter(F.col(c).isNotNull()), [c]).agg(F.count("*").alias("n_failures")).select(F.lit(f"unique_{c}").alias("test"), "n_failures") for c in unique]
    return reduce(DataFrame.unionByName, out)


def missing_measures(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(check_name, n_violations): rows without a measure, in one pass."""
    one = df.agg(*[F.count_if(F.col(m).isNull()).alias(m) for m in measures])
    return one.unpivot([], list(measures), "check_name", "n_violations")
