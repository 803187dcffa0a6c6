"""Row checks with reasons, verdicts and rejections, and batch profiles. A check is a Boolean column that is never null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"^(?:{pattern})"), F.lit(False))


def castable(c: Column, kind: str) -> Column:
    """Null passes."""
    return c.isNull() | c.try_cast(kind).isNotNull()


def in_range(c: Column, low, high) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def positive(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def one_of(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def known(df: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """df with the flag `name`: key is null or is in the parent."""
    keys = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return df.join(keys, df[key] == F.col("_k"), "left").withColumn(name, F.col(key).isNull() | F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def failing(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that fail, in order."""
    return F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def with_verdict(df: DataFrame, hard: Mapping[str, Column], soft: Mapping[str, Column] | None = None) -> DataFrame:
    """df with failing_check_name (the first), error_reason (all), warnings, is_valid."""
    bad, warn = failing(hard), failing(soft) if soft else F.array().cast("array<string>")
    out = df.withColumn("_bad", bad).withColumn("warnings", warn)
    return out.withColumns({
        "failing_check_name": F.get("_bad", F.lit(0)),
        "error_reason": F.when(F.size("_bad") > 0, F.array_join("_bad", "; ")),
        "is_valid": F.size("_bad") == 0,
    }).drop("_bad")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("is_valid"), df.filter("NOT is_valid")


def rejections(bad: DataFrame, raw: Sequence[str], dataset: str, run_id: str, record_id: str) -> DataFrame:
    """One quarantine row per rejected record, with the raw record as JSON."""
    return bad.select(
        F.lit(dataset).alias("dataset"), F.lit(run_id).alias("run_id"), F.col(record_id).cast("string").alias("record_id"),
        F.to_json(F.struct(*raw), {"ignoreNullFields": "false"}).alias("raw_record"), "failing_check_name", "error_reason", F.current_timestamp().alias("rejected_at"),
    )


def violations(df: DataFrame, key: str, constraints: Mapping[str, Column]) -> DataFrame:
    """(key, constraint) for each constraint that is not true; null counts as satisfied, as in SQL."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in constraints.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("record_id"), F.explode(broken).alias("constraint_name"))


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "string"
    required: bool = False
    positive: bool = False
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableSpec:
    """What a table's typed rows must satisfy; schema, casts and checks all come from it."""

    name: str
    key: str
    columns: tuple[ColumnSpec, ...] = field(default_factory=tuple)

    def typed(self, values: Column) -> list[Column]:
        """Typed columns out of a map of strings in wire form."""
        out = []
        for c in self.columns:
            v = values[c.name]
            if c.kind == "date":
                v = F.date_add(F.lit("1970-01-01").cast("date"), v.try_cast("int"))
            elif c.kind == "timestamp":
                v = F.timestamp_micros(v.try_cast("long"))
            elif c.kind != "string":
                v = v.try_cast(c.kind)
            out.append(v.alias(c.name))
        return out

    def first_failure(self, is_delete: Column) -> Column:
        """The first failed check in column order; a delete needs its key only."""
        tests = [F.when(~required(F.col(self.key)), F.lit(f"missing_{self.key}"))]
        for c in self.columns:
            x = F.col(c.name)
            if c.required:
                tests.append(F.when(~is_delete & ~required(x), F.lit(f"missing_{c.name}")))
            if c.positive:
                tests.append(F.when(~is_delete & x.isNotNull() & ~positive(x), F.lit(f"not_positive_{c.name}")))
            if c.values:
                tests.append(F.when(~is_delete & x.isNotNull() & ~one_of(x, c.values), F.lit(f"invalid_{c.name}")))
        return F.coalesce(*tests)


def profile(df: DataFrame, needed: Sequence[str] = (), unique: Sequence[str] = (), patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row of batch checks over df in one pass: rows, blanks by field, repeated keys, mismatches, and `passed`."""
    blank = {c: F.count_if(~required(F.col(c))) for c in needed}
    aggs = [F.count("*").alias("n_rows"), *[v.alias(f"blank_{c}") for c, v in blank.items()]]
    ok = F.col("n_rows") > 0
    for c in needed:
        ok = ok & (F.col(f"blank_{c}") == 0)
    if unique:
        aggs.append((F.count("*") - F.count_distinct(F.struct(*unique))).alias("n_repeated"))
        ok = ok & (F.col("n_repeated") == 0)
    for c, p in (patterns or {}).items():
        aggs.append(F.count_if(required(F.col(c)) & ~matches(F.col(c).cast("string"), p)).alias(f"mismatch_{c}"))
        ok = ok & (F.col(f"mismatch_{c}") == 0)
    return df.agg(*aggs).withColumn("passed", ok)
