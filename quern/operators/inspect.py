"""Profiles, differences and comparisons of tables."""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 8


def statistics(df: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each column: rows, nulls, distinct (not null), least and greatest as strings; one pass over df."""
    count = F.count_distinct if exact else F.approx_count_distinct
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))]
    each = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), count(c).alias("distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in cols]
    return df.agg(F.array(*each).alias("a")).select(F.inline("a"))


def profile_numeric(df: DataFrame, column: str, exact: bool = False, bins: int = BINS) -> DataFrame:
    """One row: rows, null_pct, distinct (a null counts as one), least, greatest, mean, median, stddev (population), histogram.

    The median is approximate (to a ten-thousandth of the rows) unless exact, which keeps all values in one task. histogram: rows in each
    of `bins` bins, see histogram().
    """
    c = F.col(column)
    counts = histogram(df, column, bins).agg(F.collect_list(F.struct("bin", "n")).alias("have"))
    per_bin = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.get(F.filter("have", lambda h: h["bin"] == i), F.lit(0))["n"], F.lit(0).cast("long")))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(c.isNull()) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("null_pct"),
        (F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))).cast("long").alias("distinct_count"),
        F.min(c).alias("least"),
        F.max(c).alias("greatest"),
        F.mean(c).alias("mean"),
        (F.median(c) if exact else F.percentile_approx(c, 0.5, 10000)).alias("median"),
        F.stddev_pop(c).alias("stddev"),
    ).join(F.broadcast(counts.select(per_bin.alias("histogram"))))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, n), bins from 0 of equal width over the range; the greatest value is in the last, all equal values in bin 0.

    NULLs, NaN and infinite values are left out.
    """
    kind = dict(df.dtypes)[column]
    value = F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(column)
    some = df.select(value.cast("double").alias("x")).filter("x is not null and not isnan(x) and abs(x) < double('Infinity')")
    ends = some.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))))
    return some.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def profile_string(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, nulls, distinct, least, greatest and mean length."""
    c = F.col(column)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_count"), F.min(F.length(c)).cast("long").alias("least_length"), F.max(F.length(c)).cast("long").alias("greatest_length"), F.mean(F.length(c)).alias("mean_length"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(value, n) of the k commonest values that aren't null; ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def profile_bool(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count_if(c).alias("trues"), F.count_if(~c).alias("falses"), F.count_if(c.isNull()).alias("nulls"))


def profile_temporal(df: DataFrame, column: str) -> DataFrame:
    """One row: nulls, distinct, least, greatest; for the spread, histogram() takes dates and timestamps."""
    c = F.col(column)
    return df.agg(F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_count"), F.min(c).alias("least"), F.max(c).alias("greatest"))


def default_key(df: DataFrame) -> list[str]:
    """A first column named id, or ending in id or key, with unique values that aren't null; else none."""
    named = [c for c in df.columns if c.lower() == "id" or c.lower().endswith(("_id", "id", "key"))][:1]
    if named:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(named[0]).alias("d")).first()
        if r.n == r.d:
            return named
    return []


def diff_positions(left: DataFrame, right: DataFrame, order: list[str]) -> DataFrame:
    """diff() of tables without a key, row by row in a stated order: position (from 0), status, changed.

    Positions are counted within ranges of the order and added up, so no task sees all rows; ties in order are settled by all columns.
    """

    def placed(df: DataFrame) -> DataFrame:
        parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
        by = [*[F.col(c).asc_nulls_last() for c in order], *[F.col(c).cast("string").asc_nulls_last() for c in df.columns if c not in order]]
        rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("m_", F.monotonically_increasing_id()).persist()
        part, within = F.shiftright("m_", 33), F.col("m_").bitwiseAND(F.lit((1 << 33) - 1))
        counts = rows.groupBy(part.alias("p_")).agg(F.count(F.lit(1)).alias("n_"))
        upto = Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
        before = counts.select("p_", F.coalesce(F.sum("n_").over(upto), F.lit(0)).alias("before_"))
        return rows.withColumn("p_", part).join(F.broadcast(before), "p_").withColumn("position", F.col("before_") + within).drop("m_", "p_", "before_")

    return diff(placed(left), placed(right), ["position"])


def diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with status added, removed, changed or unchanged, and the names of changed columns; keys must be unique and are matched NULL-safe."""
    rest = [c for c in left.columns if c not in keys and c in right.columns]
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in [*keys, *rest]], F.lit(True).alias("l_there"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in [*keys, *rest]], F.lit(True).alias("r_there"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), c) for c in rest])) if rest else F.array().cast("array<string>")
    status = F.when(F.col("l_there").isNull(), "added").when(F.col("r_there").isNull(), "removed").when(F.size("changed") > 0, "changed").otherwise("unchanged")
    both = F.when(F.col("l_there") & F.col("r_there"), changed).otherwise(F.array().cast("array<string>"))
    return a.join(b, on, "full").withColumn("changed", both).select(*[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys], status.alias("status"), "changed")


@dataclass
class Comparison:
    equal: bool
    messages: list[str] = field(default_factory=list)


def compare(actual: DataFrame, expected: DataFrame, *, mode: str = "unordered", absolute: float = 1e-9, relative: float = 1e-6, seconds: float = 0, ignore: list[str] | None = None, subset: bool = False, most: int = 20, function: str | Callable | None = None) -> Comparison:
    """Compare small tables (fixtures). exact: with order; unordered; schema_only; custom: by function(actual, expected).

    Numbers are equal within either tolerance, times within `seconds`. subset: only expected's columns count. A custom function ("module:name"
    or itself) returns true or false, a Comparison, or (equal, messages). Both tables are collected: for large ones, use diff().
    """
    if mode == "custom":
        if isinstance(function, str):
            module, _, name = function.replace(":", ".").rpartition(".")
            function = getattr(importlib.import_module(module), name)
        if not callable(function):
            raise ValueError("a custom comparison needs a function")
        got = function(actual, expected)
        return got if isinstance(got, Comparison) else Comparison(bool(got[0]), list(got[1])) if isinstance(got, tuple) else Comparison(bool(got), [] if got else ["the function says they differ"])
    skip = set(ignore or ())
    want = [c for c in expected.columns if c not in skip]
    have = [c for c in actual.columns if c not in skip and (not subset or c in want)]
    if sorted(have) != sorted(want):
        return Comparison(False, [f"columns {sorted(have)}, expected {sorted(want)}"])
    if mode == "schema_only":
        kinds = {f.name: f.dataType.simpleString() for f in actual.schema.fields}
        bad = [f"{f.name}: {kinds[f.name]}, expected {f.dataType.simpleString()}" for f in expected.schema.fields if f.name in want and kinds[f.name] != f.dataType.simpleString()]
        return Comparison(not bad, bad)
    a, b = ([tuple(r) for r in df.select(*want).collect()] for df in (actual, expected))
    if mode == "unordered":
        rank = lambda row: tuple((v is not None, str(type(v)), f"{v:.6e}" if isinstance(v, float) else str(v)) for v in row)
        a, b = sorted(a, key=rank), sorted(b, key=rank)
    out = [] if len(a) == len(b) else [f"{len(a)} rows, expected {len(b)}"]

    def same(x, y) -> bool:
        if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and not isinstance(y, bool):
            return x == y or x != x and y != y or abs(x - y) <= absolute or abs(x - y) <= relative * max(abs(x), abs(y))
        if seconds and isinstance(x, dt.datetime) and isinstance(y, dt.datetime):
            return abs((x - y).total_seconds()) <= seconds
        return x == y

    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        out += [f"row {i}, {c}: {p!r}, expected {q!r}" for c, p, q in zip(want, x, y, strict=True) if not same(p, q)]
    return Comparison(not out, out[:most])


def export(df: DataFrame, path: str, format: str | None = None, single: bool = False) -> None:
    """Write a result as csv, tsv, parquet, json or jsonl (json lines both), by the path's extension if no format is given.

    A folder of files, written side by side; single: one file in it, for small results.
    """
    fmt = format or path.rstrip("/").rpartition(".")[2].lower()
    if fmt not in ("csv", "tsv", "parquet", "json", "jsonl"):
        raise ValueError(f"can't export as {fmt!r}")
    w = (df.coalesce(1) if single else df).write.mode("overwrite")
    if fmt in ("csv", "tsv"):
        w.option("header", "true").option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        w.format("parquet" if fmt == "parquet" else "json").save(path)
