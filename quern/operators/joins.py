"""Joins that Spark has no keyword for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, on: str, by: list[str] | None = None, values: list[str], tolerance: float | None = None, slice_width: float | None = None) -> DataFrame:
    """left with, for each row, `values` of the latest right row with right.on <= left.on in the same `by` group (else NULL).

    One union and one window, so the work is a sort by (by, on) however many rows match; of right rows at the same time the last by
    values wins. Without `by`, or with hot groups, give slice_width (seconds, or units of a numeric `on`): groups are cut into slices of
    it, each its own task's work, and the last match of earlier slices, a row for each group and slice, is carried over.
    tolerance: the greatest difference in seconds (or units of a numeric `on`).
    """
    by = by or []
    mine = left.columns
    timed = dict(left.dtypes)[on].startswith(("timestamp", "date"))

    def number(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) / 1e6 if timed else c

    payload = F.struct(F.col(on).alias("on_"), *[F.col(v).alias(v) for v in values])
    a = left.select(*[F.col(c) for c in mine], F.lit(1).alias("side_"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("match_"))
    b = right.select(*[(F.col(c) if c in by or c == on else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in mine], F.lit(0).alias("side_"), payload.alias("match_"))
    groups = [F.col(c) for c in by]
    both = a.unionByName(b)
    if slice_width is not None:
        both = both.withColumn("slice_", F.floor(number(F.col(on)) / slice_width).cast("long"))
        groups.append(F.col("slice_"))
    w = Window.partitionBy(*groups).orderBy(F.col(on).asc_nulls_first(), F.col("side_"), F.col("match_")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("match_", F.last("match_", ignorenulls=True).over(w)).filter("side_ = 1")
    if slice_width is not None:
        last = both.filter(F.col(on).isNotNull()).groupBy(*groups).agg(F.max(F.when(F.col("side_") == 0, F.col("match_"))).alias("last_"))
        earlier = Window.partitionBy(*[F.col(c) for c in by]).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.withColumn("last_", F.last("last_", ignorenulls=True).over(earlier)).select(*[F.col(c).alias(f"k_{c}") for c in [*by, "slice_"]], "last_")
        same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in [*by, "slice_"]]
        out = out.join(carried, same, "left").withColumn("match_", F.coalesce("match_", "last_"))
    ok = F.col(on).isNotNull() & F.col("match_").isNotNull()
    if tolerance is not None:
        ok = ok & (number(F.col(on)) - number(F.col("match_.on_")) <= tolerance)
    return out.select(*mine, *[F.when(ok, F.col(f"match_.{v}")).alias(v if v not in mine else f"right_{v}") for v in values])


def range_join(points: DataFrame, ranges: DataFrame, *, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= point <= high, joined on buckets instead of all pairs.

    Buckets of `width` (about a usual range's length) are for ranges up to that length, those of twice the width for ranges up to twice,
    and so on, so that each range, however long, goes to three buckets at most, and each point to one for each length class there is
    (64 at most). point, low and high are numbers; rows with NULLs match nothing.
    """
    length = F.col(high) - F.col(low)
    level = F.when(length <= width, 0).otherwise(F.ceil(F.log2(length / width))).cast("int")
    r = ranges.filter(F.col(low) <= F.col(high)).withColumn("level_", level)
    levels = sorted(x.level_ for x in r.select("level_").distinct().collect())
    wide = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("level_"))
    bucket = lambda c: F.floor(F.col(c) / wide).cast("long")
    r = r.withColumn("bucket_", F.explode(F.sequence(bucket(low), bucket(high))))
    p = points.withColumn("level_", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("bucket_", bucket(point))
    return p.join(r, ["level_", "bucket_"]).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("level_", "bucket_")
