"""Event-time windows; each takes a batch or a streaming DataFrame, streams with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if df.isStreaming and late else df


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates by key and window of a width, with window_start and window_end."""
    return _named(_late(df, time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(*aggregates), keys)


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    return _named(_late(df, time, late).groupBy(F.window(time, width, step).alias("w"), *keys).agg(*aggregates), keys)


def session(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Windows that end when a key has no row for the gap."""
    return _named(_late(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates), keys)


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in ("w", *keys)]
    return df.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)
