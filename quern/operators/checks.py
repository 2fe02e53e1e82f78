"""Nine data-quality checks. All that can be are folded into one aggregation over the data.

A check is a dict: type, severity (error or warning), phase (assertion, before a write; audit, after it) and the type's own settings.
"""

from __future__ import annotations

import datetime as dt
import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("not_null", "unique", "row_count", "accepted_values", "expression", "custom", "schema", "freshness", "relationship")


@dataclass
class Result:
    type: str
    passed: bool
    failing: int
    message: str
    severity: str = "error"
    phase: str = "assertion"


def seconds(age: Any) -> float:
    """90, "90s", "15m", "6h", "2d"."""
    if isinstance(age, (int, float)):
        return float(age)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*", str(age))
    if not m:
        raise ValueError(f"not an age: {age!r}")
    return float(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def _columns(check: dict) -> list[str]:
    return list(check.get("columns") or ([check["column"]] if "column" in check else []))


def run_checks(df: DataFrame, checks: list[dict], *, tables: dict[str, DataFrame] | None = None, now: dt.datetime | None = None) -> list[Result]:
    """Results in the order of checks. tables: what relationship and custom SQL checks refer to; now: the clock, for tests (UTC)."""
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    aggregates: dict[str, Any] = {}
    finish: list[Callable[[Any], Result]] = []

    def agg(expr) -> str:
        aggregates[name := f"a{len(aggregates)}"] = expr
        return name

    for check in checks:
        kind = check["type"]
        rest = {"severity": check.get("severity", "error"), "phase": check.get("phase", "assertion")}

        def result(passed: bool, failing: int, message: str, kind=kind, rest=rest) -> Result:
            return Result(kind, passed, failing, message, **rest)

        missing = [c for c in _columns(check) if c not in df.columns] if kind in ("not_null", "unique", "accepted_values", "freshness", "relationship") else []
        if kind not in TYPES:
            raise ValueError(f"unknown check {kind!r}")
        if missing:
            finish.append(lambda row, m=missing, r=result: r(False, 0, f"no column {', '.join(m)}"))
        elif kind == "not_null":
            names = {c: agg(F.count_if(F.col(c).isNull())) for c in _columns(check)}
            finish.append(lambda row, n=names, r=result: r(not (bad := sum(row[x] for x in n.values())), bad, f"{bad} nulls in {', '.join(n)}"))
        elif kind == "unique":
            names = {c: (agg(F.count(c)), agg(F.count_distinct(c))) for c in _columns(check)}
            finish.append(lambda row, n=names, r=result: r(not (bad := sum(row[a] - row[b] for a, b in n.values())), bad, f"{bad} repeated values in {', '.join(n)}"))
        elif kind == "row_count":
            name, low, high = agg(F.count(F.lit(1))), check.get("min", 0), check.get("max")
            finish.append(lambda row, n=name, lo=low, hi=high, r=result: r(row[n] >= lo and (hi is None or row[n] <= hi), row[n], f"{row[n]} rows"))
        elif kind == "accepted_values":
            (column,) = _columns(check)
            c, values = F.col(column), list(check["values"])
            outside = c.isNotNull() & ~F.coalesce(c.isin(*[v for v in values if v is not None]), F.lit(False))
            name = agg(F.count_if(outside))
            finish.append(lambda row, n=name, c=column, r=result: r(not row[n], row[n], f"{row[n]} rows of {c} with other values"))
        elif kind == "expression":
            text = check.get("expression") or check["sql"]
            name = agg(F.count_if(~F.coalesce(F.expr(text).cast("boolean"), F.lit(False))))
            finish.append(lambda row, n=name, t=text, r=result: r(not row[n], row[n], f"{row[n]} rows where {t} isn't true"))
        elif kind == "freshness":
            (column,) = _columns(check)
            name, limit = agg(F.max(F.col(column).cast("timestamp_ntz"))), seconds(check.get("max_age", check.get("max_age_seconds")))

            def fresh(row, n=name, limit=limit, column=column, r=result) -> Result:
                if row[n] is None:
                    return r(False, 0, f"{column} has no value")
                age = (now - row[n]).total_seconds()
                return r(age <= limit, int(age > limit), f"{column} is {age:.0f} s old")

            finish.append(fresh)
        elif kind == "schema":
            have, want = {f.name: f.dataType.simpleString() for f in df.schema.fields}, dict(check["columns"])
            bad = [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in want.items() if have.get(c) != t]
            finish.append(lambda row, b=bad, r=result: r(not b, len(b), "; ".join(b) or "as declared"))
        elif kind == "relationship":
            (column,) = _columns(check)
            other, key = (tables or {})[check["to"]], check.get("field", column)
            left = df.select(F.col(column).alias("k")).filter("k is not null")
            n = left.join(other.select(F.col(key).alias("k")).distinct(), "k", "left_anti").count()
            finish.append(lambda row, n=n, c=column, t=check["to"], r=result: r(not n, n, f"{n} rows of {c} not in {t}"))
        elif check.get("function"):
            f = check["function"]
            if isinstance(f, str):
                module, _, attribute = f.replace(":", ".").rpartition(".")
                f = getattr(importlib.import_module(module), attribute)
            got = f(df)
            passed, message = (got, "") if isinstance(got, bool) else (bool(got["passed"]), str(got.get("message", ""))) if isinstance(got, dict) else (bool(got.passed), str(getattr(got, "message", "")))
            finish.append(lambda row, p=passed, m=message, r=result: r(p, int(not p), m))
        else:
            n = df.sparkSession.sql(check["sql"], **{"this": df, **(tables or {})}).count()
            finish.append(lambda row, n=n, r=result: r(not n, n, f"the query returned {n} rows"))
    row = df.agg(*[e.alias(n) for n, e in aggregates.items()]).first() if aggregates else None
    return [f(row) for f in finish]
