"""Fixture tests: replace what a pipeline reads by small tables and compare a step's rows with those expected."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from quern.functions.types import parse_type
from quern.operators.inspect import compare, export
from quern.plans.graph import Pipeline
from quern.plans.run import Compiled, infer
from quern.sources.files import read


@dataclass
class Outcome:
    name: str
    passed: bool
    messages: list[str]
    seconds: float


def _typed(v: Any) -> Any:
    if isinstance(v, str):
        for f in (dt.datetime.fromisoformat,):
            try:
                return f(v) if len(v) > 10 else dt.date.fromisoformat(v)
            except ValueError:
                pass
    return v


def fixture(spark: SparkSession, spec: dict[str, Any] | list[dict], base: Path) -> DataFrame:
    """{file: path}, {columns, rows (lists or mappings), types}, or a list of mappings; types not given follow the first value that isn't null."""
    if isinstance(spec, list):
        spec = {"rows": spec}
    if "file" in spec:
        return read(spark, str(base / spec["file"]))
    rows = spec.get("rows") or []
    names = spec.get("columns") or list(dict.fromkeys(k for r in rows for k in r))
    table = [[_typed(r.get(n) if isinstance(r, dict) else r[i]) for i, n in enumerate(names)] for r in rows]
    types = spec.get("types") or {}
    kinds = []
    for i, n in enumerate(names):
        first = next((r[i] for r in table if r[i] is not None), None)
        guess = "boolean" if isinstance(first, bool) else "bigint" if isinstance(first, int) else "double" if isinstance(first, float) else "timestamp_ntz" if isinstance(first, dt.datetime) else "date" if isinstance(first, dt.date) else "string"
        kinds.append(parse_type(types[n]).simpleString() if n in types else guess)
    for r in table:
        for i, k in enumerate(kinds):
            if k == "double" and isinstance(r[i], int):
                r[i] = float(r[i])
    return spark.createDataFrame([tuple(r) for r in table], ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def run_test(spark: SparkSession, pipeline: Pipeline, spec: dict[str, Any], base: Path = Path("."), update: bool = False) -> Outcome:
    """spec: name, target, inputs (by step), expected, and compare's options. update: an expected {file: ...} is written anew instead."""
    began = time.time()
    inputs = {k: fixture(spark, v, base) for k, v in (spec.get("inputs") or {}).items()}
    compiled = None
    try:
        part = infer(spark, pipeline).select([spec["target"]])
        steps = [s if s.name not in inputs else type(s)(name=s.name, kind="source", path="fixture") for s in part.steps.values()]
        compiled = Compiled(spark, Pipeline(steps).select([spec["target"]]), replace=inputs)
        got = compiled.frames[spec["target"]]
        if update and isinstance(spec["expected"], dict) and "file" in spec["expected"]:
            export(got, str(base / spec["expected"]["file"]), single=True)
            return Outcome(spec["name"], True, ["snapshot written"], time.time() - began)
        c = compare(got, fixture(spark, spec["expected"], base), **(spec.get("compare") or {}))
        return Outcome(spec["name"], c.equal, c.messages, time.time() - began)
    except Exception as e:  # noqa: BLE001 - a test that breaks has failed
        return Outcome(spec["name"], False, [f"{type(e).__name__}: {str(e).splitlines()[0]}"], time.time() - began)
    finally:
        if compiled:
            compiled.close()


def run_tests(spark: SparkSession, pipeline: Pipeline, folder: str | Path, tags: list[str] | None = None, targets: list[str] | None = None, update: bool = False) -> list[Outcome]:
    """All tests (of these targets) in *.test.yaml files below a folder; `extends` names another test of the file whose fields are taken where missing."""
    out = []
    for f in sorted(Path(folder).rglob("*.test.y*ml")):
        specs = yaml.safe_load(f.read_text()) or []
        by_name = {s["name"]: s for s in specs}
        for s in specs:
            seen: set[str] = set()
            while (up := s.get("extends")) and up not in seen:
                seen.add(up)
                s = {**by_name[up], **{k: v for k, v in s.items() if k != "extends"}, **({"extends": by_name[up]["extends"]} if "extends" in by_name[up] else {})}
            if not s.get("abstract") and (not tags or set(tags) & set(s.get("tags") or [])) and (not targets or s.get("target") in targets):
                out.append(run_test(spark, pipeline, s, f.parent, update))
    return out
