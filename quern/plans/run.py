"""Compile and run a pipeline: steps become lazy DataFrames, views of a session of their own, and sinks are the only actions."""

from __future__ import annotations

import datetime as dt
import importlib
import inspect
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.operators.checks import Result, run_checks
from quern.operators.watermark import Marks
from quern.operators.write import Files, Target, write_to
from quern.plans.graph import Pipeline, PipelineError, Step
from quern.plans.sql import depends, lineage, parse, tables
from quern.sources.catalogs import Catalogs
from quern.sources.files import read

#: Fixed values.
EXIT_CODES = {"ok": 0, "error": 1, "partial": 2, "test": 3, "assertion": 4, "audit": 5, "usage": 10, "interrupted": 130}


@dataclass
class Context:
    """What a Python step may ask for by annotating a parameter with it."""

    spark: SparkSession
    step: Step
    now: dt.datetime


@dataclass
class StepReport:
    name: str
    status: str  # ok, failed, skipped
    seconds: float = 0.0
    rows: int | None = None
    phases: dict[str, float] = field(default_factory=dict)  # seconds of checks before, write, checks after
    checks: list[Result] = field(default_factory=list)
    error: str | None = None


@dataclass
class Report:
    steps: list[StepReport] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        found = [(c, s) for s in self.steps for c in s.checks if not c.passed and c.severity == "error"]
        if any(c.phase == "assertion" for c, _ in found):
            return EXIT_CODES["assertion"]
        if found:
            return EXIT_CODES["audit"]
        failed = [s for s in self.steps if s.status != "ok"]
        return EXIT_CODES["ok"] if not failed else EXIT_CODES["partial"] if any(s.status == "ok" for s in self.steps) else EXIT_CODES["error"]


def load_function(ref: Any):
    if callable(ref):
        return ref
    module, _, name = str(ref).replace(":", ".").rpartition(".")
    try:
        f = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise PipelineError("NO_FUNCTION", f"{ref}: {e}") from None
    if not callable(f):
        raise PipelineError("NO_FUNCTION", f"{ref} can't be called")
    return f


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings, sources and tables, but views of its own, so that names of steps hide no one's views."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def moved(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same plan in another session."""
    if df.sparkSession is spark:
        return df
    jvm = spark.sparkContext._jvm
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.logicalPlan()), spark)


class Compiled:
    """Frames by step. Each step keeps its own plan, so asking for a step in the middle gives that step's rows.

    catalogs: what steps with a table read from and write to; its default is Spark's own catalog. marks: of sources with a watermark.
    """

    def __init__(self, spark: SparkSession, pipeline: Pipeline, now: dt.datetime | None = None, replace: dict[str, DataFrame] | None = None, catalogs: Catalogs | None = None, marks: Marks | None = None):
        self.user, self.spark = spark, own_session(spark)
        self.pipeline, self.now = infer(self.spark, pipeline), now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        self.catalogs, self.marks, self.next_marks = catalogs or Catalogs(spark, {"spark": {"type": "spark"}}, "spark"), marks, {}
        self.frames: dict[str, DataFrame] = {}
        self.held: list[DataFrame] = []
        readers = self.pipeline.readers()
        for name in self.pipeline.order():
            step = self.pipeline.steps[name]
            df = (replace or {}).get(name)
            if df is None:
                df = self._frame(step)
            df = moved(df, self.spark)
            if step.kind != "sink":
                # Rows that checks look at and others read are worked out once.
                if step.eager or step.kind != "source" and len(readers[name]) > 1 or step.checks and readers[name]:
                    df = df.persist()
                    self.held.append(df)
                df.createOrReplaceTempView(name)
            self.frames[name] = df

    def _frame(self, step: Step) -> DataFrame:
        try:
            if step.kind == "source":
                df = self.catalogs.read(step.catalog, step.table, step.format, **step.options) if step.table else read(self.spark, step.path, step.format, **step.options)
                if step.watermark and self.marks is not None:
                    if step.watermark not in df.columns:
                        raise PipelineError("NO_COLUMN", f"{step.name}: {step.watermark}")
                    df, mark = self.marks.batch(df, step.name, step.watermark)
                    if mark is not None:
                        self.next_marks[step.name] = mark
                known = set(df.columns)
                if step.filter:
                    df = df.filter(step.filter)
                if step.columns:
                    plain = [c for c in step.columns if isinstance(c, str) and c not in known]
                    if plain:
                        raise PipelineError("NO_COLUMN", f"{step.name}: {', '.join(plain)}")
                    df = df.select(*[F.col(f"`{c}`") if isinstance(c, str) else F.expr(next(iter(c.values()))).alias(next(iter(c))) for c in step.columns])
                return df if step.limit is None else df.limit(step.limit)
            if step.kind == "sql":
                parse(self.spark, step.sql)
                return self.spark.sql(step.sql.strip().rstrip(";"), **{})
            if step.kind == "python":
                return self._python(step)
            (up,) = step.upstream[:1]
            df = self.frames[up]
            for other in step.upstream[1:]:
                df = df.unionByName(self.frames[other])
            return df
        except PipelineError:
            raise
        except Exception as e:
            raise PipelineError("BAD_STEP", f"{step.name}: {str(e).splitlines()[0]}") from e

    def _python(self, step: Step) -> DataFrame:
        f = load_function(step.function)
        kwargs = {n: Context(self.spark, step, self.now) for n, p in inspect.signature(f).parameters.items() if p.annotation in (Context, "Context")}
        inputs = {u: self.frames[u] for u in step.upstream}
        out = f(*([next(iter(inputs.values()))] if len(inputs) == 1 else [inputs] if inputs else []), **kwargs)
        if inspect.isawaitable(out):
            import asyncio

            out = asyncio.run(_await(out))
        if isinstance(out, DataFrame):
            return out
        if out is None:
            raise PipelineError("NO_RESULT", f"{step.name} returned nothing")
        return self.spark.createDataFrame(out)  # pandas, Arrow, rows

    def target(self, step: Step) -> Target:
        by = (step.strategy_options or {}).get("partition_by")
        if step.table:
            return self.catalogs.target(step.catalog, step.table, step.format, step.options, by)
        return Files(self.spark, step.path, step.format or "parquet", dict(step.options), list(by or []))

    def moved_view(self, name: str, df: DataFrame) -> None:
        """A view of this pipeline's session besides its steps'."""
        moved(df, self.spark).createOrReplaceTempView(name)

    def lineage(self, name: str):
        return lineage(self.frames[name])

    def impact(self, name: str, column: str) -> list[tuple[str, str]]:
        """(step, column) of all columns downstream that are made of this one."""
        readers, todo, seen = self.pipeline.readers(), [name], set()
        while todo:
            todo += [r for r in readers[todo.pop(0)] if r not in seen and not seen.add(r)]
        return [(s, c) for s in self.pipeline.order() if s in seen for c in depends(self.frames[s], self.frames[name], column)]

    def close(self) -> None:
        for df in self.held:
            df.unpersist()
        for name, s in self.pipeline.steps.items():
            if s.kind != "sink":
                self.spark.catalog.dropTempView(name)


async def _await(x):
    return await x


def infer(spark: SparkSession, pipeline: Pipeline) -> Pipeline:
    """SQL steps without stated upstream read the steps whose names they use."""
    out = []
    for s in pipeline.steps.values():
        if s.kind == "sql" and not s.upstream:
            s = Step(**{**s.__dict__, "upstream": [t for t in tables(spark, s.sql) if t in pipeline.steps and t != s.name]})
        out.append(s)
    return Pipeline(out)


def run(spark: SparkSession, pipeline: Pipeline, *, sinks: list[str] | None = None, tags: list[str] | None = None, match_all: bool = False, fail_fast: bool = True, workers: int = 4, now: dt.datetime | None = None, catalogs: Catalogs | None = None, marks: Marks | None = None) -> Report:
    """Run the selected sinks, up to `workers` at a time, checks on inner steps first. fail_fast: a failure skips sinks not yet begun.

    A source's mark moves on once all sinks that read it, in the whole pipeline, have been written.
    """
    whole = infer(spark, pipeline)
    compiled = Compiled(spark, whole.select(sinks, tags, match_all), now, catalogs=catalogs, marks=marks)
    report, broken = Report(), set()
    try:
        for name in compiled.pipeline.order():
            step = compiled.pipeline.steps[name]
            if step.kind == "sink" or not step.checks:
                continue
            r = StepReport(name, "ok", checks=run_checks(compiled.frames[name], step.checks, tables=compiled.frames, now=compiled.now))
            if any(not c.passed and c.severity == "error" for c in r.checks):
                r.status = "failed"
                broken.add(name)
            report.steps.append(r)

        stop = [bool(broken) and fail_fast]

        def blocked(name: str) -> bool:
            return any(u in broken or blocked(u) for u in compiled.pipeline.steps[name].upstream)

        def one(name: str) -> StepReport:
            if stop[0] or blocked(name):
                return StepReport(name, "skipped")
            r = _sink(compiled, compiled.pipeline.steps[name])
            stop[0] = stop[0] or fail_fast and r.status == "failed"
            return r

        names = [n for n in compiled.pipeline.order() if compiled.pipeline.steps[n].kind == "sink"]
        with ThreadPoolExecutor(max(1, workers)) as pool:
            report.steps += list(pool.map(one, names))
        done = {s.name for s in report.steps if s.status == "ok"}
        for name, (value, kind) in compiled.next_marks.items():
            need = {n for n, s in whole.steps.items() if s.kind == "sink" and name in whole.select([n]).steps}
            if need <= done:
                marks.set(name, value, kind)
    finally:
        compiled.close()
    return report


def _sink(compiled: Compiled, step: Step) -> StepReport:
    began, r, df = time.time(), StepReport(step.name, "ok"), compiled.frames[step.name]
    bad = lambda: any(not c.passed and c.severity == "error" for c in r.checks)
    held = None
    try:
        before = [c for c in step.checks if c.get("phase", "assertion") == "assertion"]
        if before:
            df = held = df.persist()
            r.checks = run_checks(df, before, tables=compiled.frames, now=compiled.now)
            r.phases["assertions"] = time.time() - began
            if bad():
                r.status = "failed"
                return r
        seen = Observation(f"rows_{step.name}_{time.time_ns()}")
        o = {k: v for k, v in step.strategy_options.items() if k != "partition_by"}
        if step.strategy == "scd2":
            o.setdefault("at", compiled.now)
        to, wrote = compiled.target(step), time.time()
        # rows: those that came to the sink; strategies that read their source several times get it worked out once.
        once = step.strategy in ("append", "replace", "partition") and isinstance(to, Files)
        if not once and held is None:
            df = held = df.persist()
        write_to(df.observe(seen, F.count(F.lit(1)).alias("n")) if once else df, to, step.strategy, **o)
        r.phases["write"] = time.time() - wrote
        r.rows = seen.get["n"] if once else df.count()
        after = [c for c in step.checks if c.get("phase") == "audit"]
        if after:
            wrote = time.time()
            r.checks += run_checks(to.read(), after, tables=compiled.frames, now=compiled.now)
            r.phases["audits"] = time.time() - wrote
            if bad():
                r.status = "failed"
    except Exception as e:  # noqa: BLE001 - a sink's failure is part of the report
        r.status, r.error = "failed", str(e)
    finally:
        if held is not None:
            held.unpersist()
        r.seconds = time.time() - began
    return r
