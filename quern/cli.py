"""python -m quern.cli COMMAND FOLDER [...], on a folder of declarations.

compile    steps and their columns                       run        write the sinks
test       fixture tests                                 query      the rows of SQL over steps and catalogs
profile    of a step's columns                           diff       of two steps, by --key or the rows' order
export     a step's rows to a file                       lineage    of a step's columns, and what is made of one (--column)
catalog    list, describe TABLE, search TEXT, test       watermark  list, set NAME VALUE, reset NAME (FOLDER: the marks' file)
doctor     what is wrong with a project                  init       a new project
repl       SQL statements from standard input, each ended by a semicolon; .steps, .schema STEP, .quit
"""

from __future__ import annotations

import argparse
import json
import sys
import warnings
from pathlib import Path

from quern.plans.graph import PipelineError

COMMANDS = ("compile", "run", "test", "query", "profile", "diff", "export", "lineage", "catalog", "watermark", "doctor", "init", "repl")
FIRST = {
    "profiles.yaml": "default:\n  default: files\n  catalogs:\n    files: {type: filesystem, path: data}\n",
    "steps/orders.yaml": "- {name: orders, kind: source, path: ../data/orders.csv}\n- {name: totals_out, kind: sink, upstream: [totals], path: ../out/totals}\n",
    "steps/totals.sql": "-- quern:assert: not_null(id)\nSELECT id, sum(amount) AS amount FROM orders GROUP BY id\n",
    "data/orders.csv": "id,amount\n1,10\n1,5\n2,7\n",
    "tests/totals.test.yaml": "- name: sums by id\n  target: totals\n  inputs: {orders: [{id: 1, amount: 2}, {id: 1, amount: 3}]}\n  expected: [{id: 1, amount: 5}]\n",
}


def shown(df, how: str, limit: int) -> None:
    """limit rows as a table, csv or JSON lines, and whether there are more."""
    rows = df.limit(limit + 1).collect()
    if how == "json":
        for r in rows[:limit]:
            print(json.dumps(r.asDict(recursive=True), default=str))
    elif how == "csv":
        import csv

        w = csv.writer(sys.stdout)
        w.writerow(df.columns)
        w.writerows(rows[:limit])
    else:
        cells = [df.columns, *[["NULL" if v is None else str(v) for v in r] for r in rows[:limit]]]
        widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
        for r in cells:
            print("  ".join(v.ljust(n) for v, n in zip(r, widths, strict=True)).rstrip())
    if len(rows) > limit:
        print(f"... more than {limit} rows", file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("folder")
    p.add_argument("rest", nargs="*")
    p.add_argument("--sink", action="append")
    p.add_argument("--tag", action="append")
    p.add_argument("--all-tags", action="store_true")
    p.add_argument("--keep-going", action="store_true")
    p.add_argument("--target", action="append", help="test: only tests of this step")
    p.add_argument("--update-snapshots", action="store_true")
    p.add_argument("--profile")
    p.add_argument("--catalog")
    p.add_argument("--marks", help="run: the file of marks")
    p.add_argument("--key", action="append")
    p.add_argument("--column")
    p.add_argument("--format", choices=["table", "csv", "json"], default="table")
    p.add_argument("--limit", type=int, default=100)
    return p


def watermark(spark, a) -> int:
    from quern.operators.watermark import Marks

    marks = Marks(a.folder, spark)
    if a.rest[:1] == ["set"] and len(a.rest) == 3:
        marks.set(a.rest[1], a.rest[2])
    elif a.rest[:1] == ["reset"] and len(a.rest) == 2:
        marks.reset(a.rest[1])
    elif a.rest not in ([], ["list"]):
        return 10
    for k, v in marks.all().items():
        print(k, v["value"], v["type"])
    return 0


def init(folder: str) -> int:
    root = Path(folder)
    if root.exists() and any(root.iterdir()):
        print(f"{folder} isn't empty", file=sys.stderr)
        return 10
    for name, text in FIRST.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    print(*FIRST, sep="\n")
    return 0


def doctor(spark, a, catalogs, pipeline_of, said) -> int:
    bad = [str(w.message) for w in said]
    for name in catalogs.specs:
        if why := catalogs.test(name):
            bad.append(f"catalog {name}: {why}")
    try:
        from quern.plans.run import Compiled

        Compiled(spark, pipeline_of(), catalogs=catalogs).close()
    except PipelineError as e:
        bad.append(str(e))
    print(*(bad or ["nothing found"]), sep="\n")
    return 1 if bad else 0


def catalog(a, catalogs) -> int:
    what, *rest = a.rest or ["list"]
    if what == "list" and not rest:
        for name in [a.catalog] if a.catalog else catalogs.specs:
            print(name, catalogs.spec(name)["type"], *catalogs.tables(name))
    elif what == "describe" and len(rest) == 1:
        for k, v in catalogs.metadata(a.catalog or catalogs.default, rest[0]).items():
            print(k, *(f"{c} {t}" for c, t in v) if k == "columns" else [v], sep="  ")
    elif what == "search" and len(rest) == 1:
        for s, c, t in catalogs.search(rest[0]):
            print(f"{s:.2f}", f"{c}.{t}")
    elif what == "test" and not rest:
        bad = {n: why for n in catalogs.specs if (why := catalogs.test(n))}
        for n in catalogs.specs:
            print(n, bad.get(n, "ok"))
        return 1 if bad else 0
    else:
        return 10
    return 0


def ask(compiled, catalogs, text: str):
    """The rows of SQL whose names are steps or tables of catalogs."""
    from quern.plans.sql import tables

    for name in tables(compiled.spark, text):
        found = catalogs.resolve(name, compiled.frames)
        if found.kind == "table" and found.catalog in catalogs.specs and catalogs.specs[found.catalog]["type"] != "spark" and "." not in name:
            compiled.moved_view(name, catalogs.read(found.catalog, found.name))
    return compiled.spark.sql(text.strip().rstrip(";"))


def repl(compiled, catalogs, a) -> int:
    held = ""
    for line in sys.stdin:
        word = line.split()
        if not held and word and word[0].startswith("."):
            if word[0] == ".quit":
                break
            if word[0] == ".steps":
                print(*compiled.frames, sep="\n")
            elif word[0] == ".schema" and len(word) == 2 and word[1] in compiled.frames:
                print(compiled.frames[word[1]].schema.simpleString())
            else:
                print(f"not understood: {line.strip()}")
            continue
        held += line
        if held.rstrip().endswith(";"):
            try:
                shown(ask(compiled, catalogs, held), a.format, a.limit)
            except Exception as e:  # noqa: BLE001 - shown to the user, who goes on
                print(str(e).splitlines()[0])
            held = ""
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 10
    if a.command == "init":
        return init(a.folder)
    from pyspark.sql import SparkSession

    from quern.operators import inspect as look
    from quern.plans.declare import load, load_profile
    from quern.plans.run import EXIT_CODES, Compiled, infer, run
    from quern.plans.testing import run_tests
    from quern.sources.catalogs import Catalogs

    spark = SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    compiled = None
    try:
        if a.command == "watermark":
            return watermark(spark, a)
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            profile = load_profile(a.folder, a.profile)
        specs = {k: v | ({"path": str(Path(a.folder) / v["path"])} if v.get("type") == "filesystem" and "://" not in v["path"] and not v["path"].startswith("/") else {}) for k, v in (profile.get("catalogs") or {}).items()}
        catalogs = Catalogs(spark, {"spark": {"type": "spark"}, **specs}, profile.get("default", "spark"))
        if a.command == "doctor":
            return doctor(spark, a, catalogs, lambda: load(a.folder), said)
        for w in said:
            print(f"warning: {w.message}", file=sys.stderr)
        if a.command == "catalog":
            return catalog(a, catalogs)
        pipeline = load(a.folder)
        if a.command == "test":
            found = run_tests(spark, pipeline, a.folder, a.tag, a.target, a.update_snapshots)
            for o in found:
                print("PASS" if o.passed else "FAIL", o.name, f"{o.seconds:.2f} s", *o.messages[:5], sep="  ")
            return EXIT_CODES["ok" if all(o.passed for o in found) else "test"]
        if a.command == "run":
            from quern.operators.watermark import Marks

            report = run(spark, pipeline, sinks=a.sink, tags=a.tag, match_all=a.all_tags, fail_fast=not a.keep_going, catalogs=catalogs, marks=Marks(a.marks, spark) if a.marks else None)
            for s in report.steps:
                print(s.status, s.name, f"{s.seconds:.2f} s", s.rows if s.rows is not None else "", s.error or "", *[c.message for c in s.checks if not c.passed], sep="  ")
            return report.exit_code
        compiled = Compiled(spark, infer(spark, pipeline).select(a.sink, a.tag, a.all_tags), catalogs=catalogs)
        frames = compiled.frames
        need = {"query": 1, "profile": 1, "diff": 2, "export": 2, "lineage": 1}.get(a.command, 0)
        if len(a.rest) != need or a.command in ("profile", "lineage") and a.rest[0] not in frames or a.command == "export" and a.rest[0] not in frames or a.command == "diff" and not set(a.rest) <= set(frames):
            print(f"{a.command}: {need} arguments are wanted, steps by name", file=sys.stderr)
            return EXIT_CODES["usage"]
        if a.command == "query":
            shown(ask(compiled, catalogs, a.rest[0]), a.format, a.limit)
        elif a.command == "profile":
            shown(look.statistics(frames[a.rest[0]]), a.format, a.limit)
        elif a.command == "diff":
            left, right = (frames[n] for n in a.rest)
            keys = a.key or look.default_key(left)
            shown((look.diff(left, right, keys) if keys else look.diff_positions(left, right, left.columns)).filter("status <> 'unchanged'"), a.format, a.limit)
        elif a.command == "export":
            look.export(frames[a.rest[0]], a.rest[1])
        elif a.command == "lineage":
            if a.column:
                print(*(f"{s}.{c}" for s, c in compiled.impact(a.rest[0], a.column)), sep="\n")
            for o in compiled.lineage(a.rest[0]):
                if a.column in (None, o.column):
                    print(o.column, o.kind, *(f"{t}.{c}" for t, c in o.origins))
        elif a.command == "repl":
            return repl(compiled, catalogs, a)
        else:
            for name, df in frames.items():
                print(name, compiled.pipeline.steps[name].kind, df.schema.simpleString(), sep="  ")
        return 0
    except PipelineError as e:
        print(e, file=sys.stderr)
        return EXIT_CODES["error"]
    except KeyboardInterrupt:
        return EXIT_CODES["interrupted"]
    finally:
        if compiled:
            compiled.close()


if __name__ == "__main__":
    sys.exit(main())
