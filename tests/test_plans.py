import textwrap

import pytest

from quern import cli
from quern.operators.watermark import Marks
from quern.plans.declare import load, load_profile, parse_check, plain_credentials
from quern.plans.graph import Pipeline, PipelineError, Step
from quern.plans.run import Compiled, Context, run
from quern.plans.sql import tables
from quern.plans.testing import run_test
from quern.sources.catalogs import Cache, CatalogError, Catalogs, Reference, fits, jdbc_options


def code(f):
    with pytest.raises(PipelineError) as e:
        f()
    return e.value.code


def test_graph_errors():
    s = lambda n, k="sql", *up: Step(n, k, list(up), sql="select 1")
    assert code(lambda: Pipeline([s("a"), s("a")])) == "DUPLICATE_NAME"
    assert code(lambda: Pipeline([s("a", "sql", "b")])) == "UNKNOWN_UPSTREAM"
    assert code(lambda: Pipeline([s("b"), s("a", "source", "b")])) == "SOURCE_WITH_UPSTREAM"
    assert code(lambda: Pipeline([s("a", "sink")])) == "SINK_WITHOUT_UPSTREAM"
    assert code(lambda: Pipeline([s("a", "sql", "b"), s("b", "sql", "a")])) == "CYCLE"
    p = Pipeline([s("c", "sql", "a"), s("b"), s("a"), s("d", "sql", "b")])
    assert p.order() == ["a", "b", "c", "d"] and list(p.select(["c"]).steps) == ["c", "a"]


def test_sql_guard_and_tables(spark):
    assert tables(spark, "WITH x AS (SELECT * FROM a) SELECT * FROM x JOIN b ON 1 = 1 WHERE EXISTS (SELECT 1 FROM c)") == ["a", "b", "c"]
    for text, want in (("", "EMPTY_SQL"), ("DROP TABLE x", "NOT_A_QUERY"), ("INSERT INTO t SELECT 1", "NOT_A_QUERY"), ("SELEC 1", "BAD_SQL")):
        assert code(lambda t=text: tables(spark, t)) == want


@pytest.fixture
def project(tmp_path):
    (tmp_path / "orders.csv").write_text("id,amount\n1,10\n2,-5\n3,0\n4,7\n5,30\n")
    (tmp_path / "p.yaml").write_text(textwrap.dedent("""
        - {name: orders, kind: source, path: orders.csv}
        - {name: out, kind: sink, upstream: [big], path: "${OUT:-out}", checks: ["not_null(id)"], audits: ["row_count(min=1)"], tags: [daily]}
    """))
    (tmp_path / "big.sql").write_text("-- quern: {checks: ['expression(amount > 0)']}\nSELECT id, amount FROM orders WHERE amount > 0")
    return tmp_path


def test_project(spark, project):
    p = load(project)
    r = run(spark, p)
    assert r.exit_code == 0 and r.steps[-1].rows == 3
    assert spark.read.parquet(str(project / "out")).count() == 3
    o = run_test(spark, p, {"name": "t", "target": "big", "inputs": {"orders": [{"id": 1, "amount": 4}, {"id": 2, "amount": -4}]}, "expected": [{"id": 1, "amount": 4}]})
    assert o.passed, o.messages


def test_failed_check_stops_the_write(spark, project):
    (project / "big.sql").write_text("-- quern: {checks: ['expression(amount > 8)']}\nSELECT id, amount FROM orders WHERE amount > 0")
    r = run(spark, load(project))
    assert r.exit_code == 4 and not (project / "out").exists()


def test_lineage_and_rewrites(spark):
    a = spark.createDataFrame([(1, 2.0, "x")], "id int, v double, s string")
    p = Pipeline([Step("a", "source", path="x"), Step("b", "sql", sql="SELECT id, v AS w, v + id AS both, sum(v) OVER (PARTITION BY s) AS t, 1 AS one FROM a ORDER BY id LIMIT 3")])
    c = Compiled(spark, p, replace={"a": a})
    assert {o.column: o.kind for o in c.lineage("b")} == {"id": "direct", "w": "renamed", "both": "multi_column", "t": "window", "one": "literal"}
    c.close()


def test_check_grammar():
    assert parse_check("accepted_values(column=s, values=[a, b])") == {"type": "accepted_values", "column": "s", "values": ["a", "b"]}
    assert parse_check("unique(a, b)") == {"type": "unique", "columns": ["a", "b"]}


def test_quality_files(spark, project):
    (project / "big.quality.yaml").write_text("- not_null(id)\n- {type: row_count, max: 2, severity: warning}\n")
    (project / "quality").mkdir()
    (project / "quality" / "any.yaml").write_text("step: out\nassertions: ['unique(id)']\naudits: [{type: row_count, min: 100}]\n")
    (project / "big.sql").write_text("-- quern:assert: accepted_values(column=id, values=[1, 4, 5])\nSELECT id, amount FROM orders WHERE amount > 0")
    p = load(project)
    assert [(c["type"], c["phase"]) for c in p.steps["big"].checks] == [("accepted_values", "assertion"), ("not_null", "assertion"), ("row_count", "assertion")]
    r = run(spark, p)
    assert r.exit_code == 5 and [c.passed for c in r.steps[0].checks] == [True, True, False] and (project / "out").exists()
    (project / "quality" / "any.yaml").write_text("step: nothing\nassertions: []\n")
    assert code(lambda: load(project)) == "UNKNOWN_STEP"
    (project / "quality" / "any.yaml").write_text("step: out\nother: []\n")
    assert code(lambda: load(project)) == "BAD_CHECK"


def test_profiles(tmp_path):
    (tmp_path / "home" / ".quern").mkdir(parents=True)
    (tmp_path / "home" / ".quern" / "profiles.yaml").write_text("dev: {default: a, catalogs: {a: {type: jdbc, url: u, password: plain}, b: {type: memory}}}\n")
    (tmp_path / "profiles.yaml").write_text("dev: {catalogs: {a: {url: '${URL}'}, c: {type: spark}}}\nprod: {}\n")
    with pytest.warns(UserWarning, match="catalogs.a.password"):
        got = load_profile(tmp_path, "dev", {"URL": "x"}, tmp_path / "home")
    assert got == {"default": "a", "catalogs": {"a": {"type": "jdbc", "url": "x", "password": "plain"}, "b": {"type": "memory"}, "c": {"type": "spark"}}}
    assert code(lambda: load_profile(tmp_path, "none", {}, tmp_path / "home")) == "NO_PROFILE"
    assert plain_credentials({"api_key": "${K}", "x": [{"token": "t"}]}) == ["x[0].token"]


def test_views_of_the_user_stay(spark):
    spark.range(3).createOrReplaceTempView("a")
    p = Pipeline([Step("a", "source", path="x"), Step("b", "sql", sql="SELECT id + 1 AS id FROM a")])
    one, two = (Compiled(spark, p, replace={"a": spark.range(n)}) for n in (5, 7))
    assert (one.frames["b"].count(), two.frames["b"].count(), spark.table("a").count()) == (5, 7, 3)
    assert one.frames["b"].join(spark.table("a"), "id").count() == 2
    one.close()
    two.close()
    assert spark.table("a").count() == 3
    spark.catalog.dropTempView("a")


async def later(df):
    return df.filter("id > 1")


def test_python_steps(spark):
    def joined(frames, ctx: Context):
        return frames["a"].crossJoin(frames["b"].limit(1)).select("x", "id").toPandas().assign(step=ctx.step.name)

    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.range(4)
    p = Pipeline([Step("a", "source", path="x"), Step("b", "source", path="x"), Step("c", "python", ["a", "b"], function=joined), Step("d", "python", ["b"], function=later), Step("e", "python", ["b"], function=lambda df: [(1, "r")])])
    c = Compiled(spark, p, replace={"a": a, "b": b})
    assert sorted(c.frames["c"].columns) == ["id", "step", "x"] and c.frames["c"].count() == 2 and c.frames["d"].count() == 2 and c.frames["e"].count() == 1
    c.close()
    for f, want in ((lambda df: None, "NO_RESULT"), ("no.such.function", "NO_FUNCTION")):
        assert code(lambda f=f: Compiled(spark, Pipeline([Step("b", "source", path="x"), Step("d", "python", ["b"], function=f)]), replace={"b": b})) == want


def test_marks_wait_for_all_sinks(spark, tmp_path):
    c, marks = Catalogs(spark, {"m": {"type": "memory"}}, "m"), Marks(f"file://{tmp_path}/x/marks.json", spark)
    c.stores["m"] = {"t": spark.range(5)}
    steps = [Step("t", "source", table="t", watermark="id"), Step("one", "sink", ["t"], path=str(tmp_path / "one"), strategy="append"), Step("two", "sink", ["t"], path=str(tmp_path / "two"), strategy="append", checks=[{"type": "row_count", "max": 1}])]
    assert run(spark, Pipeline(steps), catalogs=c, marks=marks, fail_fast=False).exit_code == 4 and marks.get("t") is None
    assert run(spark, Pipeline(steps), sinks=["one"], catalogs=c, marks=marks).exit_code == 0 and marks.get("t") is None
    steps[2].checks = []
    assert run(spark, Pipeline(steps), catalogs=c, marks=marks).exit_code == 0 and marks.get("t") == "4"
    c.stores["m"]["t"] = spark.range(8)
    r = run(spark, Pipeline(steps), catalogs=c, marks=marks)
    assert {s.name: s.rows for s in r.steps} == {"one": 3, "two": 3} and marks.get("t") == "7"


def test_catalogs(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "numbers"))
    (tmp_path / "people.csv").write_text("id,name\n1,a\n")
    c = Catalogs(spark, {"f": {"type": "filesystem", "path": str(tmp_path)}, "s": {"type": "spark"}, "m": {"type": "memory"}, "gone": {"type": "filesystem", "path": str(tmp_path / "no")}}, "f")
    assert c.tables("f") == ["numbers", "people"] and c.columns("f", "people") == [("id", "int"), ("name", "string")]
    about, mark = c.metadata("f", "numbers"), c.fingerprint("f", "numbers")
    assert about["format"] == "parquet" and about["files"] >= 1 and about["bytes"] > 0
    spark.range(2).write.mode("append").parquet(str(tmp_path / "numbers"))
    assert c.fingerprint("f", "numbers") != mark
    assert c.test("f") is None and c.test("s") is None and "no folder" in c.test("gone") and c.test("none")
    assert c.read("f", "numbers", filter={"id": 1}).count() == 2
    assert c.resolve("x", {"x"}) == Reference("step", "x") and c.resolve("y", set()) == Reference("table", "y", "f")
    assert c.resolve("m.t", set()) == Reference("table", "t", "m") and c.resolve("sch.t", set()) == Reference("table", "t", "f", "sch")
    assert c.resolve("a.b.c", set()) == c.resolve("z.a.b.c", set()) == Reference("table", "c", "a", "b")
    del c.specs["gone"]
    now = [0.0]
    cache = Cache(tmp_path / "c" / "cache.json", 10, 400, lambda: now[0])
    assert c.search("ppl", cache)[0][1:] == ("f", "people") and cache.get("tables:f") == ["numbers", "people"]
    now[0] = 11
    assert cache.get("tables:f") is None
    cache.put("big", "x" * 350)
    assert Cache(tmp_path / "c" / "cache.json", 10, 400, lambda: now[0]).get("big") and len((tmp_path / "c" / "cache.json").read_text()) <= 400
    assert fits("xz", "people") is None and fits("peo", "people") < fits("ple", "people") and fits("", "x") is not None
    assert jdbc_options({"type": "jdbc", "url": "u", "partition_column": "k", "lower_bound": 0, "upper_bound": 9, "num_partitions": 3}) == {"url": "u", "partitionColumn": "k", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    with pytest.raises(CatalogError):
        jdbc_options({"url": "u", "partition_column": "k"})
    with pytest.raises(CatalogError):
        Catalogs(spark, {"x": {"type": "odd"}})


def test_cli(spark, tmp_path, capsys, monkeypatch):
    folder = str(tmp_path / "p")
    assert cli.main(["init", folder]) == 0 and cli.main(["init", folder]) == 10 and cli.main(["nothing"]) == 10
    for args in (["compile", folder], ["doctor", folder], ["run", folder], ["test", folder], ["catalog", folder, "test"], ["lineage", folder, "totals", "--column", "amount"], ["export", folder, "totals", str(tmp_path / "t.csv")]):
        assert cli.main(args) == 0, args
    capsys.readouterr()
    assert cli.main(["query", folder, "SELECT * FROM totals ORDER BY id", "--format", "csv"]) == 0
    assert capsys.readouterr().out.split() == ["id,amount", "1,15", "2,7"]
    assert cli.main(["query", folder, "SELECT * FROM orders ORDER BY amount", "--limit", "1"]) == 0
    got = capsys.readouterr()
    assert "1   5" in got.out and "more than 1" in got.err
    assert cli.main(["diff", folder, "orders", "totals", "--format", "json"]) == 0 and cli.main(["profile", folder, "orders"]) == 0 and cli.main(["profile", folder]) == 10
    monkeypatch.setattr("sys.stdin", iter([".steps\n", "SELECT count(*) AS n\n", "FROM orders;\n", ".quit\n"]))
    capsys.readouterr()
    assert cli.main(["repl", folder, "--format", "json"]) == 0 and '{"n": 3}' in capsys.readouterr().out
    (tmp_path / "p" / "tests" / "totals.test.yaml").write_text("- {name: t, target: totals, inputs: {orders: [{id: 1, amount: 2}]}, expected: [{id: 1, amount: 3}]}\n")
    assert cli.main(["test", folder]) == 3 and cli.main(["test", folder, "--target", "other"]) == 0
    (tmp_path / "p" / "steps" / "totals.sql").write_text("-- quern:assert: row_count(max=0)\nSELECT id, amount FROM orders")
    assert cli.main(["run", folder]) == 4
    assert cli.main(["watermark", str(tmp_path / "m.json"), "set", "a", "3"]) == 0 and Marks(str(tmp_path / "m.json"), spark).get("a") == "3"
    (tmp_path / "p" / "steps" / "bad.sql").write_text("DROP TABLE x")
    assert cli.main(["compile", folder]) == 1 and cli.main(["doctor", folder]) == 1
