import datetime as dt
import http.server
import json
import os
import subprocess
import sys
import threading
import urllib.parse
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions.nested import flatten, unflatten
from quern.functions.types import parse_type
from quern.operators.checks import run_checks
from quern.operators.inspect import Comparison, compare, default_key, diff, export, histogram, profile_numeric
from quern.operators.watermark import Marks
from quern.operators.write import INSIDE, Files, WriteError, partition_columns, write
from quern.sources.files import detect, read


def kv(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def back(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect()), key=str)


def test_merge_and_delete_insert(spark, tmp_path):
    p = str(tmp_path / "t")
    write(kv(spark, [(1, "a"), (2, "b"), (None, "n")]), p)
    write(kv(spark, [(2, "B"), (3, "c"), (None, "m")]), p, "merge", keys=["k"])
    assert back(spark, p) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m")], key=str)
    with pytest.raises(WriteError):
        write(kv(spark, [(2, "x"), (2, "y")]), p, "merge", keys=["k"])
    with pytest.raises(WriteError):
        write(kv(spark, []), p, "merge")
    write(kv(spark, [(2, "x"), (2, "y")]), p, "delete_insert", keys=["k"])
    assert [r for r in back(spark, p) if r[0] == 2] == [(2, "x"), (2, "y")]
    with pytest.raises(WriteError):
        write(spark.createDataFrame([(1,)], "k int"), p, "truncate_insert")
    assert len(back(spark, p)) == 6


@settings(max_examples=4, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 4), st.sampled_from(["a", "b", None]), max_size=4), min_size=1, max_size=3))
def test_scd2_against_a_model(spark, tmp_path_factory, batches):
    p, model = str(tmp_path_factory.mktemp("s") / "t"), []
    for i, b in enumerate(batches):
        at = dt.datetime(2024, 1, 1 + i)
        for _ in range(2):  # the second time changes nothing
            write(kv(spark, list(b.items())), p, "scd2", keys=["k"], at=at)
        for k, v in b.items():
            now = [m for m in model if m["k"] == k and m["to"] is None]
            if now and now[0]["v"] == v:
                continue
            for m in now:
                m["to"] = at
            model.append({"k": k, "v": v, "from": at, "to": None})
    got = sorted((r.k, str(r.v), r.valid_from, str(r.valid_to), r.is_current) for r in spark.read.parquet(p).collect())
    assert got == sorted((m["k"], str(m["v"]), m["from"], str(m["to"]), m["to"] is None) for m in model)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (1, None, dt.datetime(2024, 1, 2))], "k int, v string, ts timestamp_ntz")
    asked = [{"type": "not_null", "columns": ["v"]}, {"type": "unique", "columns": ["v"]}, {"type": "expression", "sql": "v = 'a'"}, {"type": "freshness", "column": "ts", "max_age": "2h"}, {"type": "not_null", "columns": ["none"]}, {"type": "custom", "function": lambda d: d.count() == 2}]
    got = [r.passed for r in run_checks(df, asked, now=dt.datetime(2024, 1, 2, 1))]
    assert got == [False, True, False, True, False, True]


def test_diff_compare_histogram(spark):
    a, b = kv(spark, [(1, "x"), (2, "y"), (3, None)]), kv(spark, [(2, "z"), (3, None), (4, "w")])
    assert {r.k: r.status for r in diff(a, b, ["k"]).collect()} == {1: "removed", 2: "changed", 3: "unchanged", 4: "added"}
    assert not compare(a, b).equal and compare(a, kv(spark, [(3, None), (2, "y"), (1, "x")])).equal
    assert not compare(a, kv(spark, [(3, None), (2, "y"), (1, "x")]), mode="exact").equal
    assert [tuple(r) for r in histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x").collect()] == [(0, 2)]
    assert dict(map(tuple, histogram(spark.range(9), "id").collect()))[7] == 2


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
@pytest.mark.filterwarnings("ignore")
def test_types_never_raise(text):
    assert parse_type(text) is not None


def test_types():
    assert parse_type("struct<a:int,b:array<decimal(10,2)>>").simpleString() == "struct<a:int,b:array<decimal(10,2)>>"
    assert parse_type("VARCHAR(10)[]").simpleString() == "array<string>"
    assert parse_type("timestamp[us, UTC]").simpleString() == "timestamp"
    assert [parse_type("int8", x).simpleString() for x in ("arrow", "postgres", "duckdb")] == ["tinyint", "bigint", "bigint"]
    assert parse_type("int8[]", "postgres").simpleString() == "array<bigint>" and parse_type("character varying(9)", "postgres").simpleString() == "string"


def test_flatten(spark):
    df = spark.createDataFrame([((1, (2, (3, 4))),)], "a struct<b:int,c:struct<d:int,e:struct<f:int,g:int>>>")
    assert flatten(df).columns == ["a.b", "a.c.d", "a.c.e"]
    assert unflatten(flatten(df, 9)).schema.simpleString() == df.schema.simpleString()


def test_marks(spark, tmp_path):
    m, df = Marks(f"file://{tmp_path}/deep/m.json", spark), spark.range(10)
    assert m.unread(df, "x", "id").count() == 10
    m.advance(df.filter("id < 5"), "x", "id")
    assert m.unread(df, "x", "id").count() == 5
    m.reset("x")
    assert m.get("x") is None


def test_formats(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\tq\n")
    assert read(spark, str(tmp_path / "a.tsv")).first().asDict() == {"x": 1, "y": "q"}
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("x", pa.int64())])) as w:
        w.write(pa.record_batch({"x": [1, 2]}))
    assert read(spark, str(tmp_path / "b.arrow")).count() == 2
    assert detect(spark, str(tmp_path / "none")) == "parquet"


def test_rest(spark):
    from quern.sources.rest import Rest

    data, asked, sent = [{"id": i, "name": f"n{i}", "in": {"a": i}} for i in range(25)], [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            asked.append(q)
            some = [r for r in data if "id" not in q or r["id"] == int(q["id"])]
            o, n = int(q.get("offset", 0)), int(q.get("limit", 1000))
            body = json.dumps({"total": len(some), "items": some[o : o + n]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def take(self):
            sent.append((self.command, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(204)
            self.end_headers()

        do_POST = do_PUT = take

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(Rest)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    url = f"http://127.0.0.1:{server.server_port}/x"
    base = spark.read.format("rest").options(url=url, records="items", paginate="offset", page_size="10", filters="id=id")
    assert base.load().count() == 25
    assert base.option("total_path", "total").load().filter("id = 7").collect()[0].name == "n7"
    ranged = spark.read.format("rest").options(url=url, records="items", filters="id>=from, id<to", flatten="true").load()
    asked.clear()
    assert ranged.columns == ["id", "name", "in.a"] and ranged.filter("id >= 4 and id < 9").agg({"id": "sum"}).first()[0] == 30
    assert {"from": "4", "to": "9"} in asked
    rows = spark.createDataFrame([(i, f"s{i}") for i in range(7)], "`id` int, `who.name` string").coalesce(1)
    rows.write.format("rest").options(url=url, batch_size="3", unflatten="true", records="items").mode("append").save()
    assert [(m, len(b["items"])) for m, b in sent] == [("POST", 3), ("POST", 3), ("POST", 1)] and sent[0][1]["items"][0] == {"id": 0, "who": {"name": "s0"}}
    sent.clear()
    rows.limit(1).write.format("rest").options(url=url, batch_size="1").mode("overwrite").save()
    assert sent == [("PUT", {"id": 0, "who.name": "s0"})]
    server.shutdown()


def test_rest_pages_and_retries(spark):
    from quern.sources.rest import Client, pages

    data, calls = [{"id": i} for i in range(7)], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            u = urllib.parse.urlparse(self.path)
            q = dict(urllib.parse.parse_qsl(u.query))
            calls.append((self.headers.get("Authorization"), q))
            if u.path == "/busy" and len(calls) < 3:
                self.send_response(503 if len(calls) == 1 else 429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            at = int(q.get("cursor", q.get("at", (int(q.get("page", 1)) - 1) * 3)))
            self.send_response(200)
            if u.path == "/link" and at + 3 < len(data):
                self.send_header("Link", f'</link?at={at + 3}>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps({"rows": data[at : at + 3], "next": str(at + 3) if at + 3 < len(data) else None}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    for path, o in (("/p", {"paginate": "page", "page_size": "3"}), ("/c", {"paginate": "cursor"}), ("/link", {"paginate": "link"})):
        assert [r for page in pages({"url": url + path, "records": "rows", **o}, {}) for r in page] == data, path
    calls.clear()
    assert Client({"auth": "bearer", "token": "t", "rate": "1000"}).get(url + "/busy", {"q": 1})[0]["rows"] == data[:3]
    assert [c[0] for c in calls] == ["Bearer t"] * 3
    assert Client({"auth": "basic", "user": "u", "password": "p"}).headers() == {"Authorization": "Basic dTpw"} and Client({"auth": "api_key", "key": "k"}).headers() == {"X-API-Key": "k"}
    server.shutdown()


def test_partitioned_targets_stay_so(spark, tmp_path):
    p, kinds = str(tmp_path / "t"), "k int, v string, day string"
    make = lambda rows: spark.createDataFrame(rows, kinds)
    got = lambda: sorted(map(tuple, spark.read.parquet(p).select("k", "v", "day").collect()))
    write(make([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]), p, partition_by=["day"])
    stamp = next((tmp_path / "t" / "day=z").glob("*.parquet"))
    write(make([(2, "B", "y"), (4, "d", "x")]), p, "merge", keys=["k"])
    assert got() == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z"), (4, "d", "x")] and stamp.exists()
    write(make([(3, "C", "x")]), p, "merge", keys=["k"])  # the row moves, and its partition goes
    assert got() == [(1, "a", "x"), (2, "B", "y"), (3, "C", "x"), (4, "d", "x")] and not (tmp_path / "t" / "day=z").exists()
    write(make([(3, "?", "x"), (5, "e", "w")]), p, "incremental_append", keys=["k"])
    write(make([(5, "E", "w"), (5, "F", "w")]), p, "delete_insert", keys=["k"])
    assert got() == [(1, "a", "x"), (2, "B", "y"), (3, "C", "x"), (4, "d", "x"), (5, "E", "w"), (5, "F", "w")]
    write(make([(9, "i", "q")]), p, "truncate_insert")
    assert got() == [(9, "i", "q")] and partition_columns(spark, p) == ["day"]


def test_a_broken_swap_is_put_right(spark, tmp_path):
    p = tmp_path / "t"
    write(kv(spark, [(1, "a")]), str(p))
    p.rename(tmp_path / "t.old-1")
    assert Files(spark, str(p)).read().count() == 1 and not (tmp_path / "t.old-1").exists()


IN_THE_DRIVER = """
import datetime as dt, sys
from decimal import Decimal
from pyspark.sql import SparkSession
from quern.operators import write as w
from quern.sources.catalogs import Catalogs
base = sys.argv[1]
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.warehouse.dir", f"{base}/warehouse").getOrCreate()
w.ROWS = w.WIDE_ROWS = 2  # several groups of rows
c = Catalogs(spark, {"db": {"type": "jdbc", "url": "jdbc:derby:memory:t;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}}, "db")
kinds, day = "k int, v string, d decimal(9,2), t timestamp, `V` double", dt.datetime(2024, 1, 2, 3, 4, 5)
spark.conf.set("spark.sql.caseSensitive", "true")
make = lambda *rows: spark.createDataFrame([(k, v, Decimal("1.50"), day, None) for k, v in rows], kinds).repartition(2)
got = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
want = lambda *rows: sorted(((k, v, Decimal("1.50"), day, None) for k, v in rows), key=str)
to = c.target("db", "KV")
assert to.read() is None
w.write_to(make((1, "a"), (2, "b"), (None, "n"), (4, None)), to, "replace")
w.write_to(make((2, "B"), (3, "c")), to, "merge", keys=["k"])
w.write_to(make((3, "?"), (9, "i")), to, "incremental_append", keys=["k"])
rows = want((1, "a"), (2, "B"), (3, "c"), (None, "n"), (4, None), (9, "i"))
assert got(to.read()) == rows, got(to.read())
assert got(c.read("db", "KV", partition_column="k", lower_bound=0, upper_bound=9, num_partitions=3)) == rows
assert c.read("db", "KV").dtypes == c.columns("db", "KV") and to.read().columns == ["k", "v", "d", "t", "V"]
w.write_to(make((9, "I"), (9, "J")), to, "delete_insert", keys=["k"])
assert [r[1] for r in got(to.read()) if r[0] == 9] == ["I", "J"]
w.write_to(make((7, "g")).limit(0), to, "truncate_insert")
assert got(to.read()) == [] and got(c.read("db", "(SELECT * FROM KV) q")) == []
print("all held")
"""


def test_databases_inside_the_driver_on_a_cluster(tmp_path):
    """Executors in processes of their own don't reach a database in the driver's memory; all rows get there and back all the same."""
    import pyspark

    (tmp_path / "home" / "work").mkdir(parents=True)
    home, repo = Path(pyspark.__file__).parent, str(Path(__file__).parent.parent)
    for p in home.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": repo, "SPARK_HOME": str(tmp_path / "home"), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", IN_THE_DRIVER, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all held" in out.stdout, out.stderr[-3000:]


def test_which_databases_are_inside():
    for url in ("jdbc:derby:memory:x;create=true", "jdbc:derby:/a/b", "jdbc:sqlite:/a.db", "jdbc:h2:mem:x", "jdbc:h2:/a", "jdbc:hsqldb:mem:x", "jdbc:duckdb:"):
        assert INSIDE.match(url), url
    for url in ("jdbc:derby://host:1527/x", "jdbc:h2:tcp://host/x", "jdbc:h2:/a;AUTO_SERVER=TRUE", "jdbc:hsqldb:hsql://host/x", "jdbc:postgresql://host/x"):
        assert not INSIDE.match(url), url


def test_profiles_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert list(profile_numeric(df.filter("not isnan(x)"), "x").first().histogram) == [1, 0, 0, 0, 0, 0, 0, 1]
    assert profile_numeric(df.limit(0), "x").first().rows == 0
    t = kv(spark, [(1, "a"), (2, None)])
    for name in ("a.csv", "a.tsv", "a.json", "a.jsonl", "a.parquet"):
        export(t, str(tmp_path / name), single=True)
        assert read(spark, str(tmp_path / name)).count() == 2
    with pytest.raises(ValueError):
        export(t, str(tmp_path / "a.odd"))
    assert default_key(t.withColumnRenamed("k", "id")) == ["id"] and default_key(t) == []


def test_compare_by_time_and_function(spark):
    a, b = (spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0, s))], "k int, t timestamp_ntz") for s in (0, 2))
    assert not compare(a, b).equal and compare(a, b, seconds=2).equal
    assert compare(a, b, mode="custom", function=lambda x, y: x.count() == y.count()).equal
    assert compare(a, b, mode="custom", function=lambda x, y: (False, ["no"])).messages == ["no"] and compare(a, b, mode="custom", function=lambda x, y: Comparison(True)).equal
