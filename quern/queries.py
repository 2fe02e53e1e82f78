"""The library's query slate on the test tables, each with SQL for DuckDB that must give the same rows.

Queries in SHARED are one text for both; tables are written {name}.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.nested import flatten, unflatten
from quern.operators import inspect as look
from quern.operators.checks import run_checks
from quern.operators.joins import asof_join, range_join
from quern.operators.watermark import Marks
from quern.operators.write import Table, write, write_to
from quern.plans.graph import Pipeline, Step
from quern.plans.run import Compiled, run
from quern.sources import ipc
from quern.sources.catalogs import Catalogs
from quern.sources.files import read
from quern.streaming import windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARED: dict[str, str] = {
    "scan_project_rename": "SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS balance FROM {customer}",
    "filter_conjunct": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderpriority LIKE '1%'",
    "filter_mixed": "SELECT p_partkey, p_name, p_size FROM {part} WHERE (p_size BETWEEN 10 AND 20 OR p_size IN (1, 2, 3)) AND p_brand LIKE '%1%' AND p_type IS NOT NULL",
    "cast_and_computed": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS quantity, l_extendedprice * (1 - l_discount) AS revenue, CAST(l_shipdate AS DATE) AS shipped FROM {lineitem}",
    "join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "join_left": "SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n_lines FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "join_right": "SELECT n_name, CAST(count(c_custkey) AS BIGINT) AS n FROM {customer} RIGHT JOIN {nation} ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name",
    "join_full": "SELECT c.balance AS customer_balance, s.balance AS supplier_balance, c.n AS customers, s.n AS suppliers FROM (SELECT CAST(floor(c_acctbal / 50) AS BIGINT) AS balance, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY 1) c FULL JOIN (SELECT CAST(floor(s_acctbal / 50) AS BIGINT) AS balance, CAST(count(*) AS BIGINT) AS n FROM {supplier} GROUP BY 1) s ON c.balance = s.balance",
    "join_cross": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "join_theta": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_semi": "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
    "join_anti": "SELECT o_orderkey, o_custkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
    "multiway_join": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "agg_basic": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM {lineitem}",
    "select_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "agg_having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 12",
    "agg_filter": "SELECT l_shipmonth, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS returned, CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS BIGINT) AS kept FROM (SELECT CAST(month(l_shipdate) AS BIGINT) AS l_shipmonth, l_returnflag FROM {lineitem}) t GROUP BY l_shipmonth",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "rollup": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "window_rank": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS quarter FROM {orders}",
    "window_lag_lead": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS after2, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS first_type FROM {events}",
    "window_frame_rows": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS BIGINT) AS upto FROM {orders}",
    "window_frame_range": "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM {orders}",
    "window_last_value": "SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_type FROM {events}",
    "qualify_rewrite": "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) t WHERE rn = 1",
    "topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 15",
    "union_all": "SELECT c_name AS name, c_acctbal AS balance FROM {customer} UNION ALL SELECT s_name, s_acctbal FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000",
    "except": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000",
    "recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "scalar_string": "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS BIGINT) AS len, c_name || '-' || c_mktsegment AS joined, replace(c_name, '#', '') AS cleaned, substr(c_name, 1, 4) AS head FROM {customer}",
    "scalar_date": "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM {orders}",
    "scalar_math": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS unit, round(l_extendedprice, 1) AS r, abs(l_discount - 0.05) AS a, CAST(floor(l_quantity / 3) AS BIGINT) AS f, l_orderkey % 7 AS m, sqrt(l_quantity) AS s FROM {lineitem}",
    "scalar_conditional": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, greatest(o_custkey, 500) AS g FROM {orders}",
    "subquery_correlated": "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
    "subquery_in": "SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')",
    "cte_nested": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), b AS (SELECT c_mktsegment, total FROM a JOIN {customer} ON c_custkey = o_custkey) SELECT c_mktsegment, round(avg(total), 2) AS mean_total, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY c_mktsegment",
}


def _shared(text: str) -> Query:
    names = [t for t in TABLES if f"{{{t}}}" in text]
    return lambda spark, d: spark.sql(text, **{t: table(spark, d, t) for t in names})


def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a three-step pipeline over two sources."""
    p = Pipeline(
        [
            Step("orders_in", "source", path=f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"], filter="o_orderstatus <> 'P'"),
            Step("customer_in", "source", path=f"{sf_dir}/customer.parquet", columns=["c_custkey", "c_mktsegment"]),
            Step("joined", "sql", sql="SELECT c_mktsegment, o_totalprice FROM orders_in JOIN customer_in ON o_custkey = c_custkey"),
            Step("revenue", "sql", sql="SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM joined GROUP BY c_mktsegment"),
        ]
    )
    return Compiled(spark, p).frames["revenue"]


def _rows(spark: SparkSession, results: list) -> DataFrame:
    return spark.createDataFrame([(r.type, r.passed, int(r.failing)) for r in results], "check_type string, passed boolean, failing long")


def checks(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    asked = [
        {"type": "not_null", "columns": ["o_orderkey", "o_custkey"]},
        {"type": "unique", "columns": ["o_custkey"]},
        {"type": "row_count", "min": 1},
        {"type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]},
        {"type": "expression", "expression": "o_totalprice > 1000"},
        {"type": "schema", "columns": {"o_orderkey": "bigint", "o_totalprice": "double"}},
        {"type": "freshness", "column": "o_orderdate", "max_age": "1d"},
        {"type": "relationship", "column": "o_custkey", "to": "customer", "field": "c_custkey"},
        {"type": "custom", "sql": "SELECT * FROM {this} WHERE o_totalprice < 0"},
    ]
    return _rows(spark, run_checks(orders, asked, tables={"customer": customer}, now=dt.datetime(2030, 1, 1)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the cluster's shared folder; in the warehouse where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def _two_batches(strategy: str, first_by: list[str] | None = None, **options) -> Query:
    """Write finished and open orders, then open and pending ones at changed prices, and read back."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        path = scratch(spark, strategy)
        o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
        first, second = o.filter("o_orderstatus in ('F', 'O')"), o.filter("o_orderstatus in ('O', 'P')").withColumn("o_totalprice", F.col("o_totalprice") + 1)
        if strategy == "scd2":
            write(first, path, strategy, at=dt.datetime(2024, 1, 1), **options)
            write(second, path, strategy, at=dt.datetime(2024, 2, 1), **options)
        else:
            write(first, path, "replace", partition_by=first_by or options.get("partition_by"))
            write(second, path, strategy, **options)
        return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice", *(("valid_from", "valid_to", "is_current") if strategy == "scd2" else ()))

    return query


_A = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')"
_B = "SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P')"
_MERGED = f"SELECT * FROM ({_A}) WHERE o_orderstatus = 'F' UNION ALL {_B}"
_ADDED = f"{_A} UNION ALL SELECT * FROM ({_B}) WHERE o_orderstatus = 'P'"


def _values(spark: SparkSession, kinds: str, *batches: list[tuple]) -> list[DataFrame]:
    return [spark.createDataFrame(b, kinds) for b in batches]


def write_scd2_null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Three batches, one of them twice; a key and values are NULL, one goes back to what it was."""
    path = scratch(spark, "scd2-nulls")
    one, two, three = _values(spark, "k int, v string", [(1, "a"), (None, "n"), (2, None)], [(1, "b"), (None, "n"), (2, "x")], [(1, "a"), (None, None)])
    for i, b in enumerate((one, one, two, three)):
        write(b, path, "scd2", keys=["k"], at=dt.datetime(2024, 1, 1 + i))
    return spark.read.parquet(path)


def write_merge_null_keys(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "merge-nulls")
    one, two = _values(spark, "k int, v string", [(1, "a"), (None, "n"), (3, None)], [(1, None), (None, "m"), (4, "d")])
    write(one, path)
    write(two, path, "merge", keys=["k"])
    return spark.read.parquet(path)


def write_table_merge(spark: SparkSession, d: str) -> DataFrame:
    """merge into a partitioned table of Spark's catalog."""
    name = f"quern_merge_{uuid.uuid4().hex[:12]}"
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    to = Table(spark, name, "parquet", ["o_orderstatus"])
    write_to(o.filter("o_orderstatus in ('F', 'O')"), to, "replace")
    write_to(o.filter("o_orderstatus in ('O', 'P')").withColumn("o_totalprice", F.col("o_totalprice") + 1), to, "merge", keys=["o_orderkey"])
    return spark.table(name).select("o_orderkey", "o_orderstatus", "o_totalprice")


def write_jdbc_merge(spark: SparkSession, d: str) -> DataFrame:
    """merge and incremental_append in a database (the one that comes with Spark), read back by a partitioned read."""
    url = f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true"
    c = Catalogs(spark, {"db": {"type": "jdbc", "url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"}}, "db")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    to = c.target("db", "NATIONS")
    write_to(n.filter("n_regionkey < 3"), to, "replace")
    write_to(n.filter("n_regionkey between 2 and 3").withColumn("n_regionkey", F.col("n_regionkey") + 10), to, "merge", keys=["n_nationkey"])
    write_to(n, to, "incremental_append", keys=["n_nationkey"])
    return c.read("db", "NATIONS", partition_column="n_nationkey", lower_bound=0, upper_bound=25, num_partitions=3)


def source_catalog_table(spark: SparkSession, d: str) -> DataFrame:
    """Steps that read tables of two catalogs, and one that writes to a third, read back from there."""
    name = f"quern_customer_{uuid.uuid4().hex[:12]}"
    table(spark, d, "customer").write.saveAsTable(name)
    c = Catalogs(spark, {"files": {"type": "filesystem", "path": d}, "tables": {"type": "spark"}, "mem": {"type": "memory"}}, "files")
    p = Pipeline(
        [
            Step("o", "source", table="orders", columns=["o_custkey", "o_totalprice"]),
            Step("c", "source", catalog="tables", table=name, filter="c_mktsegment = 'BUILDING'"),
            Step("joined", "sql", sql="SELECT c_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM o JOIN c ON o_custkey = c_custkey GROUP BY c_custkey"),
            Step("out", "sink", ["joined"], catalog="mem", table="result"),
        ]
    )
    report = run(spark, p, catalogs=c)
    if report.exit_code:
        raise RuntimeError(str(report))
    return c.read("mem", "result")


def watermark_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Events up to the middle of the month, then the same source with all: the second run reads and appends the rest only."""
    base = scratch(spark, "marks")
    e = table(spark, d, "events").select("event_id", "ts")
    c = Catalogs(spark, {"mem": {"type": "memory"}}, "mem")
    p = Pipeline([Step("e", "source", table="events", watermark="ts"), Step("out", "sink", ["e"], path=f"{base}/out", strategy="append")])
    for batch, some in enumerate((e.filter("ts < timestamp_ntz '2024-01-16'"), e, e)):
        write_to(some, c.target("mem", "events"))
        report = run(spark, p, catalogs=c, marks=Marks(f"{base}/marks.json", spark))
        if report.exit_code:
            raise RuntimeError(str(report))
    return spark.read.parquet(f"{base}/out")


def watermark_incremental(spark: SparkSession, d: str) -> DataFrame:
    marks, e = Marks(f"{scratch(spark, 'marks')}/marks.json", spark), table(spark, d, "events")
    marks.advance(e.filter("event_type = 'signup'").filter("ts < timestamp_ntz '2024-01-16'"), "events", "ts")
    return marks.unread(e, "events", "ts").select("event_id")


def flatten_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flatten(e).select("event_id", F.col("`props.k`").alias("k"))


def diff_keyed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    other = c.filter("c_mktsegment <> 'BUILDING'").withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return look.diff(c.filter("c_mktsegment <> 'HOUSEHOLD'"), other, ["c_custkey"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def diff_positional(spark: SparkSession, d: str) -> DataFrame:
    """Without a key: parts by size and price against those of other brands."""
    p = table(spark, d, "part").select("p_size", "p_retailprice", "p_type")
    return look.diff_positions(p, p.filter("p_size > 3"), ["p_size", "p_retailprice"]).select("position", "status", F.size("changed").cast("long").alias("n_changed"))


def lineage_columns(spark: SparkSession, d: str) -> DataFrame:
    """Where the columns of a step come from, and what two columns of a source go into."""
    p = Pipeline(
        [
            Step("o", "source", path=f"{d}/orders.parquet"),
            Step("t", "sql", sql="SELECT o_custkey AS customer, o_totalprice, o_totalprice * 2 AS twice, o_totalprice + o_orderkey AS mixed, 1 AS one FROM o"),
            Step("s", "sql", sql="SELECT customer, sum(twice) AS total, max(mixed) AS top FROM t GROUP BY customer"),
        ]
    )
    c = Compiled(spark, p)
    rows = [("backward", "t", x.column, x.kind) for x in c.lineage("t")] + [("forward", *at, col) for col in ("o_totalprice", "o_orderkey") for at in c.impact("o", col)]
    return spark.createDataFrame(rows, "direction string, step string, column string, detail string")


_LINEAGE = [
    ("backward", "t", "customer", "renamed"), ("backward", "t", "o_totalprice", "direct"), ("backward", "t", "twice", "expression"), ("backward", "t", "mixed", "multi_column"), ("backward", "t", "one", "literal"),
    ("forward", "t", "o_totalprice", "o_totalprice"), ("forward", "t", "twice", "o_totalprice"), ("forward", "t", "mixed", "o_totalprice"), ("forward", "s", "total", "o_totalprice"), ("forward", "s", "top", "o_totalprice"),
    ("forward", "t", "mixed", "o_orderkey"), ("forward", "s", "top", "o_orderkey"),
]


def _reread(fmt: str) -> Query:
    """Events written in a format and read back by its detected reader."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        path = f"{scratch(spark, fmt)}/events.{fmt}"
        e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
        if fmt == "arrow":
            ipc.write(e, path)
        else:
            look.export(e, path)
        # csv's inferred integers are as narrow as their values
        return read(spark, path).select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type", "value")

    return query


def _check(what: str) -> Query:
    """Checks of one type, passing and failing, on orders and on rows with NULLs."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
        nulls = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (1, None, dt.datetime(2024, 1, 3)), (None, "b", None), (4, "b", None)], "id int, a string, ts timestamp_ntz")
        now, refs = dt.datetime(2024, 1, 3, 6), {"customer": customer, "nation": nation}
        out = []
        for name, df in (("orders", orders), ("nulls", nulls)):
            asked = [c for n, c in CHECK_CASES[what] if n == name]
            out += [(name, r.type, r.passed, int(r.failing)) for r in run_checks(df, asked, tables=refs, now=now)] if asked else []
        return spark.createDataFrame([(i, *r) for i, r in enumerate(out)], "i long, data string, check_type string, passed boolean, failing long")

    return query


CHECK_CASES: dict[str, list[tuple[str, dict]]] = {
    "not_null": [("orders", {"type": "not_null", "columns": ["o_orderkey", "o_custkey"]}), ("nulls", {"type": "not_null", "columns": ["id", "a"]}), ("nulls", {"type": "not_null", "columns": ["none"]})],
    "unique": [("orders", {"type": "unique", "columns": ["o_orderkey"]}), ("orders", {"type": "unique", "columns": ["o_custkey"]}), ("nulls", {"type": "unique", "columns": ["id", "a"]})],
    "row_count": [("orders", {"type": "row_count", "min": 1}), ("nulls", {"type": "row_count", "min": 4, "max": 4}), ("nulls", {"type": "row_count", "max": 3}), ("nulls", {"type": "row_count", "min": 5})],
    "accepted_values": [("orders", {"type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O", "P"]}), ("orders", {"type": "accepted_values", "column": "o_orderstatus", "values": ["F"]}), ("nulls", {"type": "accepted_values", "column": "a", "values": ["a"]})],
    "expression": [("orders", {"type": "expression", "expression": "o_totalprice > 0"}), ("orders", {"type": "expression", "expression": "o_totalprice > 100000"}), ("nulls", {"type": "expression", "expression": "a = 'b'"})],
    "schema": [("orders", {"type": "schema", "columns": {"o_orderkey": "bigint", "o_totalprice": "double"}}), ("orders", {"type": "schema", "columns": {"o_orderkey": "int", "nothing": "double"}})],
    "freshness": [("nulls", {"type": "freshness", "column": "ts", "max_age": "6h"}), ("nulls", {"type": "freshness", "column": "ts", "max_age": "5h"}), ("orders", {"type": "freshness", "column": "o_orderdate", "max_age": "1d"})],
    "relationship": [("orders", {"type": "relationship", "column": "o_custkey", "to": "customer", "field": "c_custkey"}), ("nulls", {"type": "relationship", "column": "id", "to": "nation", "field": "n_regionkey"}), ("orders", {"type": "relationship", "column": "o_custkey", "to": "nation", "field": "n_nationkey"})],
    "custom": [("orders", {"type": "custom", "sql": "SELECT * FROM {this} WHERE o_totalprice < 0"}), ("orders", {"type": "custom", "sql": "SELECT * FROM {this} WHERE o_orderstatus = 'P'"})],
}
_NULLS = "(VALUES (1, 'a', TIMESTAMP '2024-01-01'), (1, NULL, TIMESTAMP '2024-01-03'), (NULL, 'b', NULL), (4, 'b', NULL)) n(id, a, ts)"
_OLD = "epoch(TIMESTAMP '2024-01-03 06:00:00' - (SELECT max(o_orderdate) FROM orders))"
#: For each type: (data, passed, failing) of the cases above, those of orders first, as SQL.
CHECK_ORACLE: dict[str, list[tuple[str, str, str]]] = {
    "not_null": [("orders", "true", "(SELECT count(*) FROM orders WHERE o_orderkey IS NULL OR o_custkey IS NULL)"), ("nulls", "false", f"(SELECT count(*) - count(id) + count(*) - count(a) FROM {_NULLS})"), ("nulls", "false", "0")],
    "unique": [("orders", "true", "0"), ("orders", "false", "(SELECT count(o_custkey) - count(DISTINCT o_custkey) FROM orders)"), ("nulls", "false", f"(SELECT count(id) - count(DISTINCT id) + count(a) - count(DISTINCT a) FROM {_NULLS})")],
    "row_count": [("orders", "true", "(SELECT count(*) FROM orders)"), ("nulls", "true", "4"), ("nulls", "false", "4"), ("nulls", "false", "4")],
    "accepted_values": [("orders", "true", "0"), ("orders", "false", "(SELECT count(*) FROM orders WHERE o_orderstatus <> 'F')"), ("nulls", "false", f"(SELECT count(*) FROM {_NULLS} WHERE a <> 'a')")],
    "expression": [("orders", "true", "0"), ("orders", "false", "(SELECT count(*) FROM orders WHERE NOT o_totalprice > 100000)"), ("nulls", "false", f"(SELECT count(*) FROM {_NULLS} WHERE a IS DISTINCT FROM 'b')")],
    "schema": [("orders", "true", "0"), ("orders", "false", "2")],
    "freshness": [("orders", f"{_OLD} <= 86400", f"CAST({_OLD} > 86400 AS INT)"), ("nulls", "true", "0"), ("nulls", "false", "1")],
    "relationship": [("orders", "true", "(SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"), ("orders", "false", "(SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT n_nationkey FROM nation))"), ("nulls", "true", f"(SELECT count(*) FROM {_NULLS} WHERE id NOT IN (SELECT n_regionkey FROM nation))")],
    "custom": [("orders", "true", "0"), ("orders", "false", "(SELECT count(*) FROM orders WHERE o_orderstatus = 'P')")],
}


def unflatten_nested(spark: SparkSession, d: str) -> DataFrame:
    """Dotted names to structs and back to a column of each."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("place.name"), F.col("n_regionkey").alias("place.region.key"))
    return unflatten(n).select("id", F.col("place.name").alias("name"), F.col("place.region.key").alias("region"), F.to_json("place").alias("json"))


def scalar_map(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), "value"))).alias("m"))
    return e.select("user_id", F.size("m").cast("long").alias("n"), F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.array_max(F.transform(F.map_keys("m"), lambda k: k.cast("long"))).alias("last_id"), F.map_contains_key("m", F.lit("1")).alias("has_one"))


def histogram_nan(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (9.0,), (None,), (float("inf"),)], "x double")
    return look.histogram(x, "x")


def join_asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left, right = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return asof_join(left, right, on="ts", by=["user_id"], values=["view_value"]).select("event_id", "view_value")


def join_asof_sliced(spark: SparkSession, d: str) -> DataFrame:
    """Without a group: one hot series, cut into days."""
    e = table(spark, d, "events")
    left, right = e.filter("event_type = 'purchase'").select("event_id", "ts"), e.filter("event_type = 'signup'").select("ts", F.col("value").alias("signup_value"))
    return asof_join(left, right, on="ts", values=["signup_value"], slice_width=86400.0).select("event_id", "signup_value")


def join_range_long(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of very unlike lengths."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + F.when(F.col("s_suppkey") < 4, 1e9).otherwise(0.5)).alias("high"))
    return range_join(p, s, point="p_retailprice", low="low", high="high", width=0.5).select("p_partkey", "s_suppkey")


def join_range(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return range_join(p, s, point="p_retailprice", low="low", high="high", width=50.0).select("p_partkey", "s_suppkey")


def source_inline(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline([Step("o", "source", path=f"{d}/orders.parquet", columns=["o_orderkey", {"half": "o_totalprice / 2"}], filter="o_orderstatus = 'O'")])
    return Compiled(spark, p).frames["o"].orderBy(F.desc("half"), "o_orderkey").limit(40)


QUERIES: dict[str, Query] = {
    "segment_revenue": segment_revenue,
    **{k: _shared(v) for k, v in SHARED.items()},
    "source_inline": source_inline,
    "join_asof": join_asof,
    "join_range": join_range,
    "join_range_long": join_range_long,
    "join_asof_sliced": join_asof_sliced,
    "source_catalog_table": source_catalog_table,
    "watermark_pipeline": watermark_pipeline,
    "write_scd2_null_keys": write_scd2_null_keys,
    "write_merge_null_keys": write_merge_null_keys,
    "write_merge_partitioned": _two_batches("merge", ["o_orderstatus"], keys=["o_orderkey"]),
    "write_incremental_append_partitioned": _two_batches("incremental_append", ["o_orderstatus"], keys=["o_orderkey"]),
    "write_table_merge": write_table_merge,
    "write_jdbc_merge": write_jdbc_merge,
    "diff_positional": diff_positional,
    "lineage_columns": lineage_columns,
    "source_csv": _reread("csv"),
    "source_json": _reread("json"),
    "source_arrow": _reread("arrow"),
    "unflatten": unflatten_nested,
    "scalar_map": scalar_map,
    "histogram_nan": histogram_nan,
    **{f"check_{k}": _check(k) for k in CHECK_CASES},
    "scalar_array": lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("square")),
    "scalar_json": lambda spark, d: table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "tumbling_window": lambda spark, d: windows.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")]),
    "sliding_window": lambda spark, d: windows.sliding(table(spark, d, "events"), "ts", "2 hours", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]),
    "session_window": lambda spark, d: windows.session(table(spark, d, "events"), "ts", "2 hours", ["user_id"], [F.count(F.lit(1)).alias("n")]),
    "checks": checks,
    "write_append": _two_batches("append"),
    "write_replace": _two_batches("replace"),
    "write_truncate_insert": _two_batches("truncate_insert"),
    "write_merge": _two_batches("merge", keys=["o_orderkey"]),
    "write_delete_insert": _two_batches("delete_insert", keys=["o_orderkey"]),
    "write_incremental_append": _two_batches("incremental_append", keys=["o_orderkey"]),
    "write_partition": _two_batches("partition", partition_by=["o_orderstatus"]),
    "write_scd2": _two_batches("scd2", keys=["o_orderkey"]),
    "profile_numeric": lambda spark, d: look.profile_numeric(table(spark, d, "orders"), "o_totalprice", exact=True).select("rows", "null_pct", "distinct_count", "least", "greatest", F.round("mean", 4).alias("mean"), "median", F.round("stddev", 4).alias("stddev")),
    "profile_histogram": lambda spark, d: look.histogram(table(spark, d, "part"), "p_size"),
    "profile_string": lambda spark, d: look.profile_string(table(spark, d, "customer"), "c_mktsegment").select("rows", "nulls", "distinct_count", "least_length", "greatest_length", F.round("mean_length", 6).alias("mean_length")),
    "profile_top5": lambda spark, d: look.top_values(table(spark, d, "events"), "event_type"),
    "profile_bool": lambda spark, d: look.profile_bool(table(spark, d, "orders").select((F.col("o_totalprice") > 150000).alias("b")), "b"),
    "profile_temporal": lambda spark, d: look.profile_temporal(table(spark, d, "events"), "ts"),
    "statistics": lambda spark, d: look.statistics(table(spark, d, "nation"), exact=True),
    "diff_keyed": diff_keyed,
    "watermark_incremental": watermark_incremental,
    "flatten_json": flatten_json,
}

ORACLE: dict[str, str] = {
    **{k: re.sub(r"\{(\w+)\}", r"\1", v) for k, v in SHARED.items()},
    "segment_revenue": "SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment",
    "source_inline": "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus = 'O' ORDER BY half DESC, o_orderkey LIMIT 40",
    "join_asof": "SELECT l.event_id, r.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "join_range": "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 50",
    "scalar_array": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 3) AS square FROM embeddings",
    "scalar_json": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "tumbling_window": "SELECT event_type, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "sliding_window": "SELECT event_type, s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - i * INTERVAL 1 HOUR AS s FROM events CROSS JOIN (SELECT unnest([0, 1]) AS i) x) t GROUP BY ALL",
    "session_window": "SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT *, sum(CAST(coalesce(ts - p >= INTERVAL 2 HOUR, true) AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) a) b GROUP BY user_id, s",
    "checks": """SELECT 'not_null' AS check_type, count(*) FILTER (WHERE o_orderkey IS NULL OR o_custkey IS NULL) = 0 AS passed, count(*) FILTER (WHERE o_orderkey IS NULL OR o_custkey IS NULL) AS failing FROM orders
        UNION ALL SELECT 'unique', count(o_custkey) = count(DISTINCT o_custkey), count(o_custkey) - count(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 'row_count', count(*) >= 1, count(*) FROM orders
        UNION ALL SELECT 'accepted_values', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) = 0, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
        UNION ALL SELECT 'expression', count(*) FILTER (WHERE NOT coalesce(o_totalprice > 1000, false)) = 0, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 1000, false)) FROM orders
        UNION ALL SELECT 'schema', true, 0 UNION ALL SELECT 'freshness', false, 1
        UNION ALL SELECT 'relationship', count(*) = 0, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'custom', count(*) = 0, count(*) FROM orders WHERE o_totalprice < 0""",
    "write_append": f"{_A} UNION ALL {_B}",
    "write_replace": _B,
    "write_truncate_insert": _B,
    "write_merge": _MERGED,
    "write_delete_insert": _MERGED,
    "write_incremental_append": _ADDED,
    "write_merge_partitioned": _MERGED,
    "write_incremental_append_partitioned": _ADDED,
    "write_table_merge": _MERGED,
    "write_scd2_null_keys": """SELECT * FROM (VALUES (1, 'a', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', false), (1, 'b', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-04', false), (1, 'a', TIMESTAMP '2024-01-04', NULL, true),
        (NULL, 'n', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-04', false), (NULL, NULL, TIMESTAMP '2024-01-04', NULL, true), (2, NULL, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', false), (2, 'x', TIMESTAMP '2024-01-03', NULL, true)) t(k, v, valid_from, valid_to, is_current)""",
    "write_merge_null_keys": "SELECT * FROM (VALUES (1, NULL), (NULL, 'n'), (NULL, 'm'), (3, NULL), (4, 'd')) t(k, v)",
    "write_jdbc_merge": "SELECT n_nationkey, CASE WHEN n_regionkey IN (2, 3) THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation",
    "source_catalog_table": "SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey",
    "watermark_pipeline": "SELECT event_id, ts FROM events",
    "join_range_long": "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + CASE WHEN s_suppkey < 4 THEN 1e9 ELSE 0.5 END",
    "join_asof_sliced": "SELECT l.event_id, r.value AS signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.ts >= r.ts",
    "diff_positional": """WITH a AS (SELECT *, row_number() OVER (ORDER BY p_size, p_retailprice, p_type) - 1 AS position FROM part), b AS (SELECT *, row_number() OVER (ORDER BY p_size, p_retailprice, p_type) - 1 AS position FROM part WHERE p_size > 3),
        c AS (SELECT coalesce(a.position, b.position) AS position, a.position IS NULL AS l, b.position IS NULL AS r, CAST(a.p_size <> b.p_size AS BIGINT) + CAST(a.p_retailprice <> b.p_retailprice AS BIGINT) + CAST(a.p_type <> b.p_type AS BIGINT) AS n FROM a FULL JOIN b ON a.position = b.position)
        SELECT position, CASE WHEN l THEN 'added' WHEN r THEN 'removed' WHEN n > 0 THEN 'changed' ELSE 'unchanged' END AS status, coalesce(n, 0) AS n_changed FROM c""",
    "lineage_columns": "SELECT * FROM (VALUES " + ", ".join(str(r) for r in _LINEAGE) + ') t(direction, step, "column", detail)',
    **{f"source_{k}": "SELECT event_id, user_id, event_type, value FROM events" for k in ("csv", "json", "arrow")},
    "unflatten": """SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, '{"name":"' || n_name || '","region":{"key":' || n_regionkey || '}}' AS json FROM nation""",
    "scalar_map": "SELECT user_id, count(*) AS n, round(sum(value), 3) AS total, max(event_id) AS last_id, bool_or(event_id = 1) AS has_one FROM events GROUP BY user_id",
    "histogram_nan": "SELECT * FROM (VALUES (CAST(0 AS INT), CAST(1 AS BIGINT)), (1, 1), (7, 1)) t(bin, n)",
    **{f"check_{k}": " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, '{data}' AS data, '{k}' AS check_type, {ok} AS passed, CAST({n} AS BIGINT) AS failing" for i, (data, ok, n) in enumerate(rows)) for k, rows in CHECK_ORACLE.items()},
    "write_partition": f"{_B} UNION ALL SELECT * FROM ({_A}) WHERE o_orderstatus NOT IN (SELECT o_orderstatus FROM ({_B}))",
    "write_scd2": f"""SELECT *, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2024-02-01' END AS valid_to, o_orderstatus <> 'O' AS is_current FROM ({_A})
        UNION ALL SELECT *, TIMESTAMP '2024-02-01', CAST(NULL AS TIMESTAMP), true FROM ({_B})""",
    "profile_numeric": "SELECT count(*) AS rows, 100.0 * count(*) FILTER (WHERE o_totalprice IS NULL) / count(*) AS null_pct, count(DISTINCT o_totalprice) AS distinct_count, min(o_totalprice) AS least, max(o_totalprice) AS greatest, round(avg(o_totalprice), 4) AS mean, median(o_totalprice) AS median, round(stddev_pop(o_totalprice), 4) AS stddev FROM orders",
    "profile_histogram": "SELECT CAST(least(7, floor((p_size - lo) / ((hi - lo) / 8.0))) AS INT) AS bin, count(*) AS n FROM part CROSS JOIN (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) GROUP BY 1",
    "profile_string": "SELECT count(*) AS rows, count(*) FILTER (WHERE c_mktsegment IS NULL) AS nulls, count(DISTINCT c_mktsegment) AS distinct_count, min(length(c_mktsegment)) AS least_length, max(length(c_mktsegment)) AS greatest_length, round(avg(length(c_mktsegment)), 6) AS mean_length FROM customer",
    "profile_top5": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
    "profile_bool": "SELECT count(*) FILTER (WHERE o_totalprice > 150000) AS trues, count(*) FILTER (WHERE NOT o_totalprice > 150000) AS falses, CAST(0 AS BIGINT) AS nulls FROM orders",
    "profile_temporal": "SELECT CAST(0 AS BIGINT) AS nulls, count(DISTINCT ts) AS distinct_count, min(ts) AS least, max(ts) AS greatest FROM events",
    "statistics": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")),
    "diff_keyed": "SELECT status, count(*) AS n FROM (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'removed' WHEN 'HOUSEHOLD' THEN 'added' WHEN 'MACHINERY' THEN 'changed' ELSE 'unchanged' END AS status FROM customer) GROUP BY status",
    "watermark_incremental": "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-16')",
    "flatten_json": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
}
