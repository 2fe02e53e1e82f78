"""Connected components by alternating large-star and small-star steps on an edge table; nothing comes to the driver but counts.

Up to ONE_TASK edges, which one task holds in about 100 MB, are worked on in one task by union-find: the same rows without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batch, cut, map_arrow

ONE_TASK = 1 << 18


def _sign(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, int(r.s or 0)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := least.setdefault(root, root)) != root:
            root = up
        while least[x] != root:
            least[x], x = root, least[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            least[max(a, c)] = min(a, c)
    nodes = list(least)
    for k in range(0, len(nodes), 1 << 14):
        some = nodes[k : k + (1 << 14)]
        yield batch({"node": pa.array(some, pa.int64()), "component": pa.array([find(x) for x in some], pa.int64())})


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of edges (u, v: longs, any order, repeats and loops allowed); component: the least node.

    An empty table gives an empty one. Nodes without an edge to another are not returned.
    """
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    flat = cut(flat)
    sign = _sign(flat)
    if sign[0] <= one_task:
        return map_arrow(flat.coalesce(1), _unite, "node long, component long")
    for _ in range(max_rounds):
        if not sign[0]:
            break
        flat = cut(_small(_large(flat)))
        new = _sign(flat)
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
