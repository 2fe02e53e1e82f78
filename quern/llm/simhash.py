"""Operator 4: SimHash near-duplicates by the generalised pigeonhole principle.

Bits of a fingerprint are grouped into parts so that correlated bits come together. If thresholds t_i >= -1 sum to d - parts + 1, two
fingerprints within distance d agree in some part i up to t_i bits (-1: the part isn't looked at). For each fingerprint, dynamic
programming picks the thresholds of least estimated cost: candidates, from histograms of the parts' halves over all fingerprints,
and probes. It probes the index of exact part values with all values within t_i, and candidates are verified.

Only distinct fingerprints are worked on, so exact copies cost one row. An index bucket over HEAVY fingerprints is not joined with
itself: fingerprints that are in one or probe one go, with all the values within d/2 bits, to groups by such a value. Two
fingerprints are within d exactly if they share one, and a group holds no more than one value's neighbourhood, so this way is exact
and its rows grow in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import setjoin
from quern.llm.common import batch, id_text, map_arrow, numbered, place, stored
from quern.llm.components import components

SEED = 42
HEAVY = 512
HALVES = 2


# ---- fingerprints ----


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of words, lower-cased in A-Z, repeats included; fewer words: of them all; none: empty."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(w) - words + 1)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[min(words, len(w)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, most significant first."""
    out = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64)
        out += bits.sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str, words: int = 3) -> bytes:
    """8 bytes: a bit is 1 if set in over half the hashes; without words all are 0."""
    h = shingle_hashes(text, words)
    return np.packbits(bit_sums(h) * 2 > len(h)).tobytes()


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a long (two's complement) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b"".join(fingerprint(t, words) for t in b.column(1).to_pylist())
            yield batch({"doc_id": b.column(0), "fp": pa.array(np.frombuffer(data, dtype=">u8").astype(np.uint64).view(np.int64))})

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, fp long")


# ---- parts and thresholds ----


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits (0: least significant) in groups of like size; together[i, j]: in how many of n fingerprints bits i and j are both set."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(len(p))), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(left, key=lambda i: (corr[i, left].max(), -i))
        group = [seed]
        while len(group) < size:
            rest = [i for i in left if i not in group]
            group.append(max(rest, key=lambda i: (corr[i, group].mean(), -i)))
        out.append(sorted(group))
        left = [i for i in left if i not in group]
    return out


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of these bits, the first one least significant."""
    out = np.zeros(len(fps), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def within(width: int, radius: int) -> np.ndarray:
    """All masks of a width with at most radius bits."""
    return np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(width), r)], dtype=np.uint64).view(np.int64)


def spread(masks: np.ndarray, bits: list[int]) -> np.ndarray:
    """Masks over a part's bits as masks over the fingerprint's."""
    out = np.zeros(len(masks), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((masks >> k) & 1).astype(np.uint64) << np.uint64(b)
    return out


class Plan:
    """Parts, their halves' histograms, and the choice of thresholds."""

    def __init__(self, parts: list[list[int]], histograms: list[list[np.ndarray]], n: int, distance: int):
        self.parts, self.n, self.distance = parts, n, distance
        self.halves = [[p[: len(p) // HALVES], p[len(p) // HALVES :]] for p in parts]
        # near[i][j][e][v]: the share of fingerprints whose half j of part i is at distance e of v
        self.near = []
        for part, hists in zip(self.halves, histograms, strict=True):
            row = []
            for bits, h in zip(part, hists, strict=True):
                share, values = h / max(n, 1), np.arange(1 << len(bits))
                by = []
                for e in range(distance + 1):
                    masks = [m for m in within(len(bits), e) if m.bit_count() == e]
                    by.append(sum((share[values ^ m] for m in masks), np.zeros(len(values))))
                row.append(by)
            self.near.append(row)

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """For each fingerprint, a threshold of each part: least estimated candidates plus probes, summing to distance - parts + 1."""
        m, d = len(self.parts), self.distance
        costs = []  # costs[i][:, t + 1]
        for i, bits in enumerate(self.parts):
            low, high = (gather(fps, b) for b in self.halves[i])
            exact = [sum(self.near[i][0][a][low] * self.near[i][1][e - a][high] for a in range(e + 1)) * self.n for e in range(d + 1)]
            c = [np.zeros(len(fps))]
            for t in range(d + 1):
                c.append(sum(exact[: t + 1]) + len(within(len(bits), t)))
            costs.append(np.stack(c, axis=1))
        # best[s]: least cost of the parts so far with thresholds + 1 summing to s; the sum wanted is d + 1
        best = np.full((len(fps), d + 2), np.inf)
        best[:, 0] = 0
        came = []
        for c in costs:
            options = np.stack([np.concatenate([np.full((len(fps), k), np.inf), best[:, : d + 2 - k] + c[:, k : k + 1]], axis=1) for k in range(d + 2)])
            came.append(options.argmin(axis=0))
            best = options.min(axis=0)
        at, out = np.full(len(fps), d + 1), np.empty((len(fps), m), dtype=np.int64)
        rows = np.arange(len(fps))
        for i in range(m - 1, -1, -1):
            k = came[i][rows, at]
            out[:, i] = k - 1
            at = at - k
        return out


def _plan(distinct: DataFrame, distance: int, parts: int) -> Plan:
    """From all distinct fingerprints. To the driver: 64 * 64 counts, and the halves' histograms (at most 2**(64/parts/2 + 1) each)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            bits = ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        yield batch({"cell": pa.array(np.arange(4097)), "n": pa.array(np.append(total.ravel(), n).astype(np.int64))})

    cells = map_arrow(distinct.select("fp"), pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().set_index("cell")["n"]
    flat = np.array([cells.get(i, 0) for i in range(4097)], dtype=np.int64)
    n = int(flat[4096])
    groups = correlated_parts(flat[:4096].reshape(64, 64), n, parts)
    halves = [p[: len(p) // HALVES] for p in groups], [p[len(p) // HALVES :] for p in groups]

    def hists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[np.zeros(1 << len(side[i]), dtype=np.int64) for side in halves] for i in range(parts)]
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for i in range(parts):
                for j in range(HALVES):
                    sums[i][j] += np.bincount(gather(fps, halves[j][i]), minlength=len(sums[i][j]))
        cell, num = [], []
        for i in range(parts):
            for j in range(HALVES):
                at = np.flatnonzero(sums[i][j])
                cell.append(at + ((i * HALVES + j) << 40))
                num.append(sums[i][j][at])
        yield batch({"cell": pa.array(np.concatenate(cell)), "n": pa.array(np.concatenate(num))})

    rows = map_arrow(distinct.select("fp"), hists, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, num = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
    out = [[np.zeros(1 << len(halves[j][i]), dtype=np.int64) for j in range(HALVES)] for i in range(parts)]
    for i in range(parts):
        for j in range(HALVES):
            own = cell >> 40 == i * HALVES + j
            out[i][j][cell[own] & ((1 << 40) - 1)] = num[own]
    return Plan(groups, out, n, distance)


# ---- links ----


def links(distinct: DataFrame, *, distance: int = 2, parts: int = 3, heavy: int = HEAVY) -> DataFrame:
    """(u, v) edges between distinct fingerprints (column fp) that link all that are within an even distance; the classes are exact."""
    if distance % 2 or not 0 <= distance <= 4:
        raise ValueError("distance must be 0, 2 or 4")
    spark = distinct.sparkSession
    plan = _plan(distinct, distance, parts)
    shared = spark.sparkContext.broadcast(plan)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            chosen = plan.thresholds(fps)
            part, key, fp, role = [], [], [], []
            for i, bits in enumerate(plan.parts):
                own = gather(fps, bits)
                for t in range(-1, plan.distance + 1):
                    rows = np.flatnonzero(chosen[:, i] == t)
                    masks = within(len(bits), t) if t >= 0 else np.zeros(1, dtype=np.int64)
                    # role 0: index only, 1: index and probe, 2: probe only (a value near the own one)
                    key.append((own[rows, None] ^ masks).ravel())
                    fp.append(np.repeat(fps[rows], len(masks)))
                    role.append(np.tile(np.where(masks == 0, 1 if t >= 0 else 0, 2), len(rows)))
                    part.append(np.full(len(rows) * len(masks), i))
            yield batch({"part": pa.array(np.concatenate(part).astype(np.int32)), "key": pa.array(np.concatenate(key)), "fp": pa.array(np.concatenate(fp).view(np.int64)), "role": pa.array(np.concatenate(role).astype(np.int32))})

    table = stored(map_arrow(distinct.select("fp"), probe, "part int, key long, fp long, role int"), "probes")
    big = stored(table.filter("role < 2").groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy).select("part", "key"), "heavy")
    any_big = bool(big.take(1))
    light = table.join(big, ["part", "key"], "left_anti") if any_big else table
    index = light.filter("role < 2").select("part", "key", F.col("fp").alias("u"))
    probes = light.filter("role > 0").select("part", "key", F.col("fp").alias("v"), "role")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    edges = index.join(probes, (index.part == probes.part) & (index.key == probes.key) & (index.u != probes.v) & near).select("u", "v")
    if not any_big:
        return edges
    balls = within(64, distance // 2).view(np.uint64)

    def neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            yield batch({"value": pa.array((fps[:, None] ^ balls).ravel().view(np.int64)), "fp": pa.array(np.repeat(fps, len(balls)).view(np.int64))})

    dense = table.join(big, ["part", "key"], "left_semi").select("fp").distinct()
    groups = map_arrow(dense, neighbourhood, "value long, fp long").groupBy("value").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    stars = groups.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).filter("u != v").distinct()
    return edges.unionByName(stars)


def near_duplicates(docs: DataFrame, *, words: int = 3, distance: int = 2, parts: int = 3, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id: the least doc_id that links reach, itself included.

    Null or blank texts have fingerprint zero and link like any other. A null doc_id gets its class's component_id (null if all of
    them are null). Repeated rows are returned each. An empty table gives an empty one; other columns are ignored.
    """
    all_fps = stored(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = stored(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    classes = components(links(distinct, distance=distance, parts=parts, heavy=heavy)).select(F.col("node").alias("fp"), "component")
    linked = stored(distinct.join(classes, "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = distinct.join(linked.join(least, "component").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return all_fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# ---- a similarity of shingles ----


def _close(distinct: DataFrame, distance: int) -> DataFrame:
    """(u, v): nodes of equal fingerprints, each with the least of them, and those least ones of fingerprints within the distance."""
    of_fp = distinct.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    equal = distinct.join(of_fp.filter("n > 1").select("fp", F.col("node").alias("u")), "fp").filter("node != u").select("u", F.col("node").alias("v"))
    of_fp = stored(of_fp.select("fp", "node"), "of-fingerprint")
    left, right = (of_fp.select(F.col("fp").alias(f"f{k}"), F.col("node").alias(k)) for k in "uv")
    near = links(of_fp.select("fp"), distance=distance).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    near = near.join(left, "fu").join(right, "fv").select("u", "v")
    return equal.unionByName(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_copies(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, keep): keep is false for documents linked to an earlier one, the least doc_id of each class stays.

    Documents are linked if their sets of word shingles have that Jaccard similarity or more; it is computed, so no other ones are
    linked, and all such links count. Fingerprints within `distance` bits, found as above, give the first pairs to compare. Pairs of
    just 0.8 differ in about 10 of 64 bits, too many for thresholds of parts that find them all, so the rest is found by their shingles
    (setjoin), which is exact.

    A null text is empty; blank texts are copies of each other. Rows with a null doc_id are kept; repeated rows share their doc_id's
    fate; other columns are ignored; an empty table gives an empty one. Of equal texts the least doc_id stays.
    """
    flat = id_text(docs, id_col, text_col).filter("doc_id is not null")
    each = stored(setjoin.described(flat, words), "described")
    distinct = stored(each.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("fp").alias("fp")), "described-distinct")
    hints = stored(_close(distinct, distance), "close")
    classes = setjoin.classes(flat, distinct, hints, words=words, similarity=similarity, **options)
    linked = stored(distinct.select("node", "doc_id").join(classes, "node"), "linked")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_node = distinct.select("node", "doc_id").join(linked.join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "doc_id").alias("least"))
    return each.select("doc_id", "node").join(of_node, "node").groupBy("doc_id").agg(F.min(F.col("doc_id") == F.col("least")).alias("keep"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that near_copies doesn't keep, same columns; rows with a null id stay."""
    gone = stored(near_copies(docs, id_col=id_col, text_col=text_col, **options).filter("not keep").select(F.col("doc_id").alias("_gone")), "gone")
    flat = numbered(docs)
    return flat.join(gone, F.col(f"_c{place(docs, id_col)}").cast("long") == F.col("_gone"), "left_anti").toDF(*docs.columns)
