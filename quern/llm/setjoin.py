"""Classes of texts whose sets of word shingles have at least a given Jaccard similarity: exact, by prefix filtering.

All shingles have one order: rare ones first, by the number of sets that hold them; very common ones (a bounded list, found in a sample
of documents) last. Two sets of n and m shingles with that similarity have at least a = s / (1 + s) * (n + m) in common, so the first
one they share stands at place n - a + 1 or before in one and m - a + 1 or before in the other. Only these places need looking at, and
shingles of one set only, the bulk of any text, have no bucket. Any order gives the same classes; this one makes buckets small, and a
passage that many otherwise different texts share makes none, as their own shingles come first.

Shingles travel as 56 bits in compressed blobs: each batch of texts sends each part of the hash range one row, which returns with those
of two sets or more.

A bucket's members are not all compared with each other: first each with the bucket's hub, the member whose place is least (the fewest
rare shingles: of a family of edited copies the one they come from). Buckets that still hold several classes then get further hubs, from
outside their largest class, and in the end every pair of different classes that the places allow is compared, so no link is lost. Rows
are in proportion to the shingles but for that last step, which costs, in a bucket, members times those outside its largest class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batch, cut, map_arrow, stored
from quern.llm.components import components
from quern.llm.tokens import groups

SEED = 42
SHORT = np.uint64(8)  # bits of a hash that are left out where shingles are looked up; found pairs are compared by whole ones
SAMPLE = 1 << 20  # shingles of the documents in which very common ones are looked for
COMMON = 16  # sets of that sample that hold one; so the list has SAMPLE / COMMON of 8 bytes at most
PART = 1 << 19  # shingles in a part of the hash range
BROADCAST_IDS = 1 << 20
BLOCK = 1024
DIRECT = 256  # comparisons for each row of the buckets that are made without looking for further hubs


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte of their values (so that bytes which hardly vary take no room), compressed."""
    data = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, width, at, out = int.from_bytes(blob[:4], "little"), [np.dtype(k).itemsize for k in kinds], 0, []
    data = np.frombuffer(pa.decompress(blob[4:], n * sum(width), codec="zstd"), dtype=np.uint8)
    for k, w in zip(kinds, width, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * w].reshape(w, n).T).reshape(-1).view(k))
        at += n * w
    return out


class _Words(dict):
    """Hashes of words; it is emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h

    def of(self, words: list[list[bytes]], n: int) -> np.ndarray:
        if len(self) > 1 << 18:
            self.clear()
        return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=n)


_words = _Words()


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's runs of words (A-Z lower-cased; fewer words: of them all; none: empty), sorted."""
    for some in groups(texts):
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in some]
        ends = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        flat = _words.of(split, int(ends[-1]))
        runs = np.zeros(max(0, len(flat) - words + 1), dtype=np.uint64)
        for k in range(words):
            runs = _joined(runs, flat[k : k + len(runs)])
        for w, end in zip(split, ends.tolist(), strict=True):
            begin = end - len(w)
            if len(w) >= words:
                yield np.unique(runs[begin : end - words + 1])
            else:
                h = np.zeros(min(1, len(w)), dtype=np.uint64)
                for x in flat[begin:end]:
                    h = _joined(h, x)
                yield h


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)).astype(np.int64))


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if over half a set's hashes have it."""
    out = np.zeros(len(sets), dtype=np.uint64)
    for i, h in enumerate(sets):
        on = np.zeros(64, dtype=np.int64)
        for k in range(0, len(h), 1 << 14):
            on += np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(on * 2 > len(h)).view(">u8")[0]
    return out


def described(flat: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, size, fp) of (doc_id, text): the set's number, how many shingles it has, its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, fp = [], [], []
            sets: list[np.ndarray] = []
            for h in shingle_sets(b.column(1).to_pylist(), words):
                node.append(set_id(h))
                size.append(len(h))
                sets.append(h)
                if len(sets) == 64:
                    fp.append(majority(sets))
                    sets = []
            fps = np.concatenate([*fp, majority(sets)]).view(np.int64)
            yield batch({"doc_id": b.column(0), "node": pa.array(node, pa.int64()), "size": pa.array(size, pa.int32()), "fp": pa.array(fps)})

    return map_arrow(flat, run, "doc_id long, node long, size int, fp long")


def _fresh(b: pa.RecordBatch, words: int, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Sets of a batch that this task has not met yet; empty ones have no shingle to share."""
    for h in shingle_sets(b.column(1).to_pylist(), words):
        if len(h) and (n := set_id(h)) not in seen:
            seen.add(n)
            yield n, h


def common_shingles(flat: DataFrame, words: int, total: int) -> np.ndarray:
    """Shingles that COMMON sets or more of a sample hold, the commonest last; sorted by (how many, hash)."""
    every = max(1, ceil(total / SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets = [h for _, h in _fresh(b, words, seen)]
            t, n = np.unique(np.concatenate(sets) >> SHORT, return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield batch({"t": pa.array(t.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    some = flat.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    got = map_arrow(some, run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).toArrow()
    t, n = got.column("t").to_numpy().view(np.uint64), got.column("n").to_numpy()
    return t[np.lexsort((t, n))]


def _lead(size: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's first shingles must hold one of any set of that similarity."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def prefixes(flat: DataFrame, *, words: int, similarity: float, total: int) -> DataFrame:
    """(t, node, size, place): the shingles among each set's first ones that two sets or more may hold, and their places from 1.

    A set may come several times. total: of all sets' sizes. If a task that is run again finds its rows in another order, batches no
    longer fit together; that is noticed and an error.
    """
    spark = flat.sparkSession
    common = common_shingles(flat, words, total)
    by_hash = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[by_hash], by_hash))
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / PART))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rank = shared.value
        seen: set[int] = set()
        for b in batches:
            fresh = list(_fresh(b, words, seen))
            if not fresh:
                continue
            nodes, sets = np.array([n for n, _ in fresh], dtype=np.int64), [h for _, h in fresh]
            size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            t, row = np.concatenate(sets) >> SHORT, np.repeat(np.arange(len(sets)), size)
            at = np.searchsorted(hashes, t)
            often = np.zeros(len(t), dtype=bool) if not len(hashes) else hashes[np.minimum(at, len(hashes) - 1)] == t
            plain = np.bincount(row[~often], minlength=len(sets))
            # Places of the common ones don't depend on the others' order.
            rows, ranks, ts = row[often], rank[at[often]], t[often]
            order = np.lexsort((ranks, rows))
            rows, ts = rows[order], ts[order]
            first = np.searchsorted(rows, np.arange(len(sets)))
            place = plain[rows] + 1 + np.arange(len(rows)) - first[rows]
            some = place <= _lead(size, similarity)[rows]
            own = np.array([len(sets), int(some.sum())], dtype="<i8").tobytes()
            info = own + nodes.astype("<i8").tobytes() + size.astype("<i4").tobytes() + plain.astype("<i4").tobytes() + rows[some].astype("<u2").tobytes() + place[some].astype("<i4").tobytes() + ts[some].astype("<u8").tobytes()
            key = xxhash.xxh64_intdigest(nodes.tobytes(), SEED)
            t, row = t[~often], row[~often]
            part = (t % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((t, part))
            part, t, row = part[order], t[order].astype("<u8"), row[order].astype("<u2")
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, dtype=np.int64)
            blobs = [packed(t[i:j], row[i:j]) for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=False)]
            signed = int(np.uint64(key).astype(np.int64))
            yield batch({"part": pa.array([-1 - key % parts, *part[begin].tolist()], pa.int64()), "batch": pa.array([signed] * (1 + len(blobs)), pa.int64()), "blob": pa.array([info, *blobs], pa.binary())})

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """seen: shingles of this batch here (-1: the batch's own row, passed on); blob: those of two sets or more, rows, how many."""
        if key[0].as_py() < 0:
            return pa.table({"batch": table.column("batch"), "seen": pa.array([-1] * table.num_rows, pa.int64()), "blob": table.column("blob")})
        ts, rows = zip(*[unpacked(x, "<u8", "<u2") for x in table.column("blob").to_pylist()], strict=True)
        n, t, row = np.array([len(x) for x in ts], dtype=np.int64), np.concatenate(ts), np.concatenate(rows)
        order = np.argsort(t, kind="stable")
        begin = np.flatnonzero(np.append(True, t[order][1:] != t[order][:-1]))
        each = np.diff(np.append(begin, len(t)))
        many = np.empty(len(t), dtype=np.int64)
        many[order] = np.repeat(each, each)
        keep, source = many > 1, np.repeat(np.arange(len(n)), n)
        edge = np.searchsorted(source[keep], np.arange(len(n) + 1)).tolist()
        t, row, many = t[keep], row[keep], np.minimum(many[keep], (1 << 32) - 1).astype("<u4")
        out = [packed(t[i:j], many[i:j], row[i:j]) if i < j else b"" for i, j in zip(edge, edge[1:], strict=False)]
        return pa.table({"batch": table.column("batch"), "seen": pa.array(n), "blob": pa.array(out, pa.binary())})

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        seen, blobs = table.column("seen").to_numpy(), table.column("blob").to_pylist()
        infos = [x for x, s in zip(blobs, seen.tolist(), strict=True) if s < 0]
        rest = [x for x, s in zip(blobs, seen.tolist(), strict=True) if s >= 0]
        if not infos:
            raise RuntimeError("a batch of texts changed while it was worked on: its rows came in another order")
        info = infos[0]
        n, m = np.frombuffer(info, dtype="<i8", count=2).tolist()
        at, fields = 16, []
        for kind, k in (("<i8", n), ("<i4", n), ("<i4", n), ("<u2", m), ("<i4", m), ("<u8", m)):
            fields.append(np.frombuffer(info, dtype=kind, count=k, offset=at))
            at += k * np.dtype(kind).itemsize
        nodes, size, plain, h_row, h_place, h_t = fields
        if int(seen[seen >= 0].sum()) != len(infos) * int(plain.sum()):
            raise RuntimeError("a batch of texts changed while it was worked on: its rows came in another order")
        shared = [unpacked(x, "<u8", "<u4", "<u2") for x in rest if x]
        t, many, row = (np.concatenate([np.empty(0, kind), *[x[i] for x in shared]]) for i, kind in enumerate(("<u8", "<u4", "<u2")))
        row = row.astype(np.int64)
        order = np.lexsort((t, many, row))
        t, row = t[order], row[order]
        if len(infos) > 1:  # equal batches have one name
            once = np.append(True, (t[1:] != t[:-1]) | (row[1:] != row[:-1])) if len(t) else np.empty(0, dtype=bool)
            t, row = t[once], row[once]
        held = np.bincount(row, minlength=n)
        where = (plain - held)[row] + 1 + np.arange(len(row)) - (np.cumsum(held) - held)[row]
        some = where <= _lead(size.astype(np.int64), similarity)[row]
        rows = np.concatenate([row[some], h_row.astype(np.int64)])
        return pa.table({"t": pa.array(np.concatenate([t[some], h_t]).view(np.int64)), "node": pa.array(nodes[rows]), "size": pa.array(size[rows]), "place": pa.array(np.concatenate([where[some], h_place]).astype(np.int32))})

    sent = map_arrow(flat, send, "part long, batch long, blob binary")
    back = sent.groupBy("part").applyInArrow(count, "batch long, seen long, blob binary")
    return back.groupBy("batch").applyInArrow(place, "t long, node long, size int, place int")


def sets_of(flat: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of nodes (node, doc_id): the sets, computed again from the texts of these documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, out = [], []
            for n, h in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), words), strict=True):
                if set_id(h) == n:  # another row may have the same doc_id
                    node.append(n)
                    out.append(h.astype("<u8").tobytes())
            yield batch({"node": pa.array(node, pa.int64()), "hashes": pa.array(out, pa.binary())})

    n = nodes.count()
    sets = stored(map_arrow(flat.join(F.broadcast(nodes) if n <= BROADCAST_IDS else nodes, "doc_id").select("node", "text"), run, "node long, hashes binary"), "sets")
    return sets if sets.count() == n else stored(sets.dropDuplicates(["node"]), "sets-once")  # a repeated row comes twice


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have that Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype="<u8") if len(s.as_buffer()) else np.empty(0, "<u8") for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch({"u": b.column(0).filter(pa.array(ok, pa.bool_())), "v": b.column(1).filter(pa.array(ok, pa.bool_()))})

    left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}")) for k in "uv")
    return map_arrow(pairs.join(left, "u").join(right, "v").select("u", "v", "hu", "hv"), run, "u long, v long")


def _allowed(a: str, b: str, similarity: float) -> F.Column:
    """Whether this may be the first shingle that two aliased rows of a bucket share, if they have that similarity."""
    least = F.ceil((F.col(f"{a}.size") + F.col(f"{b}.size")) * (similarity / (1 + similarity)) - 1e-9)
    return (F.col(f"{a}.size") - F.col(f"{a}.place") + 1 >= least) & (F.col(f"{b}.size") - F.col(f"{b}.place") + 1 >= least)


def _ordered(both: DataFrame) -> DataFrame:
    return both.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def classes(flat: DataFrame, distinct: DataFrame, hints: DataFrame, *, words: int, similarity: float, block: int = BLOCK, direct: int = DIRECT) -> DataFrame:
    """(node, component) of all sets linked to another one, directly or by others; component: the least node.

    flat: (doc_id, text); distinct: (node, doc_id, size), a row for each set with the least doc_id that has it; hints: (u, v) pairs of
    nodes that are likely to be linked, compared first.
    """
    total = int(distinct.agg(F.sum("size").alias("n")).first().n or 0)
    rows = stored(prefixes(flat, words=words, similarity=similarity, total=total).dropDuplicates(["t", "node"]), "prefixes")
    least = F.min_by(F.struct("node", "size", "place"), F.struct("place", "node"))
    hubs = stored(rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), least.alias("hub")).filter("n > 1").select("t", "hub.*"), "hubs")
    live = rows.join(hubs.select("t"), "t", "left_semi")

    def with_hub(members: DataFrame, hubs: DataFrame, other: F.Column) -> DataFrame:
        return _ordered(members.alias("a").join(hubs.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.node") != F.col("b.node")) & other & _allowed("a", "b", similarity)))

    live = stored(live, "buckets")
    tried = stored(with_hub(live, hubs, F.lit(True)).unionByName(hints.select("u", "v")).distinct(), "pairs")
    needed = live.select("node").union(hints.select("u")).union(hints.select("v")).toDF("node").distinct()
    sets = sets_of(flat, stored(distinct.select("node", "doc_id").join(needed, "node"), "needed"), words)
    edges = cut(alike(tried, sets, similarity))
    found, last = stored(components(edges), "classes"), False
    rows_live = live.count()
    while not last:
        held = live.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        kinds = held.groupBy("t", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("t").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("kinds"))
        mixed = stored(held.join(kinds.filter("kinds > 1").drop("kinds"), "t"), "mixed")
        work = mixed.groupBy("t").agg((F.max("n") * (F.max("n") - F.max("most"))).alias("w")).agg(F.sum("w").alias("w")).first().w
        if not work:
            break
        apart, outside = F.col("a.component") != F.col("b.component"), mixed.filter("component != largest")
        last = work <= direct * rows_live
        if not last:
            hub = outside.groupBy("t").agg(F.min_by(F.struct("node", "size", "place", "component"), F.struct("place", "node")).alias("hub")).select("t", "hub.*")
            pairs = with_hub(mixed, hub, apart)
        if last or not (pairs := stored(pairs.join(tried, ["u", "v"], "left_anti"), "more")).take(1):
            last, blocks = True, F.ceil(F.col("n") / block).cast("int")
            each = mixed.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
            others = outside.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
            both = each.alias("a").join(others.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.block") == F.col("b.block")) & apart & _allowed("a", "b", similarity))
            pairs = stored(_ordered(both).join(tried, ["u", "v"], "left_anti"), "more")
        more = cut(alike(pairs, sets, similarity))
        if more.take(1):
            edges = cut(edges.unionByName(more))
            found = stored(components(edges), "classes")
        tried = tried.unionByName(pairs)
    return found
