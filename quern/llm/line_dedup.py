"""Operator 6: line dedup that can be taken back.

A line's key is a 128-bit hash of the stripped line with A-Z lower-cased. An exact table holds every (key, document) reference; keys are
sharded by hash. A key with `min_docs` documents or more is common, and is in its shard's cuckoo filter (two buckets of four 16-bit
marks). Inserting documents adds references and puts keys that become common into the filters; deleting documents takes references away
and takes keys that are common no more out of them, which cuckoo filters allow. A text's lines are first asked of the filters, which
takes no shuffle; the few that may be common are then looked up in the exact table, so that false positives do no harm.

The filters are about 2.2 bytes for each common key, the exact table of common keys 24. Up to BROADCAST_BYTES both are broadcast and a text
is cleaned where it is read. Beyond that only the filters are, and the lines they let pass are joined with the exact table and brought back
to their texts by document; with filters beyond it too, all lines are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import batch, id_text, map_arrow, numbered, place, stored

BROADCAST_BYTES = 64 << 20
SHARDS = 64  # at first; doubled while a shard would hold more than SHARD_KEYS
SHARD_KEYS = 1 << 18
HOT = 1 << 16  # keys with this part of all references or more, HOT at most, are joined by broadcast
SLOTS = 4
_STRIP = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """A set of 64-bit hashes, with false positives of about 8 / 65536; add, remove and contains take arrays.

    A key's mark is 1..65535; its other bucket is the first one xor a hash of the mark. Keys that find no place after MAX_KICKS rounds
    make the table twice as large, from the keys that are given again.
    """

    MAX_KICKS = 200

    def __init__(self, capacity: int = 64):
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.slots = np.zeros((self.buckets, SLOTS), dtype=np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        mark = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def _put(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of these buckets; which found one."""
        done = np.zeros(len(bucket), dtype=bool)
        for s in range(SLOTS):
            rest = np.flatnonzero(~done)
            free = rest[self.slots[bucket[rest], s] == 0]
            _, first = np.unique(bucket[free], return_index=True)  # one for each bucket and round
            won = free[first]
            self.slots[bucket[won], s] = mark[won]
            done[won] = True
        return done

    def add(self, keys: np.ndarray) -> bool:
        """Add distinct keys that aren't in it. False: full; the filter must be built anew, larger."""
        mark, one, two = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for k in range(self.MAX_KICKS):
            for second in (False, True):
                left = ~self._put(two if second else one, mark)
                mark, one, two = mark[left], one[left], two[left]
            if not len(mark):
                return True
            if k < 8:
                continue  # several keys of a bucket: one slot of each column goes in each round
            bucket, first = np.unique(np.where(rng.random(len(one)) < 0.5, one, two), return_index=True)
            slot = rng.integers(0, SLOTS, len(bucket))
            out = self.slots[bucket, slot].copy()
            self.slots[bucket, slot] = mark[first]
            mark[first] = out
            one[first], two[first] = bucket, self._other(bucket, out)
            keep = mark > 0
            mark, one, two = mark[keep], one[keep], two[keep]
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were added."""
        mark, one, two = self._places(keys)
        for m, a, b in zip(mark, one, two, strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.slots[bucket] == m)
                if len(hit):
                    self.slots[bucket, hit[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.slots[one] == mark[:, None]) | (self.slots[two] == mark[:, None])).any(axis=1)

    def tobytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.slots = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        out.buckets = len(out.slots)
        return out

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = max(64, len(keys))
        while not (f := cls(capacity)).add(keys):
            capacity *= 2
        return f


def ask_filters(filters: dict[int, CuckooFilter], k1: np.ndarray, k2: np.ndarray, shards: int) -> np.ndarray:
    """Which keys may be common."""
    maybe, shard = np.zeros(len(k1), dtype=bool), k2 % shards
    for s in np.unique(shard).tolist():
        if s in filters:
            at = np.flatnonzero(shard == s)
            maybe[at] = filters[s].contains(k1[at].view(np.uint64))
    return maybe


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a line (UTF-8) of at least min_chars code points when stripped; else None."""
    line = line.strip(_STRIP)
    if len(line) < min_chars or len(line) < 4 * min_chars and not line.isascii() and len(line.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def _columns(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def references(docs: DataFrame, *, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id): each document's distinct keys, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, counts = [], []
            for text in b.column(1).to_pylist():
                own = {k for line in text.encode("utf-8", "surrogatepass").split(b"\n") if (k := key_of(line, min_chars))}
                digests += own
                counts.append(len(own))
            k1, k2 = _columns(digests)
            yield batch({"k1": pa.array(k1), "k2": pa.array(k2), "doc_id": b.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))})

    return map_arrow(id_text(docs, id_col, text_col), run, "k1 long, k2 long, doc_id long")


class LineIndex:
    """The state: `refs` (k1, k2, doc_id), `common` (k1, k2, n_docs, keeper) and `filters` (shard, data), tables in the shared folder.

    A row of documents is a document: rows that repeat a doc_id count each. keeper: the largest doc_id that holds the key.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40, shards: int = SHARDS, broadcast_bytes: int = BROADCAST_BYTES):
        self.spark, self.min_docs, self.min_chars, self.shards, self.broadcast_bytes = spark, min_docs, min_chars, shards, broadcast_bytes
        self.refs = spark.createDataFrame([], "k1 long, k2 long, doc_id long")
        self.common = spark.createDataFrame([], "k1 long, k2 long, n_docs long, keeper long")
        self.filters = spark.createDataFrame([], "shard int, data binary")

    def insert(self, docs: DataFrame, *, keep_references: bool = True, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add documents. Without keep_references the references are counted only and no later change is possible."""
        new = references(docs, min_chars=self.min_chars, id_col=id_col, text_col=text_col)
        self._changeable()
        if keep_references:
            return self._turn(stored(self.refs.unionByName(new), "refs"))
        return self._turn(new, keep=False)

    def _changeable(self) -> None:
        if self.refs is None:
            raise ValueError("this index was made without references and can't be changed")

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take away the documents of a table with one column of ids; what they made common is so no more."""
        self._changeable()
        gone = doc_ids.toDF("doc_id").select(F.col("doc_id").cast("long")).distinct()
        return self._turn(stored(self.refs.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id"), "refs"))

    def _turn(self, refs: DataFrame, keep: bool = True) -> LineIndex:
        """The exact table of common keys for these references; filters get what has changed."""
        before, had_filters = self.common, self.filters
        common = stored(refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= self.min_docs), "common")
        shards, n = self.shards, common.count()
        while n > self.shards * SHARD_KEYS:
            self.shards *= 2
        if self.shards != shards:  # all filters are built anew
            before, had_filters = before.limit(0), had_filters.limit(0)
        shard = F.pmod(F.col("k2"), F.lit(self.shards)).cast("int").alias("shard")
        added = common.join(before, ["k1", "k2"], "left_anti").select(shard, "k1", F.lit(1).alias("sign"))
        removed = before.join(common, ["k1", "k2"], "left_anti").select(shard, "k1", F.lit(-1).alias("sign"))
        still = common.join(before, ["k1", "k2"], "left_semi").select(shard, "k1", F.lit(0).alias("sign"))

        def change(key, old: pa.Table, keys: pa.Table) -> pa.Table:
            k, sign = (keys.column(i).to_numpy().view(np.int64) for i in (1, 2))
            k = k.view(np.uint64)
            f = CuckooFilter.frombytes(old.column(1)[0].as_py()) if old.num_rows else None
            if f is not None:
                f.remove(k[sign == -1])
                if not f.add(k[sign == 1]):
                    f = None
            f = f or CuckooFilter.of(k[sign >= 0])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([f.tobytes()], pa.binary())})

        keys = added.unionByName(removed).unionByName(still).select("shard", "k1", F.col("sign").cast("long").alias("sign"))
        self.filters = stored(had_filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(change, "shard int, data binary"), "filters")
        self.common = common
        self.refs = refs if keep else None
        return self

    def drops(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, row, lines): for rows with lines to drop, the numbers (from 0) of these lines. row: Spark's xxhash64 of the text."""
        shared, min_chars, shards = self._broadcast_filters(), self.min_chars, self.shards

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = None if shared.value is None else {s: CuckooFilter.frombytes(d) for s, d in shared.value.items()}
            for b in batches:
                digests, row, number = [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    for j, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                        if (k := key_of(line, min_chars)) is not None:
                            digests.append(k)
                            row.append(i)
                            number.append(j)
                k1, k2 = _columns(digests)
                row, number = np.array(row, dtype=np.int64), np.array(number, dtype=np.int32)
                if sets is not None:
                    maybe = ask_filters(sets, k1, k2, shards)
                    k1, k2, row, number = k1[maybe], k2[maybe], row[maybe], number[maybe]
                yield batch({"k1": pa.array(k1), "k2": pa.array(k2), "doc_id": b.column(0).take(pa.array(row)), "row": b.column(2).take(pa.array(row)), "line": pa.array(number)})

        asked = stored(map_arrow(id_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text")), ask, "k1 long, k2 long, doc_id long, row long, line int"), "asked")
        total = self.common.agg(F.sum("n_docs").alias("n")).first().n or 0
        hot = self.common.filter(F.col("n_docs") * HOT >= total)
        rest = asked.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti").join(self.common, ["k1", "k2"])
        found = asked.join(F.broadcast(hot), ["k1", "k2"]).unionByName(rest)
        # A null doc_id is never the largest, so such rows lose the line where any other holds it.
        hit = found.filter(F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return hit.groupBy("doc_id", "row").agg(F.collect_set("line").alias("lines"))

    def apply(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with the kept text in its column, and two columns more: n_lines (before dropping) and n_dropped, longs.

        Columns of docs that have one of these two names are left out.
        """
        if others := [i for i, c in enumerate(docs.columns) if c.lower() not in ("n_lines", "n_dropped")]:
            docs = numbered(docs).select(*[f"_c{i}" for i in others]).toDF(*[docs.columns[i] for i in others])
        size = self.common.count() * 24
        if size <= self.broadcast_bytes:
            return self._apply_broadcast(docs, id_col, text_col)
        return self._apply_joined(docs, id_col, text_col)

    def _broadcast_filters(self):
        """The filters by shard, or None beyond the bound."""
        size = self.filters.agg(F.sum(F.length("data")).alias("n")).first().n or 0
        return self.spark.sparkContext.broadcast({r.shard: bytes(r.data) for r in self.filters.collect()} if size <= self.broadcast_bytes else None)

    def _apply_broadcast(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """One pass over docs; only for a table of common keys of a checked size."""
        rows = self.common.select("k1", "k2", "keeper").toArrow()
        order = np.argsort(k1 := rows.column("k1").to_numpy(), kind="stable")
        keeper = rows.column("keeper")
        exact = k1[order], rows.column("k2").to_numpy()[order], keeper.fill_null(0).to_numpy()[order], keeper.is_valid().to_numpy()[order]
        shared, filters, min_chars, shards = self.spark.sparkContext.broadcast(exact), self._broadcast_filters(), self.min_chars, self.shards
        flat, names = numbered(docs), docs.columns
        width, spot = len(names), place(docs, text_col)
        flat = flat.withColumn(f"_c{spot}", F.coalesce(F.col(f"_c{spot}").cast("string"), F.lit(""))).withColumn("_id", F.col(f"_c{place(docs, id_col)}").cast("long"))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e1, e2, keep, valid = shared.value
            sets = {s: CuckooFilter.frombytes(d) for s, d in (filters.value or {}).items()}
            for b in batches:
                digests, row, number = [], [], []
                texts, ids = b.column(spot), b.column(width)
                for i, text in enumerate(texts.to_pylist()):
                    for j, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                        if (k := key_of(line, min_chars)) is not None:
                            digests.append(k)
                            row.append(i)
                            number.append(j)
                k1, k2 = _columns(digests)
                some = np.flatnonzero(ask_filters(sets, k1, k2, shards))
                changed: dict[int, set[int]] = {}
                first, last = np.searchsorted(e1, k1[some], "left"), np.searchsorted(e1, k1[some], "right")
                own = ids.to_pylist() if len(some) else []
                for at, lo, hi in zip(some.tolist(), first.tolist(), last.tolist(), strict=True):
                    for e in range(lo, hi):
                        if e2[e] == k2[at] and valid[e] and own[row[at]] != keep[e]:
                            changed.setdefault(row[at], set()).add(number[at])
                mask, dropped, kept = np.zeros(b.num_rows, dtype=bool), np.zeros(b.num_rows, dtype=np.int64), []
                for i in sorted(changed):
                    gone = changed[i]
                    mask[i], dropped[i] = True, len(gone)
                    kept.append("\n".join(x for j, x in enumerate(texts[i].as_py().split("\n")) if j not in gone))
                cols = [*b.columns[:width], pc.cast(pc.add(pc.count_substring(texts, "\n"), 1), pa.int64()), pa.array(dropped)]
                cols[spot] = pc.replace_with_mask(texts, pa.array(mask), pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*[f"_c{i}" for i in range(width)], "n_lines", "n_dropped"])

        kinds = [f"_c{i} {'string' if i == spot else f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
        return map_arrow(flat, clean, ", ".join([*kinds, "n_lines long", "n_dropped long"])).toDF(*names, "n_lines", "n_dropped")

    def _apply_joined(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        drops = stored(self.drops(docs, id_col=id_col, text_col=text_col), "drops")
        flat, names = numbered(docs), docs.columns
        width, spot = len(names), place(docs, text_col)
        key, text = F.col(f"_c{place(docs, id_col)}").cast("long"), F.coalesce(F.col(f"_c{spot}").cast("string"), F.lit(""))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, lines = b.column(spot), b.column(width)
                changed, dropped = [], np.zeros(b.num_rows, dtype=np.int64)
                for i in np.flatnonzero(lines.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    gone = set(lines[i].as_py())
                    changed.append("\n".join(x for j, x in enumerate(texts[i].as_py().split("\n")) if j not in gone))
                    dropped[i] = len(gone)
                cols = [*b.columns[:width], pc.cast(pc.add(pc.count_substring(texts, "\n"), 1), pa.int64()), pa.array(dropped)]
                cols[spot] = pc.replace_with_mask(texts, pa.array(dropped > 0), pa.array(changed, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*[f"_c{i}" for i in range(width)], "n_lines", "n_dropped"])

        marked = drops.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "lines")
        flat = flat.withColumn(f"_c{spot}", text)
        joined = flat.join(marked, key.eqNullSafe(F.col("_id")) & (F.xxhash64(f"_c{spot}") == F.col("_row")), "left").select(*flat.columns, "lines")
        kinds = [f"_c{i} {'string' if i == spot else f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
        return map_arrow(joined, clean, ", ".join([*kinds, "n_lines long", "n_dropped long"])).toDF(*names, "n_lines", "n_dropped")


def dedup(docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with their kept texts, n_lines and n_dropped: one turn of a new index, its table of references included.

    Keys of at least min_chars code points in at least min_docs documents lose all their lines but those of the largest doc_id that holds
    them. A null or empty text is one empty line; the lines that stay are joined by newlines. Rows that repeat a doc_id are documents
    each, and all of them keep the lines of the largest doc_id. An empty table stays empty; other columns are returned as they are,
    but for ones named n_lines or n_dropped, which are left out.
    """
    index = LineIndex(docs.sparkSession, min_docs, min_chars, **options).insert(docs, id_col=id_col, text_col=text_col)
    return index.apply(docs, id_col=id_col, text_col=text_col)
