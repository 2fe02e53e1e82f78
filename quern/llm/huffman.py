"""Operator 5: token ids in files of canonical, length-limited Huffman codes.

Write: texts are encoded and their ids kept in a table in the shared folder; ids are counted over all of it; package-merge gives code
lengths of at most MAX_BITS; documents, range-partitioned and sorted by id (then as they came), go to one file a partition, of about FILE_IDS
ids or, with few, one for each shuffle partition. A file is

    8 bytes magic, 4 bytes header length, JSON header (code lengths, compressed), blocks

and a block, which can be decoded by itself,

    5 little-endian unsigned 32-bit numbers: documents, ids, checkpoints, payload bytes, ids of the first document before it
    for each document: id (int64), null flag (1 byte), ids in this block (uint32)
    bit offsets of every STEP-th id (uint32), payload bits, most significant first

A block ends after BLOCK ids, within a document too. Only files named in the manifest, a row for each committed task, count; what
a lost task has left is not read. Read: the code table has 2**MAX_BITS entries; all checkpoints of a block are decoded side by side.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import batch, id_text, map_arrow, open_fs, shared_dir, stored
from quern.llm.packing import encode_partitions
from quern.llm.tokens import tokenizer

MAGIC = b"QHUFFID1"
MAX_BITS = 16
BLOCK = 1 << 16
STEP = 64
FILE_IDS = 1 << 25  # about so many ids in a file


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Package-merge: the best prefix code's lengths (uint8; 0 for ids that don't occur) of at most max_bits."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, leaf_levels = weights, []
    for _ in range(max_bits):
        leaf_levels.append(level)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        level = np.sort(np.concatenate([weights, pairs]), kind="stable")
    # Of each level, the cheapest `take` items: leaves among them get a bit, packages take twice as many of the level below.
    take = 2 * n - 2
    out = np.zeros(n, dtype=np.int64)
    for depth in range(max_bits - 1, -1, -1):
        below = leaf_levels[depth - 1] if depth else np.empty(0)
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        leaf = np.argsort(merged, kind="stable")[:take] < n
        leaves = int(leaf.sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    sizes = lengths[order].astype(int).tolist()
    values = []
    for size in sizes:
        code <<= size - last
        values.append(code)
        code, last = code + 1, size
    codes[order] = values
    return codes


def pack_bits(codes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes one after another; the bit at which each begins."""
    ends = np.cumsum(sizes, dtype=np.int64)
    begins = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros((total + 31) // 32 + 1, dtype=np.uint32)
    word, shift = begins >> 5, (64 - (begins & 31) - sizes).astype(np.uint64)
    wide = codes << shift
    for part, k in (((wide >> np.uint64(32)).astype(np.uint32), 0), (wide.astype(np.uint32), 1)):
        if len(word):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            words[word[first] + k] |= np.bitwise_or.reduceat(part, first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], begins


class Decoder:
    def __init__(self, lengths: np.ndarray, max_bits: int = MAX_BITS):
        codes = canonical(lengths)
        self.bits = max_bits
        self.symbol = np.zeros(1 << max_bits, dtype=np.uint32)
        self.size = np.ones(1 << max_bits, dtype=np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = (1 << (max_bits - lengths[order].astype(np.int64))).astype(np.int64)
        full = np.repeat(order, spans)
        at = int(codes[order[0]]) if len(order) else 0
        self.symbol[at : at + len(full)] = full
        self.size[at : at + len(full)] = lengths[full]

    def ids(self, payload: bytes, starts: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
        """n ids; every step-th begins at a bit of starts."""
        data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at = starts.astype(np.int64)
        out = np.zeros((step, len(at)), dtype=np.uint32)
        top = (len(window) - 1) * 8
        down, mask = 32 - self.bits, (1 << self.bits) - 1
        for k in range(step):
            at = np.minimum(at, top)
            peek = (window[at >> 3] >> (down - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.symbol[peek]
            at = at + self.size[peek]
        return out.T.ravel()[:n]


def write_block(docs: list[tuple[int | None, int]], ids: np.ndarray, before: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, begins = pack_bits(codes[ids], lengths[ids].astype(np.int64))
    marks = begins[::STEP].astype("<u4")
    head = struct.pack("<5I", len(docs), len(ids), len(marks), len(payload), before)
    keys = np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes() + bytes(d is None for d, _ in docs) + np.array([n for _, n in docs], dtype="<u4").tobytes()
    return head + keys + marks.tobytes() + payload


def read_block(f, decoder: Decoder) -> tuple[list[int | None], np.ndarray, np.ndarray, int] | None:
    """Of the next block: document ids, their numbers of ids here, all ids, the first document's ids before it."""
    head = f.read(20)
    if not head:
        return None
    docs, n, marks, size, before = struct.unpack("<5I", head)
    keys, null = np.frombuffer(f.read(8 * docs), dtype="<i8"), f.read(docs)
    counts = np.frombuffer(f.read(4 * docs), dtype="<u4").astype(np.int64)
    starts = np.frombuffer(f.read(4 * marks), dtype="<u4")
    ids = decoder.ids(f.read(size), starts, n) if n else np.empty(0, dtype=np.uint32)
    return [None if z else k for k, z in zip(keys.tolist(), null, strict=True)], counts, ids, before


def count_ids(encoded: DataFrame, width: int, size: int) -> np.ndarray:
    """How often each id occurs in all rows; a row for each id and task is summed, a row for each id comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            data = b"".join(b.column(0).to_pylist())
            total += np.bincount(np.frombuffer(data, dtype=f"<u{width}"), minlength=size)
        at = np.flatnonzero(total)
        yield batch({"id": pa.array(at), "n": pa.array(total[at])})

    counts = np.zeros(size, dtype=np.int64)
    rows = map_arrow(encoded.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def write(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ids of all documents in ascending id order (nulls first) under path; the manifest, in that order.

    Manifest: part, file, n_docs, n_ids, start (ids in the files before). A null or empty text has the end id only; rows with equal
    ids stay apart, next to each other; an empty table gives an empty manifest. Ids are cast to long; other columns are ignored.
    """
    spark = docs.sparkSession
    tok = tokenizer(tokenizer_path)
    width, size = tok.dtype.itemsize, tok.library.get_vocab_size(with_added_tokens=True)
    encoded = stored(encode_partitions(id_text(docs, id_col, text_col), tokenizer_path, end_id).select("doc_id", "ids", "part", "part_start"), "ids")
    counts = count_ids(encoded, width, max(size, (end_id or 0) + 1))
    lengths = code_lengths(counts)
    header = json.dumps({"version": 1, "max_bits": MAX_BITS, "step": STEP, "end_id": end_id, "lengths": base64.b64encode(zlib.compress(lengths.tobytes())).decode()}).encode()
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), header))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes, header = shared.value
        part, file, f = TaskContext.get().partitionId(), None, None
        n_docs = n_ids = 0
        held: list[np.ndarray] = []
        keys: list[tuple[int | None, int]] = []
        room, before = BLOCK, 0
        for b in batches:
            if f is None and b.num_rows:
                file = f"{path.rstrip('/')}/part-{part:05d}-{uuid.uuid4().hex}.qhf"
                fs, inner = open_fs(file)
                fs.create_dir(inner.rpartition("/")[0], recursive=True)
                f = fs.open_output_stream(inner, compression=None)
                f.write(MAGIC + struct.pack("<I", len(header)) + header)
            for doc, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, done = np.frombuffer(blob, dtype=f"<u{width}"), 0
                n_docs, n_ids = n_docs + 1, n_ids + len(ids)
                while True:
                    some = ids[done : done + room]
                    if not keys:
                        before = done
                    keys.append((doc, len(some)))
                    held.append(some)
                    done, room = done + len(some), room - len(some)
                    if room == 0:
                        f.write(write_block(keys, np.concatenate(held), before, codes, lengths))
                        held, keys, room = [], [], BLOCK
                    if done == len(ids):
                        break
        if f is not None:
            if keys:
                f.write(write_block(keys, np.concatenate(held), before, codes, lengths))
            f.close()
            yield batch({"part": pa.array([part], pa.int32()), "file": pa.array([file]), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // FILE_IDS))
    order = F.col("doc_id").asc_nulls_first(), "part", "part_start"  # rows of one id, or of none, needn't meet in one task
    ordered = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = sorted(map_arrow(ordered, run, "part int, file string, n_docs long, n_ids long").collect())  # a row for each file
    out, start = [], 0
    for r in rows:
        out.append((*r, start))
        start += r.n_ids
    return spark.createDataFrame(out, "part int, file string, n_docs long, n_ids long, start long")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files of a manifest; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, inner = open_fs(file)
                with fs.open_input_stream(inner, compression=None) as f:
                    if f.read(8) != MAGIC:
                        raise ValueError(f"{file} is not a file of this format")
                    spec = json.loads(f.read(struct.unpack("<I", f.read(4))[0]))
                    lengths = np.frombuffer(zlib.decompress(base64.b64decode(spec["lengths"])), dtype=np.uint8)
                    yield from file_rows(f, Decoder(lengths, spec["max_bits"]), start)

    def file_rows(f, decoder: Decoder, start: int) -> Iterator[pa.RecordBatch]:
        doc, parts, open_doc = None, [], False
        while (block := read_block(f, decoder)) is not None:
            keys, counts, ids, before = block
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            done: list[tuple[int | None, np.ndarray]] = []
            for k, (key, piece) in enumerate(zip(keys, pieces, strict=True)):
                if k or not before:
                    if open_doc:
                        done.append((doc, np.concatenate(parts)))
                    doc, parts, open_doc = key, [], True
                parts.append(piece)
            if done:
                yield rows(done, start)
                start += sum(len(x) for _, x in done)
        if open_doc:
            yield rows([(doc, np.concatenate(parts))], start)

    def rows(done: list[tuple[int | None, np.ndarray]], start: int) -> pa.RecordBatch:
        n = np.array([len(x) for _, x in done], dtype=np.int64)
        return batch({"doc_id": pa.array([d for d, _ in done], pa.int64()), "start": pa.array(start + np.cumsum(n) - n), "n_tokens": pa.array(n), "ids": pa.array([x.astype("<u4").tobytes() for _, x in done], pa.binary())})

    files = manifest.select("file", "start")
    return map_arrow(files.repartition(max(1, files.count())), run, "doc_id long, start long, n_tokens long, ids binary")


def write_read(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 1) -> DataFrame:
    """Write to a new folder of the shared one and read back."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer_path, shared_dir(spark, "huffman"), end_id=end_id))
