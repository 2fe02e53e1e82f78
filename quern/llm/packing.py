"""Operator 1: concatenate and cut.

Every document's ids, each followed by an end id, are put end to end and cut into sequences of a fixed length. Two passes:
the first encodes each partition, numbers its tokens from 0 and writes the ids to the shared folder; a prefix sum over the
partitions' token totals (one number for each partition) gives each partition's place in the whole; the second adds that place
and cuts each document at multiples of the length, with flags where a window's edge falls inside a document. Nothing is sorted or
shuffled, and only the last sequence is short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batch, id_text, map_arrow, stored
from quern.llm.tokens import groups, tokenizer

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, continues_before boolean, continues_after boolean, ids binary"


def encode_partitions(df: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids): df is (doc_id, text); ids are integers of the tokenizer's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        end = b"" if end_id is None else np.asarray([end_id], dtype=tok.dtype).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = []
            for run in groups(b.column(1).to_pylist()):
                ids += [x + end for x in tok.encode(run)]
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // tok.dtype.itemsize
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield batch({"doc_id": b.column(0), "part": pa.array(np.full(len(ids), part, dtype=np.int32)), "part_start": pa.array(starts), "n_tokens": pa.array(n), "ids": pa.array(ids, pa.binary())})

    return map_arrow(df, run, "doc_id long, part int, part_start long, n_tokens long, ids binary")


def cut_pieces(encoded: DataFrame, bases: np.ndarray, length: int, width: int) -> DataFrame:
    """Pieces of encoded documents; bases: the tokens before each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, start, n = (b.column(i).to_numpy() for i in (1, 2, 3))
            begin = bases[part] + start
            first, last = begin // length, (begin + n - 1) // length
            pieces = np.where(n > 0, last - first + 1, 0)
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            lo = np.maximum(begin[row], seq * length)
            hi = np.minimum(begin[row] + n[row], (seq + 1) * length)
            ids, blobs = b.column(4), []
            held, at = np.empty(0), -1
            for r, x, y in zip(row.tolist(), (lo - begin[row]).tolist(), (hi - begin[row]).tolist(), strict=True):
                if r != at:
                    held, at = np.frombuffer(ids[r].as_buffer(), dtype=f"<u{width}"), r
                blobs.append(held[x:y].astype("<u4").tobytes())
            yield batch(
                {
                    "doc_id": b.column(0).take(pa.array(row)),
                    "start": pa.array(lo - begin[row]),
                    "length": pa.array(hi - lo),
                    "doc_tokens": pa.array(n[row]),
                    "sequence_id": pa.array(seq),
                    "offset": pa.array(lo - seq * length),
                    "continues_before": pa.array(lo > begin[row]),
                    "continues_after": pa.array(hi < begin[row] + n[row]),
                    "ids": pa.array(blobs, pa.binary()),
                }
            )

    return map_arrow(encoded, run, PIECE)


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = 1024, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences of `length` tokens: PIECE's columns; ids are little-endian unsigned 32-bit integers.

    A null or empty text is the end id alone (without an end id: no piece). A null id stays null; repeated rows are documents of
    their own; equal ids are not merged. An empty table gives no pieces. Other columns of docs are ignored. The order of documents
    is that of docs' partitions.
    """
    if length < 1:
        raise ValueError("length must be positive")
    encoded = stored(encode_partitions(id_text(docs, id_col, text_col), tokenizer_path, end_id), "packing")
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each partition
    sums = np.zeros(max((r.part for r in totals), default=0) + 1, dtype=np.int64)
    for r in totals:
        sums[r.part] = r.n
    return cut_pieces(encoded, np.cumsum(sums) - sums, length, tokenizer(tokenizer_path).dtype.itemsize)
