"""Operator 3: byte-level BPE encoding and decoding from a table of ranks.

Each match of the split pattern is encoded by itself: a match that is a token is that token; else its bytes are merged, the
leftmost pair of least rank first. A segment tree over the byte positions stores, for each node, the leftmost position of the least
pair rank below it; a merge changes at most three leaves (the merged pair, its left neighbour, the removed position), and each change
goes up one path. Short matches are worked on many at a time: the trees are rows of one array and each step does one merge in each
row that still has one. Longer ones have a tree of their own. Ids of a chunk of text are kept in a bounded cache.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame

from quern.llm.common import batch, id_text, map_arrow, open_fs
from quern.llm.pairs import BytePairs, Memo
from quern.llm.tokens import groups, plain_chunks

#: A split pattern of public byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE_CHUNKS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    fs, inner = open_fs(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(inner) as f:
        data = f.read()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class TextEncoder:
    """Whole texts to little-endian unsigned 32-bit ids, by a pattern and ranks, with a cache of chunks.

    Chunks are cut only where no match of PATTERN can cross; with another pattern, texts are taken whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, cache_chunks: int = CACHE_CHUNKS):
        self.pairs, self.pattern = BytePairs.of_ranks(ranks), regex.compile(pattern)
        self.chunks: Callable[[str], list[str] | None] = plain_chunks if pattern == PATTERN else lambda text: None
        self.pieces = Memo(lambda new: self.pairs.encode([p.encode() for p in new]), cache_chunks)
        self.memo = Memo(self._pieces_of, cache_chunks)

    def _pieces_of(self, chunks: list[str]) -> list[bytes]:
        return self.pieces.join(list(map(self.pattern.findall, chunks)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """A few hundred texts at most in a call."""
        cut = list(map(self.chunks, texts))
        plain = iter(self.memo.join([c for c in cut if c is not None]))
        odd = iter(self._pieces_of([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(odd) if c is None else next(plain) for c in cut]


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    """One decoder for each Python worker and table; it needs no merges."""
    if path not in _decoders:
        _decoders[path] = Decoder(read_ranks(path))
    return _decoders[path]


_loaded: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str = PATTERN) -> TextEncoder:
    """One encoder for each Python worker, table and pattern."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TextEncoder(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks_path: str, *, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers; a null or empty text has none.

    A row for each row of docs, also for null or repeated ids; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(ranks_path, pattern)
        for b in batches:
            ids = [x for some in groups(b.column(1).to_pylist()) for x in enc.encode(some)]
            yield batch({"doc_id": b.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with the column `decoded` (binary), the bytes of its `ids`; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(ranks_path)
        for b in batches:
            got = [None if x is None else dec.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_arrow(encoded, run, f"{kinds}, decoded binary")
