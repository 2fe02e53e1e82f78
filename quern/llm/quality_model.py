"""Operator 8: quality classifier: a factorisation machine.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise sum is computed in time linear in the features by
((sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2) / 2. Features: words hashed to DIM places with weights log(1 + count) at unit length, structure
statistics of the text, and metadata that the caller allows (hashed name=value pairs; none by default). It is fitted on the driver, in numpy, to a bounded
sample of labelled rows; scoring runs on the executors over all rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batch, cut, map_arrow, numbered, pick, place

DIM = 1 << 14
RANK = 8
SAMPLE_ROWS = 3000
SCORE_ENTRIES = 1 << 18  # features that are scored at once, or those of one text
STATS = ["one", "log_words", "mean_length", "symbols", "upper", "digits", "punctuation", "exclamation", "unique", "repeats", "line_length", "repeated_lines", "top_word", "sentence_ends"]


class _Places(dict):
    """Places of words; it is emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        place = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIM
        return place


_places = _Places()


def text_features(text: str, meta: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and weights of hashed words, and STATS, of a whole text."""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    counts = Counter(words)
    data = text.encode("utf-8", "surrogatepass")
    size = max(len(data), 1)
    marks = len(data) - len(data.translate(None, b"#*$%&|<>"))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    lines = [x for x in text.split("\n") if x.strip()]
    stats = np.array(
        [
            1.0, np.log1p(n) / 10, (sum(map(len, words)) / n if n else 0) / 10, min(1, marks / max(n, 1)), upper / size, digits / size,
            (data.count(b",") + data.count(b".") + data.count(b";") + data.count(b":")) / max(n, 1), min(1, data.count(b"!") / max(n, 1)), len(counts) / max(n, 1),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n, 1), min(1, chars / max(len(lines), 1) / 1000), 1 - len(set(lines)) / max(len(lines), 1),
            max(counts.values(), default=0) / max(n, 1), len(re.findall(r"[.!?](?:\s|$)", text)) / max(n, 1),
        ]
    )
    places = np.fromiter(map(_places.__getitem__, counts), dtype=np.int64, count=len(counts))
    weights = np.log1p(np.fromiter(counts.values(), dtype=float, count=len(counts)))
    if meta:
        places = np.append(places, [zlib.crc32(m.encode()) % DIM for m in meta])
        weights = np.append(weights, np.ones(len(meta)))
    at, inverse = np.unique(places, return_inverse=True)
    value = np.bincount(inverse, weights, len(at)) if len(at) else np.empty(0)
    norm = np.sqrt((value**2).sum())
    return at, value / norm if norm else value, stats


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray  # (DIM + len(STATS), rank)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of text_features of many texts, SCORE_ENTRIES features at once."""
        out, at = [np.empty(0)], 0
        ends = np.cumsum([len(a) + len(stats) for a, _, stats in rows])
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCORE_ENTRIES, "right")))
            out.append(self._scores(rows[at:to]))
            at = to
        return np.concatenate(out)

    def _scores(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        i = np.concatenate([x for at, _, stats in rows for x in (at, DIM + np.arange(len(stats)))])
        x = np.concatenate([v for _, value, stats in rows for v in (value, stats)])
        size = np.array([len(at) + len(stats) for at, _, stats in rows])
        first = np.cumsum(size) - size
        vx = self.v[i] * x[:, None]
        pairs = 0.5 * ((np.add.reduceat(vx, first) ** 2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), first))
        z = self.w0 + np.add.reduceat(self.w[i] * x, first) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, at: np.ndarray, value: np.ndarray, stats: np.ndarray) -> float:
        return float(self.scores([(at, value, stats)])[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, *, rank: int = RANK, epochs: int = 12, rate: float = 0.03, l2: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, classes weighted alike up to a factor, rows in an order fixed by the seed. No rows: score 1/2."""
    rng = np.random.default_rng(seed)
    size = DIM + len(STATS)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    if not len(labels):
        return m
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    positive = labels.mean()
    weight = np.where(labels == 1, 1.0, min(3.0, max(1.0, positive / max(1 - positive, 1e-9)))) if 0 < positive < 1 else np.ones(len(labels))
    tail = DIM + np.arange(len(STATS))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            at, value, stats = rows[k]
            i, x = np.concatenate([at, tail]), np.concatenate([value, stats])
            v = m.v[i]
            vx = v * x[:, None]
            s = vx.sum(axis=0)
            z = m.w0 + m.w[i] @ x + 0.5 * (s**2 - (vx**2).sum(axis=0)).sum()
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[k]) * weight[k]
            dw = d * x + l2 * m.w[i]
            dv = d * (x[:, None] * s - v * (x**2)[:, None]) + l2 * v
            g0 += d * d
            gw[i] += dw**2
            gv[i] += dv**2
            m.w0 -= rate * d / np.sqrt(g0)
            m.w[i] -= rate * dw / np.sqrt(gw[i])
            m.v[i] -= rate * dv / np.sqrt(gv[i])
    return m


def _flat(docs: DataFrame, id_col: str, text_col: str, meta: list[str]) -> DataFrame:
    cols = {f"m{i}": (c, "string") for i, c in enumerate(meta)}
    return pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"), **cols).withColumn("text", F.coalesce("text", F.lit("")))


def _meta(b: pa.RecordBatch, names: list[str], first: int) -> list[list[str]]:
    cols = [b.column(first + i).to_pylist() for i in range(len(names))]
    return [[f"{n}={c[r]}" for n, c in zip(names, cols, strict=True) if c[r] is not None] for r in range(b.num_rows)]


def train(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: list[str] | None = None, **options) -> Machine:
    """Fit to at most `rows` labelled documents, those of least id hash. Labels that are null, or neither 0 nor 1, are not used.

    A document with several labels counts once, with the least one; rows that repeat a doc_id count once, as the one of least hash. Only the
    features of the sample come to the driver, 6 bytes for each place of a text (DIM at most).
    """
    names = meta or []
    known = pick(labels, doc_id=("doc_id", "long"), label=(label_col, "int")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    joined = _flat(docs, id_col, text_col, names).join(F.broadcast(sample), "doc_id")
    parts = [c for c in joined.columns if c not in ("doc_id", "label")]
    joined = joined.groupBy("doc_id", "label").agg(F.min_by(F.struct(*parts), F.xxhash64(*parts)).alias("row")).select("doc_id", *[f"row.{c}" for c in parts], "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_features(t, m) for t, m in zip(b.column("text").to_pylist(), _meta(b, names, 2), strict=True)]
            yield batch({"doc_id": b.column("doc_id"), "label": b.column("label"), "places": pa.array([g[0].astype(np.int16 if DIM <= 1 << 15 else np.int32).tobytes() for g in got], pa.binary()), "weights": pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary()), "stats": pa.array([g[2].tobytes() for g in got], pa.binary())})

    got = map_arrow(joined, run, "doc_id long, label int, places binary, weights binary, stats binary").toArrow()
    order, width = np.argsort(got["doc_id"].to_numpy(), kind="stable"), np.int16 if DIM <= 1 << 15 else np.int32
    # Views of what has come, as small as it came: texts can be long.
    views = [tuple(np.frombuffer(x.as_buffer(), kind) for x, kind in zip(r, (width, np.float32, np.float64), strict=True)) for r in zip(got["places"], got["weights"], got["stats"], strict=True)]
    return fit([views[k] for k in order.tolist()], got["label"].to_numpy()[order].astype(float), **options)


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", meta: list[str] | None = None) -> DataFrame:
    """(doc_id, score) for each row, repeated ones too; null and empty texts score by their structure alone. An empty table gives an empty one."""
    shared, names = docs.sparkSession.sparkContext.broadcast(machine), meta or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = [text_features(t, x) for t, x in zip(b.column(1).to_pylist(), _meta(b, names, 2), strict=True)]
            yield batch({"doc_id": b.column(0), "score": pa.array(m.scores(rows), pa.float64())})

    return map_arrow(_flat(docs, id_col, text_col, names), run, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least threshold, with their columns, in one pass.

    A null text is scored as an empty one; equal texts share their fate; an empty table stays empty.
    """
    shared, spot = docs.sparkSession.sparkContext.broadcast(machine), place(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array(m.scores([text_features(t or "", []) for t in b.column(spot).to_pylist()]) >= threshold, pa.bool_()))

    kinds = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return map_arrow(numbered(docs), run, kinds).toDF(*docs.columns)
