"""Operator 7: URL filter: explicit rules first, else gradient-boosted trees on lexical features.

The trees are of squared-gradient steps on the logistic loss, classes weighted alike, grown level by level on histograms of at most BINS
values a feature, in numpy on the driver, from a bounded sample of distinct labelled URLs (those of least hash). Shares of host suffixes
are counted over all URLs. Scoring runs on the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import batch, lower_ascii, map_arrow, pick

SAMPLE_ROWS = 20_000
LEAST_SHARE = 1e-5  # suffixes of a smaller share of all URLs count as share 0; so 100 000 are known at most
BINS = 32
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and a path prefix starting with "/"; block or allow."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def of(cls, text: str, verdict: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host.translate(_UPPER), slash + path, verdict)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; then up to "?", "#" or the end."""
    if url is None or (i := url.find("://")) < 0:
        return "", ""
    rest = url[i + 3 :]
    host = _HOST.match(rest).group()
    return host.translate(_UPPER), _PATH.match(rest, len(host)).group()


class Rules:
    """Lookup by host suffix: a URL costs its labels and the rules of those hosts, not all rules."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: (-len(r.path), r.path, r.verdict)):
            self.by_host.setdefault(r.host, []).append(r)

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule (host and path together) that fits; of equal ones the one with the longer host."""
        best, at = None, 0
        while at >= 0:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path):
                    if best is None or len(r.text) > len(best.text):
                        best = r
                    break
            at = host.find(".", at) + 1 or -1
        return best


FEATURES = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "fragment", "https", "suffix_length", "suffix_share", "extension", "longest_run", "upper_ratio"]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def features(urls: list[str | None], suffixes: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each URL; suffixes: the share of URLs with each last host label."""
    out = np.zeros((len(urls), len(FEATURES)))
    for i, url in enumerate(urls):
        u = url or ""
        host, path = split_url(u)
        query = u.partition("#")[0].partition("?")[2]
        suffix, n = host.rpartition(".")[2], max(len(u), 1)
        last = path.rpartition("/")[2]
        digits = sum(c.isdigit() for c in u)
        out[i] = (
            len(u), len(host), len(path), host.count(".") + 1 if host else 0, sum(1 for s in path.split("/") if s), digits / n, sum(c.isdigit() for c in host) / max(len(host), 1), u.count("-"), _entropy(u), _entropy(host),
            sum(1 for p in query.split("&") if p), len(query), "#" in u, u[:8].lower() == "https://", len(suffix), suffixes.get(suffix, 0.0), "." in last, max(map(len, re.findall(r"[A-Za-z]+", host)), default=0), sum(c.isupper() for c in u) / n,
        )
    return out


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # of the leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while len(self.feature) and (inner := node < len(self.feature)).any():
            f = self.feature[node[inner]]
            node[inner] = 2 * node[inner] + 1 + (x[rows[inner], f] > self.cut[node[inner]])
        return self.value[node - len(self.feature)]


@dataclass
class Boosted:
    """Trees of a fixed depth over features; score(): the probability of label 1 (block)."""

    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    rate: float = 0.15
    suffixes: dict[str, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t.predict(x)
        return 1 / (1 + np.exp(-z))


def train(urls: list[str | None], labels: list[int], suffixes: dict[str, float] | None = None, *, trees: int = 60, depth: int = 3, rate: float = 0.15, l2: float = 1.0, bins: int = BINS) -> Boosted:
    """Fit to labelled URLs (1: block). Without rows, or with one class only, the score is that class's smoothed share.

    suffixes: see suffix_shares; without them the shares among these URLs are taken. Each class has half the weight.
    """
    y = np.asarray(labels, dtype=float)
    if suffixes is None:
        suffixes = {k: v / len(urls) for k, v in Counter(split_url(u)[0].rpartition(".")[2] for u in urls).items()}
    model = Boosted(rate=rate, suffixes=suffixes)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return model
    model.base, weight = 0.0, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    x = features(urls, model.suffixes)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    z = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), dtype=np.int64)
        feat, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local, best, where = node - first, np.full(width, 1e-9), {}
            for f, c in enumerate(cuts):
                at = local * bins + binned[:, f]
                g = np.bincount(at, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(at, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                gain = g[:, :-1] ** 2 / (h[:, :-1] + l2) + (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                gain = gain[:, : len(c)]
                if not gain.size:
                    continue
                k = gain.argmax(axis=1)
                for n in range(width):
                    if gain[n, k[n]] > best[n]:
                        best[n], where[n] = gain[n, k[n]], (f, c[k[n]])
            for n, (f, c) in where.items():
                feat[first + n], cut[first + n] = f, c
            node = 2 * node + 1 + (x[np.arange(len(x)), feat[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + l2)
        model.trees.append(Tree(feat, cut, value))
        z += rate * value[leaf]
    return model


def judge(pages: DataFrame, rules: list[Rule], model: Boosted, *, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row: the longest fitting rule's verdict, else block at scores from threshold.

    rule: its text, else null. A null url, or one without "://", has an empty host and path, and is scored as an empty or pathless one.
    Repeated rows are judged each; an empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Rules(rules)
        for b in batches:
            urls = b.column(1).to_pylist()
            score = model.score(features(urls, model.suffixes))
            parts = [split_url(u) for u in urls]
            found = [table.find(h, p) for h, p in parts]
            yield batch(
                {
                    "page_id": b.column(0),
                    "host": pa.array([h for h, _ in parts], pa.string()),
                    "path": pa.array([p for _, p in parts], pa.string()),
                    "rule": pa.array([r and r.text for r in found], pa.string()),
                    "verdict": pa.array([r.verdict if r else "block" if s >= threshold else "allow" for r, s in zip(found, score, strict=True)]),
                    "score": pa.array(score),
                }
            )

    flat = pick(pages, page_id=(id_col, "long"), url=(url_col, "string"))
    return map_arrow(flat, run, "page_id long, host string, path string, rule string, verdict string, score double")


def suffix_shares(pages: DataFrame, *, url_col: str = "url") -> dict[str, float]:
    """The share of URLs (null: empty) with each last host label, over all rows; those under LEAST_SHARE are left out."""
    host = lower_ascii(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    counts = pick(pages, url=(url_col, "string")).groupBy(F.substring_index(host, ".", -1).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    return {r.suffix: r.n / total for r in counts.filter(F.col("n") >= LEAST_SHARE * total).collect()}


def labelled_by_rules(pages: DataFrame, rules: list[Rule], *, rows: int = SAMPLE_ROWS, url_col: str = "url") -> tuple[list[str], list[int]]:
    """At most `rows` distinct URLs that a rule decides, those of least hash, with that verdict (1: block): labels to train on.

    URLs are narrowed down by their hash where they are read, to about twice as many as wanted, so that tasks send few to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Rules(rules)
        for b in batches:
            found = [(u, r.verdict == "block") for u in b.column(0).to_pylist() if u is not None and (r := table.find(*split_url(u)))]
            yield batch({"url": pa.array([u for u, _ in found], pa.string()), "label": pa.array([int(v) for _, v in found], pa.int32())})

    def least(urls: DataFrame) -> list:
        return map_arrow(urls, run, "url string, label int").distinct().orderBy(F.xxhash64("url"), "url").limit(rows).collect()

    urls = pick(pages, url=(url_col, "string"))
    some = map_arrow(urls, run, "url string, label int").agg(F.approx_count_distinct("url").alias("n")).first().n
    if some <= 2 * rows:
        got = least(urls)
    else:
        upto = int(-(2**63) + 2**64 * (2 * rows / some))
        got = least(urls.filter(F.xxhash64("url") < F.lit(upto)))
        got = got if len(got) == rows else least(urls)  # the estimate was far off
    return [r.url for r in got], [r.label for r in got]
