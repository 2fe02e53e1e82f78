"""Operator 9 [native]: quality rules as weak supervision. DataFrame functions only.

Each rule looks at measures of a text and votes +1 (good), -1 (bad) or 0 (abstains). The model is a mixture of two classes in which
votes are independent given the class; expectation-maximisation over the counts of vote patterns (at most 3 to the number of rules)
estimates the classes' shares and each rule's rates of votes in each class, its accuracies. A document is kept if the posterior
probability of good is at least a threshold, so that one vote of a rule that is often wrong need not reject it.

All measures are of one row: repeats of word windows are found by sorting the row's own window hashes, not by exploding words.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, numbered, place, stored

GAP = r"[\x20\x09-\x0D]+"
MARKS = r"[#*$%&|<>]"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

Vote = Column


def _vote(bad: Column, good: Column) -> Vote:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def measured(docs: DataFrame, text: str) -> DataFrame:
    """docs (flat names) with the measures and votes of column `text` (null: no words) added, all names starting with "q_"."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    some = docs.withColumn("q_words", F.filter(F.split(t, GAP), lambda w: w != ""))
    some = some.withColumns(
        {
            "q_n_words": F.size("q_words").cast("long"),
            "q_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "q_hashes": F.transform("q_words", lambda w: F.xxhash64(w)),
        }
    )
    at = F.sequence(F.lit(0), F.col("q_n_words").cast("int") - WINDOW)
    windows = F.transform(at, lambda i: F.xxhash64(*[F.get("q_hashes", i + k) for k in range(WINDOW)]))
    some = some.withColumn("q_windows", F.when(F.col("q_n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a window twice are sorted: (hash, place), then places whose neighbour in that order has the same hash.
    twice = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    pairs = F.sort_array(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = some.withColumn("q_pairs", F.when(twice, pairs))
    same = lambda x, k: F.coalesce(F.get("q_pairs", k)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("q_pairs", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    some = some.withColumns(
        {
            "q_word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "q_n_symbols": F.regexp_count(t, F.lit(MARKS)).cast("long"),
            "q_n_lines": F.size("q_lines").cast("long"),
            "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "q_n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "q_n_unique": F.size(F.array_distinct("q_hashes")).cast("long"),
            "q_n_upper": (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).cast("long"),
            "q_n_marked": F.size(F.filter("q_words", lambda w: w.rlike(MARKS))).cast("long"),
            "q_n_plain": F.size(F.filter("q_words", lambda w: w.rlike(r"^[\p{L}'’-]+[.,;:!?]?$"))).cast("long"),
            "q_n_ends": F.regexp_count(t, F.lit(r"[.!?](?:[\x20\x09-\x0D]|$)")).cast("long"),
        }
    ).drop("q_words", "q_lines", "q_hashes", "q_windows", "q_pairs")
    n, words = F.col("q_n_words"), F.greatest(F.col("q_n_words"), F.lit(1)).cast("double")
    c = F.col
    length, upper, unique, ends = c("q_word_chars") / words, c("q_n_upper") / F.greatest(c("q_word_chars"), F.lit(1)), c("q_n_unique") / words, c("q_n_ends") / words
    votes = {
        "q_v_size": _vote(n < 20, n >= 40),
        "q_v_length": _vote((length < 3.2) | (length > 7.0), (length >= 4.2) & (length <= 6.2)),
        "q_v_symbols": _vote(c("q_n_symbols") > 0.1 * words, c("q_n_symbols") == 0),
        "q_v_marked": _vote(c("q_n_marked") > 0.1 * words, c("q_n_marked") == 0),
        "q_v_plain": _vote(c("q_n_plain") < 0.6 * words, c("q_n_plain") >= 0.85 * words),
        "q_v_lines": _vote(c("q_n_dup_lines") > 0.3 * F.greatest(c("q_n_lines"), F.lit(1)), c("q_n_dup_lines") == 0),
        "q_v_repeats": _vote(c("q_n_repeat_words") > 0.3 * words, c("q_n_repeat_words") <= 0.05 * words),
        "q_v_upper": _vote(upper > 0.3, upper < 0.12),
        # New words get fewer as a text goes on, so the bound falls with its length.
        "q_v_unique": _vote(c("q_n_unique") < F.least(0.25 * words, 8 * F.sqrt(words)), unique > 0.45),
        "q_v_ends": _vote((ends > 0.6) | (n >= 60) & (ends < 0.01), (ends >= 0.02) & (ends <= 0.3)),
    }
    failed = (n < 20) | (100 * c("q_n_repeat_words") > 30 * n)
    # A column that is not deterministic keeps filters above from being pushed down, which would put whole measures into conditions.
    return some.withColumns(votes | {"q_base_failed": failed, "q_row": F.monotonically_increasing_id()})


RULES = ["size", "length", "symbols", "marked", "plain", "lines", "repeats", "upper", "unique", "ends"]
VOTES = (-1, 0, 1)


def _indicators() -> Column:
    """1.0 or 0.0 for each rule and vote, and a last 1.0."""
    return F.array(*[F.when(F.col(f"q_v_{r}") == v, 1.0).otherwise(0.0) for r in RULES for v in VOTES], F.lit(1.0))


def _posterior(indicators: Column, weights: list[float]) -> Column:
    # The weights are one literal, so that a new round finds its compiled code again.
    parts = F.zip_with(indicators, F.lit(weights), lambda x, w: x * w)
    return 1 / (1 + F.exp(-F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


@dataclass
class Model:
    """share: of good; rates[rule][class][vote]: how often a rule gives that vote in a class (1: good, 0: bad)."""

    share: float
    rates: dict[str, dict[int, dict[int, float]]]

    def weights(self) -> list[float]:
        """Log-odds of good: of each rule's votes -1, 0, 1 in turn, then of the share."""
        return [log(by[1][v] / by[0][v]) for by in self.rates.values() for v in VOTES] + [log(self.share / (1 - self.share))]

    def posterior(self) -> Column:
        """The probability of good, of a row with columns q_v_*."""
        return _posterior(_indicators(), self.weights())

    def accuracy(self, rule: str) -> float:
        """The share of right votes among those that aren't abstentions."""
        by, p = self.rates[rule], self.share
        right, wrong = p * by[1][1] + (1 - p) * by[0][-1], p * by[1][-1] + (1 - p) * by[0][1]
        return right / max(right + wrong, 1e-12)


def fit(rows: DataFrame, *, rounds: int = 30, settle: float = 1e-5) -> Model:
    """EM on all rows of measured(). To the driver: a row for each rule and vote in a round. No rows: nothing is rejected by votes."""
    names = [f"q_v_{r}" for r in RULES]
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n"))
    bad = F.lit(False)
    for v in names:
        bad = bad | (F.col(v) == -1)
    patterns = cut(counts.select(*names, "n", _indicators().alias("x"), F.when(bad, 0.1).otherwise(0.98).alias("first")).coalesce(1).sortWithinPartitions(*names))
    good, model = F.col("first"), None
    for _ in range(rounds):
        each = patterns.select(F.posexplode("x").alias("i", "x"), "n", (F.col("n") * good).alias("g"))
        got = each.groupBy("i").agg(F.sum(F.col("n") * F.col("x")).alias("n"), F.sum(F.col("g") * F.col("x")).alias("g")).collect()
        if not got:
            return Model(0.99, {r: {c: dict.fromkeys(VOTES, 1 / 3) for c in (0, 1)} for r in RULES})
        sums = {r.i: (r.n, r.g) for r in got}
        n, g = sums[len(RULES) * len(VOTES)]
        rates: dict[str, dict[int, dict[int, float]]] = {}
        for k, rule in enumerate(RULES):
            cell = [sums[k * len(VOTES) + j] for j in range(len(VOTES))]
            rates[rule] = {1: {v: (c[1] + 0.5) / (g + 1.5) for v, c in zip(VOTES, cell, strict=True)}, 0: {v: (c[0] - c[1] + 0.5) / (n - g + 1.5) for v, c in zip(VOTES, cell, strict=True)}}
        new = Model(min(max((g + 1) / (n + 2), 1e-6), 1 - 1e-6), rates)
        done = model is not None and max(abs(x - y) for x, y in zip(new.weights(), model.weights(), strict=True)) < settle * 100
        model, good = new, _posterior(F.col("x"), new.weights())
        if done:
            break
    return model


def judge(docs: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(doc_id, MEASURES, votes q_v_*, posterior, kept) for each row of docs, and the model fitted to all of them.

    A null or empty text has no words and fails the base rules. An empty table gives an empty one; repeated rows are judged each;
    other columns are ignored. The measures are written to the shared folder once, then read for fitting and judging.
    """
    flat = numbered(docs)
    rows = measured(flat.select(F.col(f"_c{place(docs, id_col)}").cast("long").alias("doc_id"), F.col(f"_c{place(docs, text_col)}").alias("text")), "text")
    rows = stored(rows.drop("text", "q_row"), "rules")
    model = fit(rows)
    kept = ~F.col("q_base_failed") & (F.col("posterior") >= threshold)
    out = rows.withColumn("posterior", model.posterior()).withColumn("kept", kept)
    return out.select("doc_id", *[F.col(f"q_{m}").alias(m) for m in MEASURES], *[f"q_v_{r}" for r in RULES], "posterior", "kept"), model


def keep(docs: DataFrame, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns.

    A null or empty text has no words and is rejected; equal texts share their fate; an empty table stays empty. Rows are written to the
    shared folder with their votes, so that texts are measured once; of those that the base rules reject only the votes, for the fit.
    """
    flat = numbered(docs)
    rows, failed = measured(flat, f"_c{place(docs, text_col)}"), F.col("q_base_failed")
    votes = [f"q_v_{r}" for r in RULES]
    rows = stored(rows.select(*[F.when(~failed, F.col(c)).alias(c) for c in flat.columns], *votes, "q_base_failed"), "rules")
    model = fit(rows)
    return rows.filter(~failed & (model.posterior() >= threshold)).select(*flat.columns).toDF(*docs.columns)
