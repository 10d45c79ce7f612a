"""Quality score by a sparse rule ensemble.

Statistics of each text are Spark expressions. On a bounded labelled sample boosted trees of
small depth are grown; every path from a root becomes a rule, a conjunction of thresholds on
statistics. A logistic model with an L1 penalty on the rules' weights keeps few of them, and
these are compiled into one Column over the statistics.

Null texts count as empty (all statistics 0). Repeated rows get equal scores; null ids are
never learnt from. If the labels that may be learnt from hold fewer than two values, the score is
(ones + 1) / (labels + 2), 0.5 with no label. An empty table gives no rows. Other columns stay as
they are, but for one that has the name of the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import unused

#: Labelled rows that the rules are fitted on at most.
SAMPLE_ROWS = 6000


def statistics(t: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Named statistics of a text, given its non-empty words and lines."""
    n = F.greatest(F.length(t), F.lit(1))
    n_words = F.size(words)
    some = F.greatest(n_words, F.lit(1))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": F.length(t) / some,
        "distinct_words": F.size(F.array_distinct(words)) / some,
        "words_a_line": n_words / n_lines,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "upper": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "pipes": share(r"[|]"),
        "symbols": share(r"[#$%&*@^~<>={}\[\]\\_]"),
        "exclamations": share(r"!"),
        "stops": share(r"[.?]"),
        "repeats": F.regexp_count(t, F.lit(r"\b(\w+) \1\b")) / some,
    }


NAMES = ("log_words", "word_length", "distinct_words", "words_a_line", "distinct_lines", "upper", "digits", "pipes", "symbols", "exclamations", "stops", "repeats")


def with_statistics(docs: DataFrame, text_column: str = "text", name: str = "stats") -> DataFrame:
    """Adds a struct of the text's statistics; words and lines are split once, in a projection of their own."""
    t = F.coalesce(F.col(text_column), F.lit(""))
    words, lines = unused(docs, "words"), unused(docs, "lines")
    split = docs.withColumns(
        {words: F.filter(F.split(t, r"\s+", -1), lambda w: w != ""), lines: F.filter(F.split(t, "\n", -1), lambda x: x != "")}
    )
    made = statistics(t, F.col(words), F.col(lines))
    return split.withColumn(name, F.struct(*(c.cast("double").alias(k) for k, c in made.items()))).drop(words, lines)


@dataclass(frozen=True)
class Rule:
    """A conjunction: for (statistic, above, threshold), the value is above it, or at most it."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, j] > t) == above for j, above, t in self.terms])

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, ((stats[NAMES[j]] > t) if above else (stats[NAMES[j]] <= t) for j, above, t in self.terms))


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, path: tuple, cuts: list[np.ndarray], out: list[Rule], step: np.ndarray) -> None:
    """A boosted tree below one node; fills step with the leaves' values and out with all paths."""
    if path:
        out.append(Rule(path))
    best = (1e-3, -1, 0.0)
    if depth and len(rows) >= 40:
        g, h = slope[rows].sum(), curve[rows].sum()
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            where = np.searchsorted(at, x[rows, j], "left")
            gl = np.cumsum(np.bincount(where, slope[rows], len(at) + 1))[:-1]
            hl = np.cumsum(np.bincount(where, curve[rows], len(at) + 1))[:-1]
            nl = np.cumsum(np.bincount(where, minlength=len(at) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 10) | (len(rows) - nl < 10)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(at[k]))
    if best[1] < 0:
        step[rows] = -slope[rows].sum() / (curve[rows].sum() + 1)
        return
    _, j, t = best
    above = x[rows, j] > t
    for side, part in ((False, rows[~above]), (True, rows[above])):
        _grow(x, slope, curve, part, depth - 1, (*path, (j, side, t)), cuts, out, step)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps; the bias is free."""
    n, m = r.shape
    full = np.hstack([np.ones((n, 1)), r])
    v = np.ones(m + 1)
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(np.linalg.norm(full @ v) ** 2 * 1.05)
    w, ahead, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ ahead, -30, 30)))
        new = ahead - rate * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(0, abs(new[1:]) - rate * penalty)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3) -> RuleModel:
    """Trees, their paths as rules, and the sparse weights, from rows of statistics and 0/1 labels."""
    if len(y) == 0:
        return RuleModel(0.0)
    if y.min() == y.max():
        return RuleModel(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
    margin, found = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(x, p - y, p * (1 - p), np.arange(len(y)), depth, (), cuts, found, step)
        margin = margin + rate * step
    rules, columns, seen = [], [], set()
    for rule in dict.fromkeys(found):
        held = rule.holds(x)
        key = held.tobytes()
        if held.any() and not held.all() and key not in seen:
            seen.add(key)
            rules.append(rule)
            columns.append(held)
    if not rules:
        return RuleModel(float(margin[0]))
    bias, weights = _lasso(np.array(columns, float).T, y.astype(float), penalty)
    return RuleModel(bias, [(r, w) for r, w in zip(rules, weights.tolist(), strict=True) if abs(w) > 1e-4])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Rules from the sample_rows labelled ids that hash lowest, among those where may_learn holds.

    The sample is small enough to broadcast whatever the input; only its texts get statistics here.
    Of an id's several texts the one with the least statistics counts, so that sample_rows rows
    come to the driver at most, however often ids repeat.
    """
    some = (
        labels.where(may_learn & F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"))
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(sample_rows)
    )
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(some), "id")
    one = with_statistics(rows).groupBy("id", "y").agg(F.min("stats").alias("stats"))
    got = one.select("id", "y", *(F.col(f"stats.{n}").alias(n) for n in NAMES)).orderBy("id", "y").toArrow()
    x = np.array([got.column(n).to_numpy() for n in NAMES], float).T.reshape(-1, len(NAMES))
    return fit_rules(x, got.column("y").to_numpy().astype(int))


def scored(docs: DataFrame, model: RuleModel, text_column: str = "text", name: str = "score") -> DataFrame:
    """The rows with their score added (or put in place of a column of that name)."""
    stats = unused(docs, "stats")
    return with_statistics(docs, text_column, stats).withColumn(name, model.score(F.col(stats))).drop(stats)
