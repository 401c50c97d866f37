"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on a bounded labelled sample, each path from a root becomes a conjunctive rule, an L1-penalised
logistic regression picks and weighs rules, and what is left is one Spark column expression, so scoring stays in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE

#: At most so many labelled documents are gathered to fit on; those with the smallest hash of their id.
SAMPLE = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all built-in expressions; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    words = F.array_remove(F.split(t, SPACE), "")
    n_words = F.size(words).cast("double")
    share = lambda pattern, of: F.regexp_count(t, F.lit(pattern)) / F.greatest(of, F.lit(1.0))
    return {
        "n_words": n_words,
        "chars_per_word": chars / F.greatest(n_words, F.lit(1.0)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1.0)),
        "symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))) / F.greatest(chars, F.lit(1.0)),
        "doubled_marks": share(r"[!?#*$%&]{2}", n_words),
        "capitals": share(r"[A-Z]", chars),
        "digits": share(r"[0-9]", chars),
        "stops": share(r"[.,;:!?](?=\s|$)", n_words),
        "lone_marks": share(r"(?<=\s)[|<>*/-](?=\s|$)", n_words),
        "stutters": share(r"(?<=^|\s)(\S{1,40})(?=\s\1(?:\s|$))", n_words),
        "lines": share(r"\n", n_words),
    }


FEATURES = ("n_words", "chars_per_word", "distinct_words", "symbols", "doubled_marks", "capitals", "digits", "stops", "lone_marks", "stutters", "lines")


@dataclass(frozen=True)
class Rule:
    """All of (feature, is it over the threshold, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[f] > t) == over for f, over, t in self.tests])

    def column(self, x: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, over, t in self.tests:
            out = out & ((x[f] > F.lit(t)) if over else (x[f] <= F.lit(t)))
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(next(iter(x.values()))), self.bias)
        for rule, w in self.weights:
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, x: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for rule, w in self.weights:
            z = z + F.when(rule.column(x), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, width: int) -> list[tuple[tuple[int, bool, float], ...]]:
    """The paths of one tree: at each node the best Gini split over random features at their quantiles."""
    paths: list[tuple[tuple[int, bool, float], ...]] = []

    def node(rows: np.ndarray, path: tuple[tuple[int, bool, float], ...]) -> None:
        if path:
            paths.append(path)
        own = y[rows]
        if len(path) == depth or len(rows) < 2 * least or own.min() == own.max():
            return
        best = (1e-9, -1, 0.0)
        p = own.mean()
        impurity = p * (1 - p)
        for f in rng.choice(x.shape[1], size=width, replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
                over = v > t
                n = int(over.sum())
                if n < least or len(v) - n < least:
                    continue
                a, b = own[over].mean(), own[~over].mean()
                gain = impurity - (n * a * (1 - a) + (len(v) - n) * b * (1 - b)) / len(v)
                if gain > best[0]:
                    best = (gain, int(f), float(t))
        _, f, t = best
        if f < 0:
            return
        over = x[rows, f] > t
        node(rows[over], (*path, (f, True, t)))
        node(rows[~over], (*path, (f, False, t)))

    node(np.arange(len(y)), ())
    return paths


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise mean log loss plus `penalty` times the sum of |weights|, by accelerated
    proximal gradient; the bias isn't penalised."""
    n, d = z.shape
    w, b = np.zeros(d), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, c, t = w.copy(), b, 1.0
    rng = np.random.default_rng(0)
    u = rng.normal(size=d + 1)
    for _ in range(30):  # the largest eigenvalue bounds the step
        p = z @ u[:-1] + u[-1]
        u = np.append(z.T @ p, p.sum()) / n
        u /= (size := np.linalg.norm(u)) or 1.0
    step = 4 / (1.1 * size + 1e-9)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        nw = v - step * (z.T @ error) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * error.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(x: dict[str, np.ndarray], y: np.ndarray, *, trees: int = 24, depth: int = 3, least: int = 12, penalty: float = 1e-3, seed: int = 11) -> Ensemble:
    """An ensemble for y in {0, 1}.  One class alone, or no rows, gives no rules and a constant score."""
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return Ensemble(math.log((mean + 1e-3) / (1 - mean + 1e-3)), ())
    names, rng = list(x), np.random.default_rng(seed)
    matrix = np.column_stack([x[f] for f in names])
    rules: dict[tuple[tuple[str, bool, float], ...], None] = {}
    for _ in range(trees):
        rows = rng.integers(0, len(y), size=min(len(y), 4000))
        for path in grow(matrix[rows], y[rows], rng, depth, least, max(3, len(names) // 2)):
            rules[tuple((names[f], over, t) for f, over, t in path)] = None
    candidates = [Rule(r) for r in rules]
    held = np.column_stack([r.holds(x) for r in candidates]).astype(np.float32)
    _, first = np.unique(held, axis=1, return_index=True)  # rules that hold on the same rows count once
    candidates, held = [candidates[i] for i in sorted(first)], held[:, sorted(first)].astype(np.float64)
    bias, w = lasso_logistic(held, y.astype(np.float64), penalty)
    return Ensemble(float(bias), tuple((r, float(v)) for r, v in zip(candidates, w, strict=True) if abs(v) > 1e-4))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and y of at most `sample` labelled documents for which `train` (over doc_id) holds: those whose
    ids have the smallest hashes.  An id that several rows share counts once, with its smallest label and text."""
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(train)
        .groupBy("doc_id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    )
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def train_ensemble(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ensemble:
    """Gathers the statistics (11 numbers a document) of the bounded sample and fits on the driver.  Needs both classes."""
    rows = labelled_sample(docs, labels, label_col, train, id_col=id_col, text_col=text_col, sample=sample)
    got = rows.select("doc_id", F.col("y"), *(c.alias(f) for f, c in statistics(F.col("text")).items())).toPandas().sort_values("doc_id")
    return fit({f: got[f].to_numpy(dtype=np.float64) for f in FEATURES}, got["y"].to_numpy(dtype=np.int64))


def with_score(df: DataFrame, model: Ensemble, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`df` and the model's score of each whole text (0 to 1; null counts as empty).  A column that already has the
    score's name is replaced.  Built-in expressions only: no shuffle, no Python."""
    packed = F.struct(*(c.alias(f) for f, c in statistics(F.col(f"`{text_col}`")).items()))
    # one array element holds the statistics, so that each is computed once and not once for each rule
    score = F.transform(F.array(packed), lambda s: model.column({f: s[f] for f in FEATURES}))[0]
    return df.withColumn(score_col, score)
