"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, texts
from loomgraph.llm.rule_ensemble import labelled_sample

BITS = 18
#: At most so many labelled documents are gathered to fit on; those with the smallest hash of their id.
SAMPLE = 24_000
#: Marks around a word that don't tell one term from another.
EDGE = b"#*$%&|<>!?.,;:\"'()[]{}-_"


class Terms:
    """Hashed terms of a text: its distinct words, lower-cased over A-Z, without marks at their ends, and for the first
    bytes of words how many distinct words of the text share them (once, twice, up to `REPEATS` times), so that
    forms never seen in training still count by their stem."""

    #: The memory of words already hashed is emptied beyond this size.
    MOST = 1 << 18
    STEM, REPEATS = 6, 4

    def __init__(self, bits: int = BITS) -> None:
        self.mask, self.known = (1 << bits) - 1, {}

    def _hashed(self, word: bytes) -> tuple[int, int]:
        bare = word.strip(EDGE)
        stem = zlib.crc32(bare[: self.STEM], 1) if len(bare) > self.STEM else -1
        return (zlib.crc32(bare) & self.mask if bare else -1), stem

    def of(self, text: bytes) -> np.ndarray:
        words, known = set(text.lower().split()), self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.MOST:
            known.clear()
            new = list(words)
        for w in new:
            known[w] = self._hashed(w)
        if not words:
            return np.empty(0, dtype=np.int64)
        pairs = np.unique(np.array([known[w] for w in words], dtype=np.int64), axis=0)
        stems, counts = np.unique(pairs[pairs[:, 1] >= 0, 1], return_counts=True)
        out = [pairs[pairs[:, 0] >= 0, 0]]
        for k in range(1, self.REPEATS + 1):
            out.append((stems[counts >= k] * (2 * k + 1) + k) & self.mask)
        return np.unique(np.concatenate(out))


@dataclass
class Machine:
    """score = sigmoid(b + s * sum w_i + (sum_f (sum_i v_if)^2 - sum_i v_if^2) / 2) over the terms that the model knows."""

    bias: float
    index: np.ndarray  # of a hashed term: its row, or -1
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, terms: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(terms), self.bias)
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        if not sizes.sum():
            return out
        rows = self.index[np.concatenate(terms)]
        owner = np.repeat(np.arange(len(terms)), sizes)
        owner, rows = owner[rows >= 0], rows[rows >= 0]
        out += np.bincount(owner, self.linear[rows], minlength=len(terms))
        for f in range(self.factors.shape[1]):
            v = self.factors[rows, f]
            out += 0.5 * (np.bincount(owner, v, minlength=len(terms)) ** 2 - np.bincount(owner, v * v, minlength=len(terms)))
        return out

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(terms), -40, 40)))


def fit(terms: list[np.ndarray], y: np.ndarray, *, bits: int = BITS, rank: int = 6, epochs: int = 20, batch: int = 64, rate: float = 0.3, decay: float = 1e-5, least: int = 3, seed: int = 5) -> Machine:
    """Learns by AdaGrad on log loss.  Terms in fewer than `least` documents, and those whose share among toxic
    documents is near their share among the others, are left out.  One class alone gives a constant score."""
    index = np.full(1 << bits, -1, dtype=np.int64)
    rng = np.random.default_rng(seed)
    n = len(terms)
    if not n or y.min() == y.max():
        mean = float(y.mean()) if n else 0.0
        return Machine(float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), index, np.zeros(0), np.zeros((0, rank)))
    positive = np.concatenate([t for t, v in zip(terms, y, strict=True) if v] or [np.zeros(0, dtype=np.int64)])
    negative = np.concatenate([t for t, v in zip(terms, y, strict=True) if not v] or [np.zeros(0, dtype=np.int64)])
    a, b = np.bincount(positive, minlength=1 << bits), np.bincount(negative, minlength=1 << bits)
    p, q = (a + 0.5) / (y.sum() + 1), (b + 0.5) / (n - y.sum() + 1)
    spread = np.sqrt(p * (1 - p) / y.sum() + q * (1 - q) / (n - y.sum()))
    chosen = np.flatnonzero((a + b >= least) & (np.abs(p - q) > 3 * spread))
    index[chosen] = np.arange(len(chosen))
    linear, factors = np.zeros(len(chosen)), rng.normal(scale=0.01, size=(len(chosen), rank))
    gl, gf, bias, gb = np.full(len(chosen), 1e-6), np.full((len(chosen), rank), 1e-2), float(np.log(y.mean() / (1 - y.mean()))), 1e-6
    known = [index[t][index[t] >= 0] for t in terms]
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            part = order[at : at + batch]
            rows = np.concatenate([known[i] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(known[i]) for i in part])
            sums = np.zeros((len(part), rank))
            np.add.at(sums, owner, factors[rows])
            squares = np.bincount(owner, (factors[rows] ** 2).sum(axis=1), minlength=len(part)) if len(rows) else np.zeros(len(part))
            z = bias + np.bincount(owner, linear[rows], minlength=len(part)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)
            g = float(error.sum())
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if not len(rows):
                continue
            touched, where = np.unique(rows, return_inverse=True)
            d = np.bincount(where, error[owner], minlength=len(touched)) + decay * linear[touched]
            gl[touched] += d * d
            linear[touched] -= rate * d / np.sqrt(gl[touched])
            d = np.zeros((len(touched), rank))
            np.add.at(d, where, error[owner, None] * (sums[owner] - factors[rows]))
            d += decay * factors[touched]
            gf[touched] += d * d
            factors[touched] -= 0.2 * rate * d / np.sqrt(gf[touched])
    return Machine(bias, index, linear, factors)


def train_machine(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, sample: int = SAMPLE) -> Machine:
    """Gathers hashed terms of the bounded sample and fits on the driver."""

    def run(batches):
        hashed = Terms(bits)
        for batch in slices(batches, "text"):
            rows = [hashed.of(x or b"").astype("int32") for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], type=pa.binary())], names=["doc_id", "y", "terms"])

    rows = labelled_sample(docs, labels, label_col, train, id_col=id_col, text_col=text_col, sample=sample)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "y", "text").mapInArrow(run, f"doc_id {id_type}, y int, terms binary").toPandas().sort_values("doc_id")
    return fit([np.frombuffer(t, dtype=np.int32).astype(np.int64) for t in got["terms"]], got["y"].to_numpy(dtype=np.int64), bits=bits)


def score_documents(df: DataFrame, model: Machine, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1) of each whole text.  A null or empty text has no terms and gets the score of the bias.
    Rows are scored each by itself; an empty table gives an empty result.  The model (at most 2^bits rows of rank + 1
    numbers) travels as a broadcast variable."""
    id_type = df.select(f"`{id_col}`").schema[0].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hashed, machine = Terms(bits), shared.value
        for batch in slices(batches, "text"):
            terms = [hashed.of(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(terms), type=pa.float64())], names=["doc_id", "score"])

    return texts(df, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, score double")
