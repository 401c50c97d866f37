"""Language-model scoring: a gated recurrent network over words, in numpy, with a class-factored softmax.

Corpus counts are exact and distributed.  Texts are dealt into chunks; a chunk's words are numbered once, and only its
distinct words are counted, joined with the corpus counts and sent back, so memory follows the chunk and not the corpus's
vocabulary.  The most frequent words have outputs of their own, in classes of equal size; every other word belongs to a
class by its shape, and within that class its probability is its share of the training counts.

Every training document is learned from: each chunk trains a replica by truncated backpropagation from common weights,
and replicas are averaged, weighted by their tokens.  Chunks follow from the rows alone, and so do the scores, however the
table is partitioned.  Scoring carries the state across windows to the end of each document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Tables, Words, blocks_for, give_back, slices

HEADS, CLASSES, SHAPES, HIDDEN = 1024, 32, 16, 16
EACH = HEADS // CLASSES
#: Bytes of text to a chunk, about; documents that a replica steps through side by side; steps between updates.
CHUNK, LANES, WINDOW = 32 << 20, 512, 16
ALPHA = 0.1
START = HEADS + SHAPES
END = b""  # the end mark; no word is empty
LN10 = math.log(10)


def shape_of(word: bytes) -> int:
    """The class of a word without an output of its own, by its last mark, length and letters."""
    last = word[-1:] in b".,;:!?" and word != b""
    plain = word.isascii()
    return last + 2 * (len(word) > 8) + 4 * (not plain) + 8 * (plain and not word.rstrip(b".,;:!?").isalpha())



# --- the network -------------------------------------------------------------------------------------------------


@dataclass
class Network:
    """inputs: a row of gate inputs (update, reset, candidate) for each symbol; the rest as named."""

    inputs: np.ndarray  # (START + 1, 3 H)
    recur: np.ndarray  # (H, 3 H)
    to_class: np.ndarray  # (H, CLASSES + SHAPES)
    class_bias: np.ndarray
    to_word: np.ndarray  # (CLASSES, H, EACH)
    word_bias: np.ndarray  # (CLASSES, EACH)

    @classmethod
    def start(cls, heads: np.ndarray, shapes: np.ndarray, seed: int = 3) -> Network:
        """Outputs begin at the shares of the given counts, so that an untrained network predicts by frequency."""
        rng, h = np.random.default_rng(seed), HIDDEN
        small = lambda *shape: rng.normal(scale=0.1, size=shape).astype(np.float32)
        by_class = heads.reshape(CLASSES, EACH) + 1e-3
        both = np.concatenate((by_class.sum(axis=1), shapes + 1e-3))
        inputs = small(START + 1, 3 * h)
        inputs[:, :h] += 1.0  # remember at first
        return cls(inputs, small(h, 3 * h), small(h, CLASSES + SHAPES), np.log(both / both.sum()).astype(np.float32), small(CLASSES, h, EACH), np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.recur, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def packed(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32).tobytes()

    def unpacked(self, data: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(data[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)


def run_window(net: Network, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """States after each step (the first is `h`), and what the steps need to go back: gates (update, reset), the recurrent
    input of the candidate and the candidate."""
    size = h.shape[1]
    states, gates = np.empty((len(x) + 1, *h.shape), dtype=np.float32), np.empty((*x.shape, 2 * size), dtype=np.float32)
    inner, candidates = np.empty((*x.shape, size), dtype=np.float32), np.empty((*x.shape, size), dtype=np.float32)
    states[0] = h
    puts = np.take(net.inputs, x, axis=0)
    for t in range(len(x)):
        put, own, gate, n = puts[t], states[t] @ net.recur, gates[t], candidates[t]
        np.add(own[:, : 2 * size], put[:, : 2 * size], out=gate)
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        inner[t] = own[:, 2 * size :]
        np.multiply(gate[:, size:], inner[t], out=n)
        n += put[:, 2 * size :]
        np.tanh(n, out=n)
        into = states[t + 1]
        np.subtract(states[t], n, out=into)
        into *= gate[:, :size]
        into += n
    return states, (gates, inner, candidates)


def output_loss(net: Network, h: np.ndarray, y: np.ndarray, grads: Network | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each target's class and, for words with an output, of the word in it; with `grads`
    also adds to their output parts and returns the derivative of the loss for h (of sums over targets)."""
    kind = np.where(y < HEADS, y // EACH, CLASSES + y - HEADS)
    at = np.arange(len(y))
    e = h @ net.to_class
    e += net.class_bias
    chosen = e[at, kind]
    # states lie within (-1, 1), so this bounds every logit
    safe = float((np.abs(net.to_class).sum(axis=0) + np.abs(net.class_bias)).max()) < TOP
    total = _exponentials(e, safe)
    out = (np.minimum(chosen, TOP) - np.log(total)).astype(np.float64)
    back = None
    if grads is not None:
        part = 1 / total  # left out of e, whose rows are long, and put to what meets it
        e[at, kind] -= total
        grads.to_class += _outer(h * part[:, None], e)
        grads.class_bias += part @ e
        back = e @ net.to_class.T
        back *= part[:, None]
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    order = order[: ends[CLASSES]]
    safe = float((np.abs(net.to_word).sum(axis=1) + np.abs(net.word_bias)).max()) < TOP
    own, words, chosen, totals = np.take(h, order, axis=0), y[order] % EACH, np.empty(len(order), dtype=np.float32), np.empty(len(order), dtype=np.float32)
    behind = np.empty_like(own) if grads is not None else None
    for c in range(CLASSES):
        rows = slice(ends[c], ends[c + 1])
        if rows.start == rows.stop:
            continue
        e = own[rows] @ net.to_word[c]
        e += net.word_bias[c]
        word, line = words[rows], at[: rows.stop - rows.start]
        chosen[rows] = e[line, word]
        totals[rows] = total = _exponentials(e, safe)
        if grads is not None:
            part = 1 / total
            e[line, word] -= total
            grads.to_word[c] += (own[rows] * part[:, None]).T @ e
            grads.word_bias[c] += part @ e
            np.matmul(e, net.to_word[c].T, out=behind[rows])
            behind[rows] *= part[:, None]
    out[order] += np.minimum(chosen, TOP) - np.log(totals)
    if grads is not None:
        back[order] += behind
    return out, back


#: Logits are held below this, so that exponentials stay finite without a pass for each row's largest.
TOP = np.float32(60)
ONES = np.ones(1 << 16, dtype=np.float32)


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for long a and b, in parts that stay in the processor's cache."""
    whole = len(a) // 512 * 512
    out = a[whole:].T @ b[whole:]
    if whole:
        out += np.matmul(a[:whole].reshape(-1, 512, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, 512, b.shape[1])).sum(axis=0)
    return out


def _exponentials(e: np.ndarray, safe: bool = False) -> np.ndarray:
    """Turns logits into their exponentials; the sum of each row.  `safe`: none is above TOP."""
    if not safe:
        np.minimum(e, TOP, out=e)
    np.exp(e, out=e)
    return e @ ONES[: e.shape[1]]


def lanes_of(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, longest first: (steps, lanes) of symbols, lengths, and the order taken."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((int(lengths.max(initial=0)), len(sequences)), dtype=np.uint16)
    for lane, i in enumerate(order):
        out[: lengths[i], lane] = sequences[i]
    return out, lengths[order], order


def log_probabilities(net: Network, sequences: list[np.ndarray]) -> np.ndarray:
    """Of each whole sequence, natural log; the state is carried across windows."""
    symbols, lengths, order = lanes_of(sequences)
    sums, h = np.zeros(len(sequences)), np.zeros((len(sequences), HIDDEN), dtype=np.float32)
    last = np.full(len(sequences), START, dtype=np.uint16)
    for begin in range(0, len(symbols), WINDOW):
        live = int(np.searchsorted(-lengths, -begin, side="left"))  # lanes with a symbol left
        y = symbols[begin : begin + WINDOW, :live]
        x = np.concatenate((last[None, :live], y[:-1]))
        states, _ = run_window(net, x, h[:live])
        inside = (begin + np.arange(len(y)))[:, None] < lengths[None, :live]
        lane = np.broadcast_to(np.arange(live), y.shape)[inside]
        found, _ = output_loss(net, states[1:][inside], y[inside].astype(np.int64), None)
        sums[:live] += np.bincount(lane, found, minlength=live)
        h, last = states[-1], y[-1]
    out = np.empty(len(sequences))
    out[order] = sums
    return out


class Trainer:
    """Truncated backpropagation with AdaGrad on one replica."""

    def __init__(self, net: Network, rate: float = 0.08) -> None:
        self.net, self.rate, self.tokens = net, rate, 0
        self.squares = [np.full_like(p, 1e-8) for p in net.parts()]

    def learn(self, sequences: list[np.ndarray]) -> None:
        symbols, lengths, _ = lanes_of(sequences)
        h, last = np.zeros((len(sequences), HIDDEN), dtype=np.float32), np.full(len(sequences), START, dtype=np.uint16)
        for begin in range(0, len(symbols), WINDOW):
            live = int(np.searchsorted(-lengths, -begin, side="left"))
            y = symbols[begin : begin + WINDOW, :live]
            x = np.concatenate((last[None, :live], y[:-1]))
            inside = (begin + np.arange(len(y)))[:, None] < lengths[None, :live]
            h = self._window(x, y, inside, h[:live])
            last = y[-1]
            self.tokens += int(inside.sum())

    def _window(self, x: np.ndarray, y: np.ndarray, inside: np.ndarray, h: np.ndarray) -> np.ndarray:
        net, size = self.net, HIDDEN
        states, caches = run_window(net, x, h)
        grads = Network(np.empty(0), np.empty(0), *(np.zeros_like(p) for p in net.parts()[2:]))
        if inside.all():
            _, back = output_loss(net, states[1:].reshape(-1, size), y.ravel().astype(np.int64), grads)
            from_out = back.reshape(states[1:].shape)
        else:
            _, back = output_loss(net, states[1:][inside], y[inside].astype(np.int64), grads)
            from_out = np.zeros(states[1:].shape, dtype=np.float32)
            from_out[inside] = back
        # what a state's derivative d is multiplied by is known before it: of the gates and the candidate, for the recurrent
        # weights (own) and, where it differs, for the inputs
        gates, inner, n = caches
        z, r = gates[:, :, :size], gates[:, :, size:]
        own = np.empty((*x.shape, 3, size), dtype=np.float32)
        for_candidate = (1 - z) * (1 - n * n)
        np.subtract(states[:-1], n, out=own[:, :, 0])
        own[:, :, 0] *= z * (1 - z)
        np.multiply(for_candidate, r, out=own[:, :, 2])
        np.multiply(own[:, :, 2], inner * (1 - r), out=own[:, :, 1])
        back_recur, all_d, d = np.ascontiguousarray(net.recur.T), from_out, np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            d += all_d[t]
            all_d[t] = d
            own[t] *= d[:, None, :]
            keep = d * z[t]
            d = own[t].reshape(len(d), 3 * size) @ back_recur
            d += keep
        into = own.copy()
        np.multiply(for_candidate, all_d, out=into[:, :, 2])
        scale = 1 / max(1, int(inside.sum()))
        grads.recur = _outer(states[:-1].reshape(-1, size), own.reshape(-1, 3 * size))
        for k, g in enumerate((grads.recur, grads.to_class, grads.class_bias, grads.to_word, grads.word_bias), 1):
            g = g * scale
            self.squares[k] += g * g
            net.parts()[k][...] -= self.rate * g / np.sqrt(self.squares[k])
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        named, first = np.unique(ids[order], return_index=True)
        g = np.add.reduceat(np.take(into.reshape(-1, 3 * size), order, axis=0), first, axis=0) * scale
        self.squares[0][named] += g * g
        net.inputs[named] -= self.rate * g / np.sqrt(self.squares[0][named])
        return states[-1]


# --- distributed steps -------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, held_out: Column, chunks: int) -> DataFrame:
    """Rows of two kinds, by chunk: a document (doc_id, key: a hash of its text, held, ids: its words numbered within the
    chunk) or a word of the chunk (token, local: its number, n: times in training documents)."""
    id_type = docs.schema["doc_id"].dataType
    key = F.xxhash64("doc_id", "text")
    dealt = docs.select("doc_id", "text", held_out.alias("held"), F.pmod(key, F.lit(chunks)).cast("int").alias("chunk"), key.alias("key")).repartitionById(chunks, "chunk")

    def run(batches):  # of one chunk
        words, seen, chunk, arrow_id = Words(), np.zeros(1024, dtype=np.int64), None, None
        names = ["chunk", "doc_id", "key", "held", "ids", "token", "local", "n"]
        for batch in slices(batches, "text"):
            arrow_id, chunk = batch.column(0).type, batch.column(3)[0].as_py()
            own = [np.array(words.of([*(text or b"").lower().split(), END]), dtype=np.int32) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            counted = [x for x, out in zip(own, batch.column(2).to_pylist(), strict=True) if not out]
            if len(words.ids) > len(seen):
                seen = np.concatenate((seen, np.zeros(max(len(seen), len(words.ids)), dtype=np.int64)))
            if counted:
                seen += np.bincount(np.concatenate(counted), minlength=len(seen))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(4), batch.column(2), pa.array([x.tobytes() for x in own], type=pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
        tokens = list(words.ids)
        for start in range(0, len(tokens), 50_000):
            part = tokens[start : start + 50_000]
            k = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, chunk, dtype=np.int32)), pa.nulls(k, arrow_id), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), pa.array(part, type=pa.binary()), pa.array(np.arange(start, start + k, dtype=np.int32)), pa.array(seen[start : start + k])],
                names=names,
            )
        words = tokens = None
        give_back()

    return dealt.mapInArrow(run, f"chunk int, doc_id {id_type.simpleString()}, key long, held boolean, ids binary, token binary, local int, n long")


def shaped(batches):
    for batch in batches:
        shapes = pa.array([shape_of(w) for w in batch.column(0).to_pylist()], type=pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), shapes, batch.column(1)], names=["token", "shape", "c"])


@dataclass
class Counts:
    """Of all training tokens: how many, how many distinct, each shape's (tokens, distinct) without head words, and the
    head words' counts."""

    tokens: int
    distinct: int
    shapes: np.ndarray
    heads: list[int]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ALPHA) / (self.tokens + ALPHA * (self.distinct + 1)))

    def in_shape(self, c: np.ndarray, shape: np.ndarray) -> np.ndarray:
        tokens, distinct = self.shapes[:, 0], self.shapes[:, 1]
        return np.log10((c + ALPHA) / (tokens + ALPHA * (distinct + 1))[shape])


def sequences_of(table: DataFrame, words: DataFrame, counts: Counts, id_type: str, chunks: int) -> DataFrame:
    """A row for each chunk: chunk, and for its documents lists of doc_id, held, n_tokens, n_known, base_score and
    tail_score (of words in their shapes), and symbols (of all, one after another).  The chunk's words, with their counts in
    the corpus, come first; then its documents stream past them.

    Documents of like length stand side by side, so that lanes go to waste little; groups of LANES are in no order."""
    own = table.where("ids is not null").select("chunk", "key", "doc_id", "held", "ids", *(F.lit(None).cast(t).alias(c) for c, t in (("local", "int"), ("shape", "int"), ("c", "long"), ("head", "int"))))
    first = words.select("chunk", *(F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("doc_id", id_type), ("held", "boolean"), ("ids", "binary"))), "local", "shape", "c", "head")
    lists = ("n_tokens", "n_known", "base_score", "tail_score")

    def run(batches):  # of one chunk
        parts: list[tuple[np.ndarray, ...]] = []
        base = tail = known = symbol = chunk = None
        ids_of, held, sequences, found = [], [], [], {k: [] for k in lists}
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column(0)[0].as_py()
            words_here = batch.slice(0, batch.column(1).null_count)
            docs = batch.slice(words_here.num_rows)
            if words_here.num_rows:
                parts.append(tuple(words_here.column(k).to_numpy(zero_copy_only=False) for k in (5, 6, 7, 8)))
            if not docs.num_rows:
                continue
            if base is None:
                local, shape, c, head = (np.concatenate(p) for p in zip(*parts, strict=True))
                local, shape, head = (v.astype(np.int64) for v in (local, shape, head))
                base, tail, known, symbol = np.zeros(len(local)), np.zeros(len(local)), np.zeros(len(local), dtype=bool), np.zeros(len(local), dtype=np.uint16)
                base[local] = counts.unigram(c)
                tail[local] = np.where(head >= 0, 0.0, counts.in_shape(c, shape))
                known[local] = c > 0
                symbol[local] = np.where(head >= 0, head, HEADS + shape)
            ids_of.append(docs.column(2))
            held += docs.column(3).to_pylist()
            for data in docs.column(4).to_pylist():
                ids = np.frombuffer(data, dtype=np.int32)
                found["n_tokens"].append(len(ids))
                found["n_known"].append(int(known[ids].sum()))
                found["base_score"].append(float(base[ids].sum()))
                found["tail_score"].append(float(tail[ids].sum()))
                sequences.append(symbol[ids])
        if not sequences:
            return
        order = np.argsort(np.array(found["n_tokens"]), kind="stable")
        groups = [order[i : i + LANES] for i in range(0, len(order), LANES)]
        order = np.concatenate([groups[i] for i in np.random.default_rng(len(order)).permutation(len(groups))])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(order)], type=pa.int32()), values.take(pa.array(order)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk], type=pa.int32()), one(pa.concat_arrays(ids_of)), one(pa.array(held, type=pa.bool_())), *(one(pa.array(found[k])) for k in lists), pa.array([np.concatenate([sequences[i] for i in order]).tobytes()], type=pa.binary())],
            names=["chunk", "doc_id", "held", *lists, "symbols"],
        )
        ids_of = held = sequences = found = parts = None
        give_back()

    dealt = own.unionByName(first).repartitionById(chunks, "chunk").sortWithinPartitions("key")  # words, which have none, come first
    return dealt.mapInArrow(run, f"chunk int, doc_id array<{id_type}>, held array<boolean>, n_tokens array<long>, n_known array<long>, base_score array<double>, tail_score array<double>, symbols binary")


def groups_of(lengths: np.ndarray, symbols: bytes) -> list[list[np.ndarray]]:
    """A chunk's sequences, LANES at a time."""
    ends = np.cumsum(lengths)
    flat = np.frombuffer(symbols, dtype=np.uint16)
    return [[flat[ends[i] - lengths[i] : ends[i]] for i in range(at, min(at + LANES, len(lengths)))] for at in range(0, len(lengths), LANES)]


def trained(chunks: DataFrame, net: Network, tables: Tables, part: int = 1) -> Network:
    """The average of replicas that start from `net` and learn from the training documents of a chunk, or from 1 in `part`
    of its groups.  Replicas are summed in groups of 64 until one row is left."""
    shared = chunks.sparkSession.sparkContext.broadcast(net)
    schema = "chunk int, weights binary, tokens double"

    def learn(batches):
        import copy

        for batch in batches:
            for row in range(batch.num_rows):
                trainer = Trainer(copy.deepcopy(shared.value))
                lengths, held = np.array(batch.column(1)[row].as_py()), np.array(batch.column(2)[row].as_py())
                for k, group in enumerate(groups_of(lengths, batch.column(3)[row].as_py())):
                    own = [x for x, out in zip(group, held[k * LANES :], strict=False) if not out]
                    if own and k % part == 0:
                        trainer.learn(own)
                if trainer.tokens:
                    weights = np.frombuffer(trainer.net.packed(), dtype=np.float32).astype(np.float64) * trainer.tokens
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([weights.tobytes()], type=pa.binary()), pa.array([float(trainer.tokens)])], names=["chunk", "weights", "tokens"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        total = np.zeros(0)
        for data in table.column("weights").to_pylist():
            own = np.frombuffer(data, dtype=np.float64)
            total = own.copy() if not len(total) else total + own
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py() // 64], type=pa.int32()), "weights": pa.array([total.tobytes()], type=pa.binary()), "tokens": [float(np.sum(table.column("tokens").to_numpy()))]})

    found = tables.save(chunks.select("chunk", "n_tokens", "held", "symbols").mapInArrow(learn, schema), "replicas")
    while (most := found.agg(F.max("chunk")).first()[0] or 0) > 0:
        summed = tables.save(found.groupBy(F.floor(F.col("chunk") / 64).alias("g")).applyInArrow(add, schema), "replicas")
        tables.drop(found)
        found = summed
        if most < 64:
            break
    row = found.first()
    return net if row is None else net.unpacked(np.frombuffer(row["weights"], dtype=np.float64) / row["tokens"])


@dataclass
class Prepared:
    """What comes before the network: rows of chunks (see sequences_of), not yet run, from two tables."""

    sequences: DataFrame
    sources: tuple[DataFrame, ...]
    counts: Counts
    chunks: int
    id_type: str


def prepared(df: DataFrame, held_out: Column, tables: Tables, id_col: str, text_col: str, chunk: int) -> Prepared:
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks = blocks_for(docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0, chunk)
    table = tables.save(encoded(docs, held_out, chunks), "encoded")
    every = table.where("token is not null").groupBy("token").agg(F.sum("n").alias("c"))
    counts_of = tables.save(every.mapInArrow(shaped, "token binary, shape int, c long"), "counts")
    counted = counts_of.where("c > 0")
    top = counted.orderBy(F.desc("c"), "token").limit(HEADS).collect()  # a fixed number of words
    totals = counted.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    shapes = np.zeros((SHAPES, 2))
    for r in totals:
        shapes[r["shape"]] = r["c"], r["v"]
    tokens, distinct = int(shapes[:, 0].sum()), int(shapes[:, 1].sum())
    for r in top:
        shapes[r["shape"]] -= r["c"], 1
    counts = Counts(tokens, distinct, shapes, [r["c"] for r in top])
    head = df.sparkSession.createDataFrame([(bytes(r["token"]), i) for i, r in enumerate(top)], "token binary, head int")
    known = counts_of.join(F.broadcast(head), "token", "left").select("token", "shape", "c", F.coalesce("head", F.lit(-1)).alias("head"))
    words = table.where("token is not null").select("chunk", "token", "local").join(known, "token").select("chunk", "local", "shape", "c", "head")
    return Prepared(sequences_of(table, words, counts, id_type, chunks), (table, counts_of), counts, chunks, id_type)


def base_scores(df: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The columns of score_documents that the network has no part in, by the same steps up to its training."""
    tables = Tables(df.sparkSession)
    ready = prepared(df, held_out, tables, id_col, text_col, chunk)
    found = tables.save(ready.sequences.drop("symbols", "tail_score"), "sequences")
    tables.drop(*ready.sources)
    rows = found.select(F.inline(F.arrays_zip("doc_id", "held", "n_tokens", "n_known", "base_score")))
    return rows.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(ready.counts.tokens).cast("long").alias("train_tokens"), "base_score")


def score_documents(df: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of each whole text).

    `held_out` is a condition over column doc_id; the other rows are learned from.  Tokens are words lower-cased over A-Z,
    and one end mark.  A null text counts as empty: its end mark alone.  Rows that repeat are counted and scored each by
    itself, also those with a null id.  Without training rows every count is 0 and the untrained network scores.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    spark, tables = df.sparkSession, Tables(df.sparkSession)
    ready = prepared(df, held_out, tables, id_col, text_col, chunk)
    counts, id_type, tokens = ready.counts, ready.id_type, ready.counts.tokens
    sequences = tables.save(ready.sequences, "sequences")
    tables.drop(*ready.sources)
    # a task for each chunk: files are packed into some few tasks more than there are cores, which then run twice as long
    sequences = sequences.repartitionById(ready.chunks, "chunk")
    net = Network.start(np.array(counts.heads + [0] * (HEADS - len(counts.heads)), dtype=np.float64), counts.shapes[:, 0])
    for part in (8, 1):  # a common start from an eighth, then all
        net = trained(sequences, net, tables, part)
    shared = spark.sparkContext.broadcast(net)

    def score(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                of = {c: batch.column(c)[row] for c in batch.schema.names}
                groups = groups_of(of["n_tokens"].values.to_numpy(), of["symbols"].as_py())
                found = np.concatenate([log_probabilities(shared.value, g) for g in groups]) / LN10 + of["tail_score"].values.to_numpy()
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [*(of[c].values for c in ("doc_id", "held", "n_tokens", "n_known")), pa.array(np.full(n, tokens, dtype=np.int64)), of["base_score"].values, pa.array(found)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return sequences.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
