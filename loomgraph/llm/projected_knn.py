"""Approximate nearest neighbours by a few stable random projections and a kd-tree.

Vectors are scaled to length 1, so the nearest by angle are the nearest by Euclid.  A Gaussian projection to m dimensions
turns a squared distance d2 into d2 times a chi-square variable of m degrees.  A kd-tree over projections gives leaves in
the order of their least projected distance; vectors of a leaf are verified in all dimensions, and the search stops once
a neighbour nearer than the k-th found would, by the chi-square test, already have come up with probability `sure`.

Rows are dealt by the cells of a kd-tree over a bounded sample's projections; a cell with many rows, such as one that a
vector of many copies fills, is cut into parts by a hash.  A query first searches a part of its own cell, and with what it
found there the same test tells which other cells stay open to it, so that rows far from it are never met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Tables, blocks_for

DIMENSIONS, LEAF, SURE = 8, 64, 0.98
#: Rows to a part and queries to a meeting, about; rows of which the cells' tree is made, and the fewest of them to a cell.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 4_096
SAMPLE, CELL_SAMPLE = 16_384, 16


def chi_square_cdf(x: np.ndarray, m: int = DIMENSIONS) -> np.ndarray:
    """P(chi-square with an even number m of degrees <= x)."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-np.minimum(half, 700)) * total


def projection(d: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(d, DIMENSIONS))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


class Cells:
    """A kd-tree's cells: each point belongs to one, whether it was there when the tree was made or not."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.axis, self.at, self.next, low, high = [], [], [], [], []
        todo = [(np.arange(len(points)), cells, np.full(DIMENSIONS, -np.inf), np.full(DIMENSIONS, np.inf), None)]
        while todo:
            rows, wanted, a, b, parent = todo.pop()
            own = points[rows]
            spread = own.max(axis=0) - own.min(axis=0) if len(rows) else np.zeros(DIMENSIONS)
            axis = int(np.argmax(spread))
            number = len(self.axis) if wanted > 1 and len(rows) >= 2 * CELL_SAMPLE and spread[axis] > 0 else -1 - len(low)
            if parent is not None:
                self.next[parent[0]][parent[1]] = number
            if number < 0:
                low.append(a)
                high.append(b)
                continue
            cut = float(np.median(own[:, axis]))
            left = own[:, axis] < cut
            if not left.any():  # more than half share the least value
                cut = float(own[own[:, axis] > own[:, axis].min(), axis].min())
                left = own[:, axis] < cut
            self.axis.append(axis)
            self.at.append(cut)
            self.next.append([0, 0])
            below, above = b.copy(), a.copy()
            below[axis] = above[axis] = cut
            todo += [(rows[left], wanted - wanted // 2, a, below, (number, 0)), (rows[~left], wanted // 2, above, b, (number, 1))]
        self.low, self.high = np.array(low), np.array(high)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64) if self.axis else np.full(len(points), -1)
        axis, at, after = np.array(self.axis, dtype=np.int64), np.array(self.at), np.array(self.next, dtype=np.int64).reshape(-1, 2)
        while (inner := np.flatnonzero(node >= 0)).size:
            own = node[inner]
            node[inner] = after[own, (points[inner, axis[own]] >= at[own]).astype(np.int64)]
        return -1 - node

    def distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


def open_cells(cells: Cells, q: np.ndarray, far: float | None, sure: float = SURE) -> np.ndarray:
    """The cells that may hold a vector nearer than `far` (a squared distance; None: any) to the projected query."""
    low = cells.distances(q)
    if far is None:
        return np.arange(len(low))
    return np.flatnonzero((low <= 0) | (chi_square_cdf(low / far) < sure)) if far > 0 else np.flatnonzero(low <= 0)


class Tree:
    """Leaves of a kd-tree: rows in leaf order, and each leaf's box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        done, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                done.append(rows)
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order = np.argpartition(own[:, axis], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.rows = np.concatenate(done)
        self.ends = np.cumsum([len(r) for r in done])
        self.starts = self.ends - [len(r) for r in done]
        self.low = np.array([points[r].min(axis=0) for r in done])
        self.high = np.array([points[r].max(axis=0) for r in done])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Of a projected query: the least squared projected distance to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision on the original vectors; equal rows give equal results."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


class Block:
    """A searchable block of vectors.  Equal vectors are searched once and stand for all their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)
        _, first, which = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(which, kind="stable")
        self.ids, self.ends = ids[by], np.cumsum(np.bincount(which))
        self.starts = np.concatenate(([0], self.ends[:-1]))
        distinct = vectors[first]
        unit = units(distinct)
        self.projection = projection(vectors.shape[1], seed)
        self.tree = Tree(unit @ self.projection)
        rows = self.tree.rows  # leaf order, so that a leaf's vectors are neighbours in memory
        self.vectors, self.unit = distinct[rows], unit[rows]
        self.starts, self.ends = self.starts[rows], self.ends[rows]

    def nearest(self, own: int, q: np.ndarray, k: int, sure: float = SURE, bound: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found, without the query's own id.  `bound` is a squared distance that k others
        are known not to pass."""
        unit = q / np.sqrt((q * q).sum())
        tree, want = self.tree, k + 4
        low = tree.distances(unit @ self.projection)
        order = np.argsort(low, kind="stable")
        best, rows, at, step = np.empty(0), np.empty(0, dtype=np.int64), 0, 4
        while at < len(order):
            far = 2 - 2 * np.partition(best, len(best) - k - 1)[len(best) - k - 1] if len(best) > k else None
            if bound is not None:
                far = bound if far is None else min(far, bound)
            if far is not None:
                rest = low[order[at]]
                if rest > 0 and (far <= 0 or chi_square_cdf(np.array(rest / far)) >= sure):
                    break
            take = order[at : at + step]
            at, step = at + step, min(64, step * 2)
            new = np.concatenate([np.arange(tree.starts[i], tree.ends[i]) for i in take])
            best, rows = np.concatenate((best, self.unit[new] @ unit)), np.concatenate((rows, new))
            if len(best) > want:
                top = np.argpartition(best, len(best) - want)[len(best) - want :]
                best, rows = best[top], rows[top]
        found, scores = [], []
        for row, score in zip(rows, cosines(self.vectors[rows], q), strict=True):
            ids = self.ids[self.starts[row] : self.ends[row]]  # in ascending order
            ids = ids[ids != own][:k] if ids[0] <= own <= ids[-1] else ids[:k]
            found.append(ids)
            scores.append(np.full(len(ids), score))
        ids, scores = np.concatenate(found or [np.empty(0, dtype=np.int64)]), np.concatenate(scores or [np.empty(0)])
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = SURE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k nearest by cosine among the rows with another id,
    ties to the smaller id; all of them if there are fewer.

    `is_query` is a condition over columns `vec_id` and `embedding`.  Rows with a null id or a vector that is not usable
    take no part.  Vectors of another length than the query's aren't its candidates.  A query id that several rows
    share counts once, with its smallest vector; candidates that repeat an id are rows of their own.  Empty tables and
    tables without a query give an empty result.  Other columns are ignored.

    No task holds more than one part of the rows and one block of queries; what moves are the rows, twice, and for each
    query the parts of the cells that are open to it.  Cells are made for lengths of vectors that the sample holds; vectors
    of other lengths are one cell.
    """
    tables = Tables(df.sparkSession)
    fields = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    rows = fields.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    n = rows.count()
    cells = {}
    if n > INDEX_BLOCK:
        wide = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).mapInArrow(_projected, "d int, point array<double>").collect()
        for d in {r["d"] for r in wide}:
            points = np.array([r["point"] for r in wide if r["d"] == d])
            cells[d] = Cells(points, blocks_for(n * len(points) // len(wide), INDEX_BLOCK))

    def placed(batches):
        for batch in batches:
            where = np.zeros(batch.num_rows, dtype=np.int32)
            for d, at, vectors in _by_length(batch.column(1)):
                if d in cells:
                    where[at] = cells[d].of(units(vectors) @ projection(d))
            sizes = pa.compute.list_value_length(batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, pa.array(where)], names=[*batch.schema.names, "d", "cell"])

    schema = "vec_id long, embedding array<double>, asks boolean, d int, cell int"
    known = tables.save(rows.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).mapInArrow(placed, schema), "vectors")
    parts = known.groupBy("d", "cell").agg(F.ceil(F.count("*") / INDEX_BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), "parts").cast("int")
    index = known.join(parts, ["d", "cell"]).select("vec_id", "embedding", "d", "cell", part.alias("part"))
    asked = known.where("asks").groupBy("vec_id").agg(F.min(F.struct("embedding", "d", "cell")).alias("q")).select("vec_id", "q.*").join(parts, ["d", "cell"])
    first = asked.select("vec_id", "embedding", "d", "cell", part.alias("part"), F.lit(None).cast("double").alias("far"))

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if own.num_rows and asked.num_rows:
            matrix = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            block = Block(own.column("vec_id").to_numpy(), matrix(own))
            for query, vector, far in zip(asked.column("vec_id").to_pylist(), matrix(asked), asked.column("far").to_pylist(), strict=True):
                ids, scores = block.nearest(query, vector, k, sure, far)
                out["query_id"].append(np.full(len(ids), query, dtype=np.int64))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate([np.empty(0, dtype=kinds[c]), *out[c]]) for c in out})

    def searched(queries: DataFrame, name: str) -> DataFrame:
        """Each query in its (d, cell, part); where many queries meet, they come in blocks."""
        queries = tables.save(queries, f"{name}-queries")
        key = ["d", "cell", "part"]
        blocks = lambda name: queries.groupBy(key).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias(name))
        left = index.join(blocks("copies"), key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        right = queries.join(blocks("blocks"), key).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int")).drop("blocks")
        met = left.groupBy(*key, "block").cogroup(right.groupBy(*key, "block")).applyInArrow(search, "query_id long, vec_id long, score double")
        return tables.save(met, name)

    near = searched(first, "near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.greatest(2 - 2 * F.col("score"), F.lit(0.0)).alias("far"))

    def opened(batches):
        for batch in batches:
            at, cell = [], []
            fars = batch.column(5).to_pylist()
            for d, rows_of, vectors in _by_length(batch.column(1)):
                points = units(vectors) @ projection(d)
                for row, point in zip(rows_of.tolist(), points, strict=True):
                    found = open_cells(cells[d], point, fars[row], sure) if d in cells else np.zeros(1, dtype=np.int64)
                    at += [row] * len(found)
                    cell += found.tolist()
            taken = batch.take(pa.array(at, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, type=pa.int32())], names=[*batch.schema.names, "cell"])

    asks = first.select("vec_id", "embedding", "d", F.col("cell").alias("home"), F.col("part").alias("home_part")).join(best, "vec_id", "left")
    every = asks.mapInArrow(opened, "vec_id long, embedding array<double>, d int, home int, home_part int, far double, cell int")
    every = every.join(parts, ["d", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = every.where("not (cell = home and part = home_part)").select("vec_id", "embedding", "d", "cell", "part", "far")
    ranked = near.union(searched(rest, "rest")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _by_length(column: pa.Array):
    """(length, places, matrix) of the vectors of each length."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _projected(batches):
    for batch in batches:
        for d, at, vectors in _by_length(batch.column(1)):
            points = units(vectors) @ projection(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, dtype=np.int32)), pa.array(points.tolist(), type=pa.list_(pa.float64()))], names=["d", "point"])
