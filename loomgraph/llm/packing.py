"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import blocks_for, slices, texts

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its capacity, in tokens.
OVERHEAD = 16
#: Documents to a shard, about; shards are packed apart.
SHARD = 16_384


def word_tokens(text: bytes) -> int:
    """Words and one end mark."""
    return len(text.split()) + 1


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin and its offset there, and each bin's capacity.  Pieces fit the largest capacity.

    Longest first, each piece goes to the open bin that it leaves least room in.  If none has room, a bin is opened: for
    each permitted capacity, what is still to come is tried on it, largest that fits first, and the capacity with the
    least cost (downsized capacity plus overhead) for each token held is taken.  At the end each bin shrinks to the
    smallest capacity that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacities[-1] + 1).tolist()  # pieces to come, by length
    there = sum(1 << n for n, c in enumerate(left) if c)  # bit n: some piece of length n is to come
    room: dict[int, list[int]] = {}  # open bins by the room they have
    rooms = 0  # bit r: some open bin has room r
    held: list[int] = []
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    shrunk = lambda used: next(c for c in capacities if c >= used)

    def rate(first: int, capacity: int) -> tuple[float, int]:
        used, taken = first, {}
        while fits := there & ((1 << (capacity - used + 1)) - 1):
            n = fits.bit_length() - 1
            while n > 0 and taken.get(n, 0) >= left[n]:  # all of this length are in already
                fits &= ~(1 << n)
                n = fits.bit_length() - 1
            if n <= 0:
                break
            several = min(left[n] - taken.get(n, 0), (capacity - used) // n)
            taken[n] = taken.get(n, 0) + several
            used += several * n
        return (shrunk(used) + overhead) / used, capacity

    for at in order.tolist():
        n = int(lengths[at])
        left[n] -= 1
        if not left[n]:
            there &= ~(1 << n)
        if fits := rooms >> n:
            r = n + (fits & -fits).bit_length() - 1
            chosen = room[r].pop()
            if not room[r]:
                rooms &= ~(1 << r)
        else:
            r = min(rate(n, c) for c in capacities if c >= n)[1]
            chosen = len(held)
            held.append(0)
        bins[at], offsets[at] = chosen, held[chosen]
        held[chosen] += n
        if r > n:
            room.setdefault(r - n, []).append(chosen)
            rooms |= 1 << (r - n)
    return bins, offsets, np.array([shrunk(h) for h in held], dtype=np.int64)


def pack_documents(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD, length: Callable[[bytes], int] = word_tokens
) -> DataFrame:
    """A row for each piece of each whole document: doc_id, piece (from 0), start and n_tokens (the tokens of the document
    in it), bin_id, bin_offset and capacity.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest.  A null or empty text has
    its end mark alone.  Repeated rows are packed each by itself.  An empty table gives an empty result.

    Pieces are dealt into shards by a hash of id, text and piece, and of how often a task has met the same before, so that
    rows that repeat are spread as well; a shard has about `shard` documents however many there are, and is packed by
    itself: only lengths and ids are shuffled.  Splitting costs a few part-filled bins a shard.
    """
    if any(c < 1 for c in capacities):
        raise ValueError("capacities must be positive")
    id_type = df.select(f"`{id_col}`").schema[0].dataType.simpleString()
    docs = texts(df, id_col, text_col)
    shards, most = blocks_for(docs.count(), shard), max(capacities)

    def cut(batches):
        met: dict[int, int] = {}  # times that a document has come
        for batch in slices(batches, "text"):
            if len(met) > 200_000:
                met.clear()
            where, piece, size, dealt = [], [], [], []
            for row, text in enumerate(x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()):
                n, key = length(text), zlib.crc32(text, zlib.crc32(repr(batch.column(0)[row].as_py()).encode()))
                again = met.get(key, 0)
                met[key] = again + 1
                for k, start in enumerate(range(0, max(n, 1), most)):
                    where.append(row)
                    piece.append(k)
                    size.append(min(most, n - start))
                    dealt.append(zlib.crc32(b"%d %d %d" % (key, k, again)) % shards)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, type=pa.int64())), pa.array(piece, type=pa.int32()), pa.array(size, type=pa.int64()), pa.array(dealt, type=pa.int64())],
                names=["doc_id", "piece", "n_tokens", "shard"],
            )

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, sizes = pack(table.column("n_tokens").to_numpy(), capacities, overhead)
        first = table.column("shard")[0].as_py() << 32
        starts = table.column("piece").to_numpy().astype(np.int64) * most
        return pa.table({
            "doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": starts, "n_tokens": table.column("n_tokens"),
            "bin_id": first + bins, "bin_offset": offsets, "capacity": sizes[bins],
        })

    pieces = docs.mapInArrow(cut, f"doc_id {id_type}, piece int, n_tokens long, shard long")
    return pieces.groupBy("shard").applyInArrow(fill, f"doc_id {id_type}, piece int, start long, n_tokens long, bin_id long, bin_offset long, capacity long")
