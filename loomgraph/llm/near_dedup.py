"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A sketch fills its t coordinates in rounds: in each of the first t rounds every element is hashed to a coordinate and a
value, values of earlier rounds being smaller; in round t + j every element goes to coordinate j.  So each coordinate is
filled after 2 t rounds at the latest, usually after about t ln(t) / n, and coordinates of two sets agree with
probability equal to their Jaccard similarity, concentrated as for t independent min-hashes.

Texts with equal shingle sets are one class.  Classes that share a band's bucket are candidates.  First every class is held
against the smallest class of each of its buckets, and linked classes are merged into components.  Then the members of each
bucket that still holds several components meet, those of different components that their sketches allow are compared as
whole sets, and components are merged as links are found.  After that nothing that shares a bucket is left untested
between two components.  The pairs of a bucket are never listed: its members are dealt into parts of bounded size, two
parts meet in one task, and only links between components leave it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import U64, Tables, Words, mix64, slices, texts, window_hashes

WORDS = 5
#: Coordinates of a sketch.
COORDINATES = 640
#: Members of a bucket to a part, and shingles to a part, about.
PART, PART_SHINGLES = 1024, 1 << 21
#: So many edges are left to one task.
FEW_EDGES = 50_000
EMPTY = np.iinfo(np.uint64).max


def banding(percent: int, coordinates: int = COORDINATES, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the longest bands for which a pair at the threshold shares none with probability `miss` at most."""
    s = percent / 100
    fits = [(coordinates // r, r) for r in range(1, 33) if (1 - s**r) ** (coordinates // r) <= miss]
    return fits[-1]


# --- sets and sketches ---------------------------------------------------------------------------------------------


def shingle_sets(raw: list[bytes]) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles."""
    words, ids, sizes = Words(), [], []
    for text in raw:
        own = text.lower().split()
        ids += words.of(own)
        sizes.append(len(own))
    hashed = words.hashes()[np.array(ids, dtype=np.int64)] if ids else np.empty(0, dtype=U64)
    windows = window_hashes(hashed, WORDS)
    out, at = [], 0
    for n in sizes:
        if n >= WORDS:
            out.append(np.unique(windows[at : at + n - WORDS + 1]))
        elif n:
            out.append(mix64(window_hashes(hashed[at : at + n], n) + U64(n)))
        else:
            out.append(np.empty(0, dtype=U64))
        at += n
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t coordinates for each set; all EMPTY for an empty set."""
    out = np.full((len(sets), t), EMPTY, dtype=U64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    group = max(1, (1 << 20) // (8 * t))  # coordinates of one group stay in the processor's cache
    order = np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())]  # sets of like size need about as many rounds
    for begin in range(0, len(order), group):
        rows = order[begin : begin + group]
        out[rows] = _filled([sets[i] for i in rows], t)
    return out


def _filled(sets: list[np.ndarray], t: int) -> np.ndarray:
    out = np.full(len(sets) * t, EMPTY, dtype=U64)
    owner = np.repeat(np.arange(len(sets)) * t, [len(s) for s in sets])
    elements = np.concatenate(sets)
    open_ = np.arange(len(sets))  # sets with an empty coordinate
    for k in range(2 * t):
        if k < t:
            spread = elements * U64((k * 0x9E3779B97F4A7C16 + 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)  # by an odd number of the round's own
            at = owner + (((spread >> U64(32)) * U64(t)) >> U64(32)).astype(np.int64)
        else:
            at = owner + (k - t)
        free = np.flatnonzero(out[at] >= U64(k) << U64(32))  # earlier rounds have smaller values
        if len(free):
            at, value = at[free], mix64(elements[free] + U64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            np.minimum.at(out, at, (U64(k) << U64(32)) | (value & U64(0xFFFFFFFF)))
        if k < 4 or k % 8 == 0 or k >= t:
            still = (out.reshape(-1, t)[open_] == EMPTY).any(axis=1)
            if not still.all():
                open_ = open_[still]
                if not len(open_):
                    break
                left = np.isin(owner, open_ * t)
                elements, owner = elements[left], owner[left]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = mix64(sketch[:, : bands * rows].ravel()).reshape(len(sketch), bands, rows)
    out = np.tile(mix64(np.arange(1, bands + 1, dtype=U64)), (len(sketch), 1))
    for r in range(rows):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def bits_of(sketch: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, 64 to a number; bits of two sets agree with probability (1 + similarity) / 2."""
    bits = (mix64(sketch.ravel() + U64(1)).reshape(sketch.shape) & U64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").astype(np.int64)


def class_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def lists(matrix: np.ndarray, mask: np.ndarray) -> pa.Array:
    """One list for each row; null where `mask` holds."""
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()), mask=pa.array(mask))


def signatures(df: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n (size of the set), class (a 128-bit digest of the set; null for an empty set), and for the first
    document of a class that a task meets short (64 bits of class), bands, bits and z (the text's words, compressed)."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zlib

        met: set[bytes] = set()
        for batch in slices(batches, "text", 4 << 20):
            raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            sets = shingle_sets(raw)
            named = [class_of(s) if len(s) else None for s in sets]
            known = batch.column(0).is_valid().to_pylist()
            new = np.zeros(len(sets), dtype=bool)
            for i, c in enumerate(named):
                if c is not None and known[i] and c not in met:
                    new[i] = True
                    met.add(c)
            if len(met) > 200_000:  # a class met again is only written once more
                met.clear()
            at = np.flatnonzero(new)
            keys, bits = np.zeros((len(sets), bands), dtype=np.int64), np.zeros((len(sets), COORDINATES // 64), dtype=np.int64)
            if len(at):
                table = sketches([sets[i] for i in at])
                keys[at], bits[at] = band_keys(table, bands, rows).view(np.int64), bits_of(table)
            short = [int.from_bytes(c[:8], "little", signed=True) if own else None for c, own in zip(named, new, strict=True)]
            z = [zlib.compress(b" ".join(t.lower().split()), 1) if own else None for t, own in zip(raw, new, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(named, type=pa.binary()), pa.array(short, type=pa.int64()), lists(keys, ~new), lists(bits, ~new), pa.array(z, type=pa.binary())],
                names=["doc_id", "text_key", "n", "class", "short", "bands", "bits", "z"],
            )

    return df.mapInArrow(run, f"doc_id {id_type}, text_key long, n long, class binary, short long, bands array<long>, bits array<long>, z binary")


# --- candidates and their verification ---------------------------------------------------------------------------------


def least_agreement(percent: int, coordinates: int = COORDINATES) -> int:
    """Bits that two sets at the threshold agree in but for a probability of 1e-9 (six deviations), which is far below
    that of sharing no band."""
    p = (1 + percent / 100) / 2
    return int(coordinates * p - 6 * (coordinates * p * (1 - p)) ** 0.5)


def near_enough(a: Column, b: Column, percent: int, coordinates: int = COORDINATES) -> Column:
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, coordinates // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))
    return F.lit(coordinates) - differ >= least_agreement(percent, coordinates)


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, packs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose whole sets are similar enough.  `packs` has class and z."""

    def run(batches):
        import zlib
        from collections import OrderedDict

        known: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(names: list[bytes], data: list[bytes]) -> None:
            new = {c: z for c, z in zip(names, data, strict=True) if c not in known}
            for c, own in zip(new, shingle_sets([zlib.decompress(z) for z in new.values()]), strict=True):
                known[c] = own

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                u, v, zu, zv = (batch.column(i).to_pylist() for i in range(4))
                of(u, zu)
                of(v, zv)
                keep = []
                for x, y in zip(u, v, strict=True):
                    both = len(np.intersect1d(known[x], known[y], assume_unique=True))
                    keep.append(100 * both >= percent * (len(known[x]) + len(known[y]) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, type=pa.bool_()))
                while len(known) > 2000 or sum(map(len, known.values())) > 4_000_000 and len(known) > 1:
                    known.popitem(last=False)

    left = packs.select(F.col("class").alias("u"), F.col("z").alias("zu"))
    right = packs.select(F.col("class").alias("v"), F.col("z").alias("zv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "zu", "zv").mapInArrow(run, "u binary, v binary")


def links_across(sets: list[np.ndarray], roots: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places (x, y) of links between different components, enough of them to join all components that links between
    `left` and `right` join.  Sets, the component's number and the sketch's bits are given for each place."""
    sizes, roots, least = np.array([len(s) for s in sets]), roots.copy(), least_agreement(percent)
    _, inside = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark, out = np.zeros(int(inside.max()) + 1, dtype=np.int32), []
    for x in left.tolist():
        y = right[roots[right] != roots[x]]
        y = y[np.minimum(sizes[y], sizes[x]) * 100 >= np.maximum(sizes[y], sizes[x]) * percent]
        y = y[64 * bits.shape[1] - np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) >= least]
        if not len(y):
            continue
        own = inside[starts[x] : ends[x]]
        mark[own] = 1
        both = np.array([mark[inside[starts[k] : ends[k]]].sum() for k in y])
        mark[own] = 0
        for k in y[100 * both >= percent * (sizes[x] + sizes[y] - both)].tolist():
            if roots[k] != roots[x]:
                out.append((x, k))
                roots[roots == roots[k]] = roots[x]
    return out


def across(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): components that links within a bucket join.  `members` has band, parts (of its bucket), class, root (the
    component), bits and z (the class's words).

    A member goes to every meeting of its own part with another, itself included, so a task holds two parts at a time,
    however large a bucket is."""
    dealt = members.withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meetings = dealt.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "root", "bits", "z")

    def meet(table: pa.Table):
        import zlib

        names, roots = table.column("class").to_pylist(), table.column("root").to_pylist()
        code = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        if len(code) < 2:
            return
        part, i, j = table.column("part").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(U64).reshape(len(names), -1)
        sets = shingle_sets([zlib.decompress(z) for z in table.column("z").to_pylist()])
        found = links_across(sets, np.array([code[r] for r in roots]), bits, np.flatnonzero(part == i), np.flatnonzero(part == j), percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([roots[p[k]] for p in found], type=pa.binary()) for k in (0, 1)], names=["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # the rows of the meeting that goes on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(k).to_numpy() for k in range(3)]
            new = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            starts = [0, *new.tolist(), batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                now = tuple(k[s] for k in key)
                if held and now != last:
                    yield from meet(pa.Table.from_batches(held))
                    held = []
                last = now
                held.append(batch.slice(s, e - s))
        if held:
            yield from meet(pa.Table.from_batches(held))

    met = meetings.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return met.mapInArrow(run, "u binary, v binary")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for every node of the edges (u, v): the same root for all that are connected.

    By contraction: each node goes to the one with the least hash among itself and its neighbours, edges are carried over
    to where their ends went, and what is left is contracted again under another hash, so that chains shrink as stars do.
    Each step is an aggregation with partial sums and two plain joins, whose skewed sides adaptive execution splits.  As
    soon as FEW_EDGES at most are left, one task joins their ends.
    """
    rounds = []
    edges = tables.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while edges.count() > FEW_EDGES:
        rank = lambda c, k=len(rounds): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("to"))
        both = edges.select("u", rank("v").alias("m")).union(edges.select(F.col("v").alias("u"), rank("u").alias("m")))
        goes = both.groupBy("u").agg(F.min("m").alias("m")).select(F.col("u").alias("node"), F.least("m", rank("u"))["to"].alias("to"))
        goes = tables.save(goes, "goes")
        x, y = goes.select(F.col("node").alias("u"), F.col("to").alias("p")), goes.select(F.col("node").alias("v"), F.col("to").alias("q"))
        moved = edges.join(x, "u").join(y, "v").where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v"))
        left = tables.save(moved.distinct(), "edges")
        tables.drop(edges)
        rounds.append(goes)
        edges = left

    def join_ends(batches):
        root: dict[bytes, bytes] = {}

        def find(a: bytes) -> bytes:
            while (b := root.setdefault(a, a)) != a:
                root[a] = a = root[b]
            return a

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.binary()), pa.array([find(a) for a in nodes], type=pa.binary())], names=["node", "to"])

    rounds.append(tables.save(edges.repartition(1).mapInArrow(join_ends, "node binary, to binary"), "goes"))
    out = rounds[0].select("node", F.col("to").alias("root"))
    for goes in rounds[1:]:
        out = out.join(goes.select(F.col("node").alias("root"), F.col("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


# --- the operator ----------------------------------------------------------------------------------------------------


def near_duplicates(df: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach, itself included) and kept, a row for each row.

    Links join documents whose sets of distinct 5-word shingles (lower-cased over A-Z; a text of fewer words is one
    shingle) have 100 * intersection >= percent * union.  A null or empty text has an empty set and no link.  A row
    with a null id has none either: its component_id is null and it is kept.  Rows that repeat an id are rows of their
    own, linked by their texts.  An empty table gives an empty result.  Other columns are ignored.  `with_key` adds
    text_key, Spark's xxhash64 of the text.
    """
    tables = Tables(df.sparkSession)
    bands, rows = banding(percent)
    docs = texts(df, id_col, text_col)
    made = tables.save(signatures(docs.withColumn("text_key", F.xxhash64("text")), bands, rows), "signatures")

    # buckets that two classes share, by their smallest and largest class; 64 bits stand for a class here, and should
    # two classes ever share those, both are looked up by them
    members = made.where("short is not null").select("short", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("short").alias("pivot"), F.max("short").alias("other")).where("pivot <> other").select("band", "pivot")
    held = tables.save(members.join(shared, "band"), "held")  # a class that several tasks have met is there for each
    wanted = held.select("short").distinct()
    looks = tables.save(made.where("short is not null").select("class", "short", "n", "bits", "z").join(wanted, "short").groupBy("class").agg(*(F.any_value(c).alias(c) for c in ("short", "n", "bits", "z"))), "looks")
    light = looks.select("class", "short", "n", "bits")
    inside = tables.save(held.join(light.select("short", "class"), "short").select("band", "class"), "inside")

    def merged(rooted: DataFrame, edges: DataFrame) -> DataFrame:
        found = components(edges, tables).select(F.col("node").alias("old"), F.col("root").alias("new"))
        return tables.save(rooted.join(found, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "rooted")

    left, right = light.alias("x"), light.alias("y")
    fit = sizes_fit(F.col("x.n"), F.col("y.n"), percent) & near_enough(F.col("x.bits"), F.col("y.bits"), percent)
    near = held.where("short <> pivot").select("short", "pivot").distinct()
    near = near.join(left, near["short"] == F.col("x.short")).join(right, F.col("pivot") == F.col("y.short")).where(fit)
    pairs = near.select(F.col("x.class").alias("u"), F.col("y.class").alias("v"))
    rooted = merged(light.select(F.col("class").alias("node"), F.col("class").alias("root")), confirmed(pairs, looks.select("class", "z"), percent))

    seen = inside.join(rooted, F.col("class") == F.col("node")).join(light.select("class", "n"), "class").select("band", "class", "root", "n")
    seen = tables.save(seen, "seen")
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("n") / PART_SHINGLES)).cast("int")
    mixed = seen.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), parts.alias("parts")).where("low <> high").select("band", "parts")
    members = seen.join(mixed, "band").join(looks.select("class", "bits", "z"), "class")
    rooted = merged(rooted, across(members, percent))
    tables.drop(held, inside, looks, seen)

    # a class's component is known by the smallest id in it; what is joined is a table, so that a hot side can be split
    classes = made.where("doc_id is not null and n > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    linked = tables.save(classes.join(rooted, F.col("class") == F.col("node")).select("class", "first", "root"), "linked")
    lowest = tables.save(linked.groupBy("root").agg(F.min("first").alias("component")), "lowest")
    moved = tables.save(linked.join(lowest, "root").where("component < first").select("class", "component"), "moved")
    where = tables.save(classes.join(moved, "class", "left").select("class", F.coalesce("component", "first").alias("component")), "components")
    tables.drop(linked, lowest, moved)
    out = made.select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(where, "class", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(*["text_key"] * with_key, "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def deduplicate(df: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose document is the smallest id of its group, with all their columns.  Of rows that repeat
    both id and text one stays; rows with a null id all stay.  A column's name never clashes with the operator's."""
    out = near_duplicates(df, percent=percent, id_col=id_col, text_col=text_col, with_key=True).where("doc_id is not null")
    # only ids and hashes of texts that are to go or that repeat are joined back
    fate = out.groupBy("doc_id", "text_key").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
    fate = fate.select(F.col("doc_id").alias("\x01id"), F.col("text_key").alias("\x01key"), F.col("kept").alias("\x01again"))
    same = (F.col(f"`{id_col}`") == F.col("`\x01id`")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("`\x01key`"))
    told = df.join(fate, same, "left")
    columns = [F.col(f"`{c}`") for c in df.columns]
    once = told.where("`\x01again` is null").select(*columns)
    many = told.where("`\x01again`").select(*columns).dropDuplicates([id_col, text_col])
    return once.union(many)
