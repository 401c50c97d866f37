"""Relations: bags of solutions whose variables have shapes.

A relation is a union of branches that isn't carried out yet.  A branch has one shape for each variable, so a join or
filter that shapes rule out drops the branch while the query is planned.  A branch is either a DataFrame, or still a scan
of one table with tests, so that joins on the table's unique key become one scan.  Physical columns have names of
their own throughout a query; joins never have to tell columns apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.terms import Const, Dyn, Lit, Node, Tri, bound, col, form, kinds, refs, same, struct, with_refs

_names = itertools.count(1)
#: Pairs of branches up to which a join is carried out pair by pair.
PAIRS = 16
#: Bytes of one side's files times those of the other's from which a join that isn't on a unique key is looked at more closely.
CLOSELY = 1 << 32
#: Rows of a side to a block: a key with more pairs of rows than BLOCK * BLOCK is joined block by block.
BLOCK = 2048
#: Rows that stand for others, and how many they stand for at most; tasks that such rows and blocks are dealt to at most.
STANDS, TASKS = 1 << 11, 2000


def fresh(stem: str = "c") -> str:
    return f"{stem}{next(_names)}"


@dataclass(frozen=True)
class Table:
    """A table that scans read: `key` are the columns that no two rows share, if `unique`."""

    name: str
    df: DataFrame
    key: tuple[str, ...] = ()
    unique: bool = True

    @property
    def types(self) -> dict[str, str]:
        return dict(self.df.dtypes)


@dataclass(frozen=True)
class Scan:
    table: Table
    alias: str
    #: What gives a condition, the shapes that it is given, and the condition, or None where it is still to be made.
    tests: tuple[tuple[Callable, tuple, Column | None], ...] = ()
    #: Gives an array of (p, o) terms, from what names a column; each row stands once for each of them, under the columns
    #: ~p and ~o.
    spread: Callable[[Callable[[str], str]], Column] | None = None

    def ref(self, column: str) -> str:
        return f"{self.alias}__{column}"

    def frame(self) -> DataFrame:
        out = self.table.df.toDF(*map(self.ref, self.table.df.columns))
        if self.spread:
            pair = self.ref("~")
            out = out.withColumn(pair, F.explode(self.spread(self.ref)))
            out = out.withColumns({self.ref("~p"): F.col(pair)["p"], self.ref("~o"): F.col(pair)["o"]}).drop(pair)
        conditions = [make(*shapes) if found is None else found for make, shapes, found in self.tests]
        return out.where(reduce(Column.__and__, conditions)) if conditions else out

    def renamed(self, alias: str) -> Callable[[object], object]:
        return lambda ref: alias + ref[len(self.alias) :] if isinstance(ref, str) and ref.startswith(self.alias + "__") else ref


@dataclass(frozen=True)
class Product:
    """Pairs of rows that pass tests, as in Scan: a join in which a row may meet many on either side."""

    left: Branch
    right: Branch
    tests: tuple[tuple[Callable, tuple, Column], ...] = ()
    made: list = field(default_factory=list, compare=False)

    def frame(self, spark: SparkSession) -> DataFrame:
        if not self.made:
            keys, one, two, rest = self._parts(spark)
            joined = _by_blocks(one, two, keys) if keys else one[0].crossJoin(two[0])
            self.made.append(joined.where(reduce(Column.__and__, rest)) if rest else joined)
        return self.made[0]

    def select(self, spark: SparkSession, outputs: list[Column], columns: set[str]) -> DataFrame:
        """What is made of `columns` alone.  A side of which nothing but its keys is asked for is counted, and the rows that
        it stands for are made at the end."""
        keys, (left, _), (right, _), rest = self._parts(spark)
        counted = [columns & set(df.columns) <= {k[i] for k in keys} for i, df in enumerate((left, right))]
        tasks = min(TASKS, 1 + _size(left) * _size(right) // CLOSELY)
        if not keys or rest or not any(counted) or tasks == 1:
            return self.frame(spark).select(*outputs)
        times, sides = F.lit(1).cast("long"), []
        for i, df in enumerate((left, right)):
            if counted[i]:
                n = fresh("n")
                df, times = df.groupBy(*(F.col(f"`{c}`") for c in dict.fromkeys(k[i] for k in keys))).agg(F.count(F.lit(1)).alias(n)), times * F.col(n)
            sides.append(df)
        total, block, size = fresh("n"), fresh("n"), fresh("n")
        met = sides[0].join(sides[1], _equal(keys), "inner").select(*outputs, times.alias(total))
        names = [F.col(f"`{c}`") for c in met.columns[:-1]]
        step = F.lit(STANDS).cast("long")
        parts = met.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({total} - 1) div {STANDS}"))))
        parts = parts.select(*names, F.least(step, F.col(total) - F.col(block) * step).cast("int").alias(size)).repartition(tasks)
        return parts.select(*names, F.explode(F.array_repeat(F.lit(True), F.col(size))).alias(block)).select(*names)

    def _parts(self, spark: SparkSession) -> tuple[list[tuple[str, str]], tuple, tuple, list[Column]]:
        """Pairs of columns that must be equal; either side's rows, by its own tests, and what tells them apart; other tests."""
        sides, keys, rest = [self.left, self.right], [], []
        columns = [set(x.frame(spark).columns) for x in sides]
        for make, shapes, found in self.tests:
            used = {r for x in shapes for r in refs(x)}
            at = next((i for i in (0, 1) if used <= columns[i]), None)
            if at is not None:
                sides[at] = sides[at].where(make, *shapes)
                continue
            pairs = _pairs(*shapes) if make is same else None
            if pairs and all(x in columns[1] for x, _ in pairs):
                pairs = [(y, x) for x, y in pairs]
            if pairs and all(x in columns[0] and y in columns[1] for x, y in pairs):
                keys += pairs
            else:
                rest.append(found)
        one, two = ((b.frame(spark), b.rows()) for b in sides)
        types = dict(one[0].dtypes) | dict(two[0].dtypes)
        if any(types[x] != types[y] for x, y in keys):
            keys, rest = [], [*rest, _equal(keys)]
        return keys, one, two, rest


def _pairs(a, b) -> list[tuple[str, str]] | None:
    """The columns that are equal where two shapes are the same term, if that is all it takes."""
    if form(a) != form(b) or not refs(a) or isinstance(a, Tri) or not (invertible(a) and all(isinstance(r, str) for r in refs(a) + refs(b))):
        return None
    return list(zip(refs(a), refs(b), strict=True))


def _equal(keys: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, (F.col(f"`{x}`") == F.col(f"`{y}`") for x, y in keys))


def _size(df: DataFrame) -> int:
    """Bytes of the files that a frame reads; 0 where Spark can't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return 0 if max(sizes, default=0) >= 1 << 60 else sum(sizes)


def _by_blocks(left: tuple[DataFrame, list[str]], right: tuple[DataFrame, list[str]], keys: list[tuple[str, str]]) -> DataFrame:
    """The join on equal keys.  Where a key has many rows on both sides, these are dealt into blocks, and each block of one
    side meets each of the other in a place of its own; how many pairs there are is counted beforehand."""
    plain = left[0].join(right[0], _equal(keys), "inner")
    if _size(left[0]) * _size(right[0]) < CLOSELY:
        return plain
    names, counts, blocks = [], [], (fresh("b"), fresh("b"))
    for i, (df, _) in enumerate((left, right)):
        own = [k[i] for k in keys]
        names.append([fresh("k") for _ in own])
        counts.append(df.groupBy(*(F.col(f"`{c}`").alias(n) for c, n in zip(own, names[i], strict=True))).agg(F.count(F.lit(1)).alias(blocks[i])))
    pairs = F.col(blocks[0]).cast("double") * F.col(blocks[1]) / (BLOCK * BLOCK)
    every = counts[0].join(counts[1], _equal(list(zip(*names, strict=True))), "inner")
    full, rows = every.agg(F.sum(pairs), F.sum(F.col(blocks[0]) + F.col(blocks[1]))).first()
    if not full or full <= 1 or full * BLOCK * BLOCK < 16 * rows:  # blocks against blocks, as if all were full
        return plain
    many = every.where(pairs > 1).select(*names[0], *(F.ceil(F.col(b) / BLOCK).alias(b) for b in blocks))
    least = int(left[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks, dealt, at = max(least, min(TASKS, int(full))), [], []
    for i, (df, rows) in enumerate((left, right)):
        own, here = [k[i] for k in keys], {n: fresh("k") for n in (*names[0], *blocks)}
        at.append([fresh("b"), fresh("b")])
        out = df.join(F.broadcast(many.toDF(*here.values())), _equal(list(zip(own, (here[n] for n in names[0]), strict=True))), "left")
        out = out.withColumn(at[i][i], F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows)), F.coalesce(here[blocks[i]], F.lit(1))))
        out = out.withColumn(at[i][1 - i], F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(here[blocks[1 - i]], F.lit(1)) - 1))).drop(*here.values())
        dealt.append(out.repartition(tasks, *(F.col(f"`{c}`") for c in (*own, *at[i]))))
    return dealt[0].join(dealt[1], _equal([*keys, *zip(*at, strict=True)]), "inner").drop(*at[0], *at[1])


@dataclass(frozen=True)
class Branch:
    vars: dict = field(default_factory=dict)
    certain: frozenset = frozenset()
    df: DataFrame | None = None
    scan: Scan | None = None
    #: Stands where neither `df` nor `scan` does.
    product: Product | None = None

    @property
    def unit(self) -> bool:
        """One row, no columns."""
        return self.df is None and self.scan is None and self.product is None

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.scan or self.df is not None:
            return self.scan.frame() if self.scan else self.df
        return self.product.frame(spark) if self.product else spark.range(1).select()

    def select(self, spark: SparkSession, outputs: list[Column], used: set) -> DataFrame:
        """Outputs over the columns in `used`."""
        if self.product and self.df is None and all(isinstance(r, str) for r in used):
            return self.product.select(spark, outputs, used)
        return self.frame(spark).select(*outputs)

    def rows(self) -> list[str]:
        """Columns that tell rows apart as well as any."""
        if self.scan and self.scan.table.unique and self.scan.table.key and not self.scan.spread:
            return [self.scan.ref(c) for c in self.scan.table.key]
        return list(dict.fromkeys(r for x in self.vars.values() for r in refs(x)))

    def singles(self, names: Iterable[str]) -> bool:
        """Whether no two rows agree on these variables."""
        if not (self.scan and self.scan.table.unique and self.scan.table.key and not self.scan.spread):
            return False
        key = {self.scan.ref(c) for c in self.scan.table.key}
        return any(isinstance(x := self.vars[v], Node) and invertible(x) and set(refs(x)) == key for v in names)

    def only(self, names: Iterable[str]) -> Branch:
        keep = set(names)
        return replace(self, vars={v: x for v, x in self.vars.items() if v in keep}, certain=self.certain & keep)

    def where(self, make: Callable, *shapes, spark: SparkSession | None = None) -> Branch | None:
        """The rows for which make(*shapes) holds; None if none can.  `make` gives a column, a truth value or None."""
        found = make(*shapes)
        if found is None or found is False:
            return None
        if found is True:
            return self
        stored = all(isinstance(r, str) for x in shapes for r in refs(x))
        if self.scan and stored:
            return replace(self, scan=replace(self.scan, tests=(*self.scan.tests, (make, shapes, found))))
        if self.product and self.df is None and stored:
            return replace(self, product=replace(self.product, tests=(*self.product.tests, (make, shapes, found)), made=[]))
        return replace(self, df=self.frame(spark).where(found), scan=None)

    def needing(self, var: str) -> Branch:
        return replace(self, certain=self.certain | {var})


def split(branch: Branch, names: Iterable[str], spark: SparkSession) -> list[Branch]:
    """The branch in parts in which each of the variables is either bound throughout or not there."""
    out = [branch]
    for v in sorted(names):
        parts = []
        for b in out:
            if v not in b.vars or v in b.certain:
                parts.append(b)
                continue
            there = b.where(bound, b.vars[v], spark=spark)
            if there:
                parts.append(there.needing(v))
            if refs(b.vars[v]):
                gone = b.where(lambda x: ~bound(x), b.vars[v], spark=spark)
                parts.append(gone.only(set(b.vars) - {v}))
        out = parts
    return out


@dataclass(frozen=True)
class Relation:
    branches: tuple[Branch, ...]
    scope: frozenset  # variables that may be bound

    def certain(self, var: str) -> bool:
        return all(var in b.certain for b in self.branches)


UNIT = Relation((Branch(),), frozenset())


def relation(branches: Iterable[Branch | None], scope: Iterable[str]) -> Relation:
    return Relation(tuple(b for b in branches if b is not None), frozenset(scope))


# --- storing shapes ----------------------------------------------------------------------------------------------


def stored(x, into: dict[str, Column], stem: str = "v"):
    """The shape over new columns, which are added to `into`."""

    def keep(ref):
        name = fresh(stem)
        into[name] = col(ref)
        return name

    return with_refs(x, keep)


def with_values(branch: Branch, values: dict[str, object], spark: SparkSession, certain: Iterable[str] = ()) -> Branch:
    """The branch with further variables.  Shapes that only use columns as they are cost nothing."""
    new, vars_ = {}, dict(branch.vars)
    for v, x in values.items():
        if x is None:
            continue
        vars_[v] = x if all(isinstance(r, str) for r in refs(x)) else stored(x, new)
    sure = branch.certain | set(certain)
    if not new:
        return replace(branch, vars=vars_, certain=sure)
    return Branch(vars_, sure, branch.frame(spark).withColumns(new))


def invertible(x) -> bool:
    """Whether equal terms have equal columns and the other way round."""
    if isinstance(x, Node):
        return T._pattern(x)[1]
    return all(map(invertible, (x.s, x.p, x.o))) if isinstance(x, Tri) else True


def merged(rel: Relation, spark: SparkSession, names: Iterable[str] | None = None) -> Branch:
    """The relation as one branch: a variable keeps its natural columns where all branches agree on its form, and
    becomes a term struct otherwise."""
    from loomgraph.functions.expressions import natural

    names = sorted(rel.scope if names is None else names)
    if len(rel.branches) == 1:
        return rel.branches[0].only(names)
    if not rel.branches:
        shapes = {v: Dyn(fresh("e")) for v in names}
        df = spark.range(0).select(*(F.lit(None).cast(T.TERM).alias(x.ref) for x in shapes.values()))
        return Branch(shapes, frozenset(), df)
    shapes, columns = {}, [[] for _ in rel.branches]
    for v in names:
        own = [b.vars.get(v) for b in rel.branches]
        there = [x for x in own if x is not None]
        if not there:
            continue
        sure = all(v in b.certain for b in rel.branches)
        forms = {form(x) for x in there}
        if len(forms) > 1 and len(plain := {form(natural(x)) for x in there}) == 1 and isinstance(natural(there[0]), Lit):
            # constants beside columns of the same datatype
            own, there, forms = [None if x is None else natural(x) for x in own], [natural(x) for x in there], plain
        if len(forms) == 1 and (refs(there[0]) or sure):
            model = there[0]
            targets = [fresh("u") for _ in refs(model)]
            for x, out in zip(own, columns, strict=True):
                given = refs(x) if x is not None else [None] * len(targets)
                types = natural_types(model)
                out += [(F.lit(None) if r is None else col(r)).cast(kind).alias(n) for r, n, kind in zip(given, targets, types, strict=True)]
            named = iter(targets)
            shapes[v] = with_refs(model, lambda _, named=named: next(named))
        else:
            name = fresh("u")
            shapes[v] = Dyn(name, frozenset().union(*map(kinds, there)))
            for x, out in zip(own, columns, strict=True):
                out.append((F.lit(None).cast(T.TERM) if x is None else struct(x).cast(T.TERM)).alias(name))
    frames = [b.frame(spark).select(*c) for b, c in zip(rel.branches, columns, strict=True)]
    certain = frozenset(v for v in shapes if all(v in b.certain for b in rel.branches))
    return Branch(shapes, certain, reduce(DataFrame.union, frames))


def natural_types(x) -> list[str]:
    if isinstance(x, Node):
        return [p.kind for p in x.parts if isinstance(p, T.Key)]
    if isinstance(x, Tri):
        return [t for p in (x.s, x.p, x.o) for t in natural_types(p)]
    return ["timestamp_ntz" if x.dt == T.DATETIME else T.NATURAL[x.dt]] if isinstance(x, Lit) else [T.TERM] if isinstance(x, Dyn) else []


def copied(branch: Branch, spark: SparkSession) -> Branch:
    """The same solutions over columns of other names, so that they can be joined with where they come from."""
    new: dict[str, Column] = {}
    shapes = {v: stored(x, new) for v, x in branch.vars.items()}
    return Branch(shapes, branch.certain, branch.frame(spark).select(*(c.alias(n) for n, c in new.items())))


# --- joins -------------------------------------------------------------------------------------------------------


def _tests(a: Branch, b: Branch):
    """What must hold for solutions of the two to be compatible, their shared variables all being bound."""
    return T.all_of([same(a.vars[v], b.vars[v]) for v in sorted(set(a.vars) & set(b.vars))])


def _fused(a: Branch, b: Branch) -> Branch | None:
    """Two scans of one table that agree on its unique key, as one scan."""
    if not (a.scan and b.scan and a.scan.table.name == b.scan.table.name and a.scan.table.unique and a.scan.table.key):
        return None
    if a.scan.spread and b.scan.spread:
        return None
    rename = b.scan.renamed(a.scan.alias)
    key = {a.scan.ref(c) for c in a.scan.table.key}
    shared = set(a.vars) & set(b.vars)
    if not any(isinstance(a.vars[v], Node) and invertible(a.vars[v]) and set(refs(a.vars[v])) == key and with_refs(b.vars[v], rename) == a.vars[v] for v in shared):
        return None
    moved = tuple((make, tuple(with_refs(x, rename) for x in shapes), None) for make, shapes, _ in b.scan.tests)
    known = a.scan.tests
    out = Branch({**{v: with_refs(x, rename) for v, x in b.vars.items()}, **a.vars}, a.certain | b.certain, None, replace(a.scan, tests=(*known, *moved), spread=a.scan.spread or b.scan.spread))
    for v in shared:
        other = with_refs(b.vars[v], rename)
        if other != a.vars[v]:
            out = out.where(same, a.vars[v], other)
            if out is None:
                return None
    return out


def fused(left: Relation, right: Relation) -> Relation | None:
    """The join of two relations that read the same rows of one table, as one scan."""
    if len(left.branches) != 1 or len(right.branches) != 1:
        return None
    one = _fused(left.branches[0], right.branches[0])
    return None if one is None else Relation((one,), left.scope | right.scope)


def join_branches(a: Branch, b: Branch, spark: SparkSession) -> Branch | None:
    tests = _tests(a, b)
    if tests is False:
        return None
    vars_ = {**b.vars, **{v: x if not isinstance(x, Dyn) or v not in b.vars else b.vars[v] if not isinstance(b.vars[v], Dyn) else x for v, x in a.vars.items()}}
    if a.unit or b.unit:
        other = b if a.unit else a
        out = replace(other, vars=vars_, certain=a.certain | b.certain)
        return out if tests is True else replace(out, df=other.frame(spark).where(tests), scan=None)
    fused = _fused(a, b)
    if fused is not None:
        return fused
    shared = set(a.vars) & set(b.vars)
    if not a.singles(shared) and not b.singles(shared):
        pairs = [(same, (a.vars[v], b.vars[v]), same(a.vars[v], b.vars[v])) for v in sorted(shared)]
        return Branch(vars_, a.certain | b.certain, product=Product(a, b, tuple(p for p in pairs if p[2] is not True)))
    return Branch(vars_, a.certain | b.certain, a.frame(spark).join(b.frame(spark), tests, "inner"))


def join(left: Relation, right: Relation, spark: SparkSession) -> Relation:
    """Compatible mappings.  Branches are split on shared variables that may be unbound, so every join is on equalities."""
    scope = left.scope | right.scope
    for one, other in ((left, right), (right, left)):
        if len(one.branches) == 1 and one.branches[0].unit and not one.branches[0].vars:
            return Relation(other.branches, scope)
    shared = left.scope & right.scope

    def ready(rel: Relation) -> list[Branch]:
        return [p for b in rel.branches for p in split(b, shared, spark)]

    a, b = ready(left), ready(right)
    pairs = [(x, y) for x in a for y in b if _tests(x, y) is not False]
    if len(pairs) > PAIRS:
        # by which shared variables are bound, each side becomes one branch
        a, b = _by_bound(a, shared, left.scope, spark), _by_bound(b, shared, right.scope, spark)
        pairs = [(x, y) for x in a for y in b]
    return relation((join_branches(x, y, spark) for x, y in pairs), scope)


def _by_bound(branches: list[Branch], shared: Iterable[str], scope: Iterable[str], spark: SparkSession) -> list[Branch]:
    groups: dict[frozenset, list[Branch]] = {}
    for b in branches:
        groups.setdefault(frozenset(set(shared) & set(b.vars)), []).append(b)
    return [merged(Relation(tuple(g), frozenset(scope)), spark) for g in groups.values()]


def union(parts: list[Relation]) -> Relation:
    return relation((b for p in parts for b in p.branches), frozenset().union(*(p.scope for p in parts)))


def semi_parts(left: Branch, right: Relation, spark: SparkSession, shared: Iterable[str] | None = None, overlap: bool = False) -> tuple[list[Branch], list[Branch]]:
    """The branch's solutions with and without a compatible one in `right`; with `overlap`, one that shares a bound
    variable as well (as MINUS asks)."""
    shared = set(left.vars) & right.scope if shared is None else set(shared)
    others = [p.only(shared) for b in right.branches for p in split(b, shared, spark)]
    if len(others) > 4:
        others = _by_bound(others, shared, shared, spark)
    matched, missed = [], []
    for part in split(left, shared, spark):
        rest: Branch | None = part
        for other in others:
            tests = _tests(rest, other)
            if tests is False or overlap and not set(rest.vars) & set(other.vars):
                continue
            if other.unit:
                if tests is True:
                    matched.append(rest)
                    rest = None
                    break
                hit = replace(rest, df=rest.frame(spark).where(tests), scan=None)
                rest = replace(rest, df=rest.frame(spark).where(~F.coalesce(tests, F.lit(False))), scan=None)
                matched.append(hit)
                continue
            one, two = rest.frame(spark), other.frame(spark)
            if tests is True:
                two, tests = two.limit(1), F.lit(True)
            matched.append(replace(rest, df=one.join(two, tests, "left_semi"), scan=None))
            rest = replace(rest, df=one.join(two, tests, "left_anti"), scan=None)
        if rest is not None:
            missed.append(rest)
    return matched, missed


def flagged(left: Branch, right: Relation, spark: SparkSession, shared: Iterable[str] | None = None) -> list[tuple[Branch, Column | bool]]:
    """The branch's solutions, by which shared variables they bind, and whether each has a compatible one in `right`."""
    shared = set(left.vars) & right.scope if shared is None else set(shared)
    others = [p.only(shared) for b in right.branches for p in split(b, shared, spark)]
    if len(others) > 4:
        others = _by_bound(others, shared, shared, spark)
    out = []
    for part in split(left, shared, spark):
        outer = replace(part, vars={v: with_refs(x, lambda r: col(r).outer()) for v, x in part.vars.items()})
        flags: list[Column] = []
        sure = False
        for other in others:
            if other.unit:
                tests = _tests(part, other)
                sure = sure or tests is True
                if isinstance(tests, Column):
                    flags.append(F.coalesce(tests, F.lit(False)))
                continue
            tests = _tests(outer, other)
            if tests is not False:
                two = other.frame(spark)
                flags.append((two if tests is True else two.where(tests)).exists())
        flag = True if sure else reduce(Column.__or__, flags) if flags else False
        out.append((part, flag))
    return out


def minus(left: Relation, right: Relation, spark: SparkSession) -> Relation:
    if not left.scope & right.scope:
        return left
    return relation((b for x in left.branches for b in semi_parts(x, right, spark, overlap=True)[1]), left.scope)


def left_join(left: Relation, right: Relation, condition: Callable[[dict], object] | None, spark: SparkSession) -> Relation:
    """OPTIONAL.  `condition` sees the shapes of both sides; anything but true is no match."""
    scope, shared, out = left.scope | right.scope, left.scope & right.scope, []
    others = [p for b in right.branches for p in split(b, shared, spark)]
    if len(others) > 1:
        others = _by_bound(others, shared, right.scope, spark)
    for part in (p for b in left.branches for p in split(b, shared, spark)):
        near = [o for o in others if _tests(part, o) is not False]
        if not near:
            out.append(part)
            continue
        if len(near) == 1:
            out.append(_outer(part, near[0], condition, spark))
            continue
        rest = part
        for o in near:
            hit, rest = _matched(part, rest, o, condition, spark)
            out.append(hit)
        out.append(rest)
    return relation(out, scope)


def _with_presence(branch: Branch, spark: SparkSession) -> Branch:
    """Constants become columns, which an outer join can leave out."""
    new: dict[str, Column] = {}
    shapes = {v: x if refs(x) else stored(Dyn(struct(x), kinds(x)), new) for v, x in branch.vars.items()}
    return Branch(shapes, branch.certain, branch.frame(spark).withColumns(new)) if new else branch


def _conditions(a: Branch, b: Branch, condition) -> object:
    tests = _tests(a, b)
    if condition is None or tests is False:
        return tests
    found = condition({**b.vars, **a.vars})
    return T.all_of([tests, False if found is None else found])


def _outer(a: Branch, b: Branch, condition, spark: SparkSession) -> Branch:
    tests = _conditions(a, b, condition)
    if tests is False:
        return a
    if condition is None and (fused := _fused(a, b)) is not None and not b.scan.tests:
        return fused  # the same row of the same table is always there
    b = _with_presence(b, spark)
    right = b.frame(spark)
    df = a.frame(spark).join(right, F.lit(True) if tests is True else tests, "left")
    return Branch({**b.vars, **a.vars}, a.certain, df)


def _matched(whole: Branch, rest: Branch, b: Branch, condition, spark: SparkSession) -> tuple[Branch | None, Branch]:
    tests = _conditions(whole, b, condition)
    if tests is False:
        return None, rest
    on = F.lit(True) if tests is True else tests
    hit = Branch({**b.vars, **whole.vars}, whole.certain | b.certain, whole.frame(spark).join(b.frame(spark), on, "inner"))
    return hit, replace(rest, df=rest.frame(spark).join(b.frame(spark), on, "left_anti"), scan=None)


def left_join_by_rows(left: Relation, matches: Callable[[Relation], Relation], spark: SparkSession) -> Relation:
    """OPTIONAL whose matches can't be told by a join condition: `matches` gives the joined solutions that hold, and
    solutions of `left` that none of them extends stay alone.  Equal solutions share their fate."""
    out, scope = [], set(left.scope)
    for b in left.branches:
        frame = b.frame(spark)
        kept = Branch(b.vars, b.certain, frame)
        hit = matches(Relation((kept,), left.scope))
        scope |= hit.scope
        out += hit.branches
        rest = frame
        for h in hit.branches:
            new = {c: fresh("k") for c in frame.columns}
            found = h.frame(spark).select(*(F.col(f"`{c}`").alias(n) for c, n in new.items())).distinct()
            on = reduce(Column.__and__, (F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in new.items()), F.lit(True))
            rest = rest.join(found, on, "left_anti")
        out.append(Branch(b.vars, b.certain, rest))
    return relation(out, scope)


# --- distinct, order, slices ------------------------------------------------------------------------------------


def distinct(rel: Relation, spark: SparkSession) -> Relation:
    one = merged(rel, spark)
    new: dict[str, Column] = {}
    shapes = {v: stored(x if invertible(x) else Dyn(struct(x), kinds(x)), new) for v, x in one.vars.items()}
    frame = one.frame(spark).select(*(c.alias(n) for n, c in new.items()))
    frame = frame.distinct() if new else frame.limit(1)
    return relation([Branch(shapes, one.certain, frame)], rel.scope)


def order_keys(x) -> list[Column]:
    """Columns that sort as ORDER BY does: unbound, blank nodes, IRIs, literals, triple terms; numbers by value."""
    from loomgraph.functions.expressions import number

    if isinstance(x, Lit):
        return [col(x.ref)]
    if isinstance(x, Const):
        return []
    if isinstance(x, Node):
        return [T.lexical(x)]
    s = struct(x)
    keys = [s["k"]]
    if isinstance(x, Dyn) and T.LITERAL in kinds(x):
        keys.append(number(x).value)
    return [*keys, s["v"], s["dt"], s["lang"]]
