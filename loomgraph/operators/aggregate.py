"""GROUP BY and its aggregates."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.functions.expressions import number, of_rank, value
from loomgraph.operators.relation import Branch, Relation, fresh, invertible, merged, order_keys, relation, stored
from loomgraph.terms import DECIMAL, DOUBLE, INTEGER, LITERAL, STRING, Dyn, Lit, bound, col, kinds, refs, struct

if TYPE_CHECKING:
    from loomgraph.operators.compiler import Compiler


def aggregated(c: Compiler, rel: Relation, keys: tuple[str, ...], aggregates: tuple, scope) -> Relation:
    """One row for each group.  Without keys there is one group, also of no solutions.  Within EXISTS groups are made for
    each outer solution."""
    seed = sorted(c.seed.scope) if c.seed else []
    one = merged(rel, c.spark)
    frame = one.frame(c.spark)
    new: dict[str, Column] = {}
    shapes = {}
    for v in dict.fromkeys((*keys, *seed)):
        if v in one.vars:
            x = one.vars[v]
            shapes[v] = stored(x if invertible(x) else Dyn(struct(x), kinds(x)), new, "g")
    key_columns = list(new)
    plans = []
    for var, a in aggregates:
        x = value(a.expression, c.context(one.vars)) if a.expression is not None else None
        if a.expression is None and a.distinct:
            name = fresh("d")
            new[name] = F.struct(*(struct(one.vars[v]).alias(f"v{i}") for i, v in enumerate(sorted(one.vars)))) if one.vars else F.lit(1)
            plans.append((var, a, name))
        else:
            plans.append((var, a, None if x is None else stored(_kept(x), new, "a")))
    ready = frame.select(*(e.alias(n) for n, e in new.items()))
    outputs: dict[str, Column] = {}
    results = {var: _aggregate(a, x, outputs) for var, a, x in plans}
    wanted = [e.alias(n) for n, e in outputs.items()] or [F.count(F.lit(1)).alias(fresh("n"))]
    if key_columns:
        df = ready.groupBy(*(F.col(f"`{n}`") for n in key_columns)).agg(*wanted)
    elif keys:
        df = _nonempty(ready, ready.agg(*wanted))
    else:
        df = ready.agg(*wanted)
    certain = {v for v in keys if v in one.certain} | {v for v in seed if v in one.certain} | {v for v, a in aggregates if a.name == "COUNT"}
    done = Branch({**shapes, **{v: x for v, x in results.items() if x is not None}}, frozenset(certain), df)
    if seed and not keys:
        return _with_empty_groups(c, done, results, aggregates, scope)
    return relation([_finished(done, results)], set(scope) | set(seed))


def _kept(x):
    return x if refs(x) else Dyn(struct(x), kinds(x))


def _nonempty(ready: DataFrame, df: DataFrame) -> DataFrame:
    """Keys that are never bound make one group, but only of some solutions."""
    some = ready.select(F.lit(1).alias(fresh("s"))).limit(1)
    return df.join(some, F.lit(True), "left_semi")


def _finished(branch: Branch, results: dict) -> Branch:
    """Results are expressions over the aggregates' columns; they become columns themselves."""
    new: dict[str, Column] = {}
    vars_ = dict(branch.vars)
    for v, x in results.items():
        if x is not None and not all(isinstance(r, str) for r in refs(x)):
            vars_[v] = stored(x, new)
    return Branch(vars_, branch.certain, branch.df.withColumns(new) if new else branch.df)


def _with_empty_groups(c: Compiler, done: Branch, results: dict, aggregates: tuple, scope) -> Relation:
    """The implicit group of an outer solution without inner ones: a count is 0, a sum 0, others unbound."""
    from loomgraph.operators.relation import copied, semi_parts, with_values

    made = _finished(done, results)
    inner = relation([made], set(scope) | c.seed.scope)
    out = [made]
    for b in c.seed.branches:
        _, missed = semi_parts(copied(b, c.spark), relation([copied(made, c.spark)], inner.scope), c.spark, shared=c.seed.scope)
        zero = {v: T.shape_of(T.literal("0", INTEGER)) for v, a in aggregates if a.name in ("COUNT", "SUM")}
        out += [with_values(m, zero, c.spark, tuple(zero)) for m in missed]
    return relation(out, inner.scope)


def _aggregate(a, x, out: dict[str, Column]):
    """The result's shape over columns of aggregates, which are added to `out`."""

    def add(column: Column) -> Column:
        name = fresh("r")
        out[name] = column
        return F.col(name)

    if a.name == "COUNT":
        if a.expression is None:
            return Lit(add(F.count_distinct(F.col(x)) if a.distinct else F.count(F.lit(1))), INTEGER)
        if x is None:
            return Lit(add(F.sum(F.lit(0)).cast("bigint")), INTEGER)
        if not a.distinct:
            return Lit(add(F.count(F.when(bound(x), 1))), INTEGER)
        one = col(x.ref) if isinstance(x, Lit) else col(refs(x)[0]) if invertible(x) and len(refs(x)) == 1 else struct(x)
        return Lit(add(F.count_distinct(one)), INTEGER)
    if x is None:
        return None
    if a.name in ("MIN", "MAX"):
        do, by = (F.min, F.min_by) if a.name == "MIN" else (F.max, F.max_by)
        if isinstance(x, Lit):
            return Lit(add(do(col(x.ref))), x.dt)
        keys = order_keys(x)
        order = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
        return Dyn(add(by(struct(x), F.when(bound(x), order))), kinds(x))
    if a.name == "SAMPLE":
        if isinstance(x, Lit):
            return Lit(add(F.first(col(x.ref), ignorenulls=True)), x.dt)
        return Dyn(add(F.first(struct(x), ignorenulls=True)), kinds(x))
    if a.name == "GROUP_CONCAT":
        v = T.lexical(x) if T.LITERAL in kinds(x) or T.IRI in kinds(x) else F.lit(None).cast("string")
        spelled = F.when(T.bound(x), v)
        gathered = (F.collect_set if a.distinct else F.collect_list)(spelled)
        failed = add(F.count(F.lit(1))) != add(F.count(spelled))
        return Lit(F.when(~failed, add(F.array_join(F.sort_array(gathered), a.separator))), STRING)
    return _total(a, x, add)


def _total(a, x, add):
    """SUM and AVG: one value that is no number makes the whole an error; no value at all makes 0."""
    n = number(x)
    if n is None:
        none = add(F.count(F.lit(1))) == 0
        return Lit(F.when(none, F.lit(0)).cast("bigint"), INTEGER)
    values = n.value
    failed = add(F.count(F.lit(1))) != add(F.count(values))
    count = add(F.count_distinct(values) if a.distinct else F.count(values))
    total = add((F.sum_distinct if a.distinct else F.sum)(values))
    if n.dt is None:
        rank = add(F.max(n.rank))
        whole = F.coalesce(rank, F.lit(1))
        if a.name == "SUM":
            return _guarded(of_rank(F.coalesce(total, F.lit(0.0)), whole), ~failed)
        mean = F.when(count > 0, total / count).otherwise(0.0)
        return _guarded(of_rank(mean, F.when(count > 0, F.greatest(whole, F.lit(2))).otherwise(1)), ~failed)
    if a.name == "SUM":
        zero = F.lit(0).cast(T.NATURAL[n.dt])
        return Lit(F.when(~failed, F.coalesce(total.cast(T.NATURAL[n.dt]), zero)), n.dt)
    if n.dt in (INTEGER, DECIMAL):
        mean = F.when(count > 0, (total.cast("decimal(38,6)") / count.cast("decimal(20,0)")).cast("decimal(38,18)")).otherwise(F.lit(0).cast("decimal(38,18)"))
        return Lit(F.when(~failed, mean), DECIMAL)
    return Lit(F.when(~failed, F.when(count > 0, total / count).otherwise(F.lit(0.0))), DOUBLE)


def _guarded(x: Dyn, ok: Column) -> Dyn:
    return Dyn(F.when(ok, col(x.ref)), frozenset((LITERAL,)))

