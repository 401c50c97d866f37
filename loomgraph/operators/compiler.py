"""Algebra to relations.

Patterns over a view are unfolded while they are compiled: each mapping's body is compiled over the source, its head is
matched with the pattern, and what the match leaves open becomes tests on the body's columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.functions.expressions import SOLUTION, Context, condition, text, truth, value
from loomgraph.operators.aggregate import aggregated
from loomgraph.operators.closure import closure
from loomgraph.operators.relation import (
    UNIT, Branch, Relation, copied, distinct, flagged, fresh, fused, join, left_join, left_join_by_rows, merged, minus, order_keys, relation, semi_parts, split, union, with_values,
)
from loomgraph.plans import algebra as A
from loomgraph.plans.parser import SparqlError, opened
from loomgraph.plans.paths import expand
from loomgraph.plans.views import POSITIONS, View
from loomgraph.sources.graphs import Catalog, Graph
from loomgraph.terms import ANY, Const, Dyn, Term, Tri, bound, kinds, refs, same, struct


#: Rows written in a query that are sent to every task.
INLINE = 10_000


@dataclass
class Options:
    """How expressions and views are read."""

    dedup: bool = False  # a view's triples count once each
    mint: str | None = None
    mint_name: str = "urn:loomgraph:node"
    generalized: bool = False
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    ranges: dict[str, frozenset[int]] = field(default_factory=dict)
    argument_depth: int | None = None


@dataclass(frozen=True)
class ViewGraph(Graph):
    """A view's triples over a source."""

    view: View
    catalog: Catalog
    spark: SparkSession
    options: Options

    def triples(self, predicate: Term | None = None) -> Iterator[tuple[Branch, tuple]]:
        for m in self.view.mappings:
            if predicate is not None and isinstance(m.head.p, Term) and m.head.p != predicate:
                continue
            compiler = Compiler(self.spark, self.catalog, replace(self.options, generalized=m.generalized))
            if predicate is not None and isinstance(m.head.p, A.Var) and not any(isinstance(x, A.Project | A.Group | A.Service) for x in A.walk(m.body)):
                compiler.hints = {m.head.p.name: predicate}
            body = compiler.compile(m.body)
            for b in body.branches:
                ready = self._instance(b, m)
                if ready is not None:
                    yield ready

    def _instance(self, branch: Branch, m) -> tuple[Branch, tuple] | None:
        """The branch's solutions that make a triple, and the triple's shapes."""
        out: Branch | None = branch

        def shape(x, allowed: frozenset[int]):
            nonlocal out
            x = opened(x)
            if isinstance(x, A.Triple):
                positions = (ANY,) * 3 if m.generalized else POSITIONS
                parts = [shape(p, k) for p, k in zip((x.s, x.p, x.o), positions, strict=True)]
                return Tri(*parts) if out is not None else None
            if isinstance(x, Term):
                return Const(x)
            found = branch.vars.get(x.name)
            if found is None:
                out = None
            if out is not None and x.name not in out.certain:
                out = out.where(bound, found, spark=self.spark)
            if out is not None:
                out = out.needing(x.name).where(lambda y: T.of_kind(y, allowed), found, spark=self.spark)
            return found

        positions = (ANY,) * 3 if m.generalized else POSITIONS
        shapes = tuple(shape(x, k) for x, k in zip((m.head.s, m.head.p, m.head.o), positions, strict=True))
        return None if out is None else (replace(out, vars={}, certain=frozenset()), tuple(narrowed(x, k) for x, k in zip(shapes, positions, strict=True)))


def narrowed(x, allowed: frozenset[int]):
    return Dyn(x.ref, x.kinds & allowed) if isinstance(x, Dyn) else x


def matched(branch: Branch, shapes: tuple, pattern: A.Triple, spark: SparkSession) -> Branch | None:
    """The branch's triples that the pattern matches, with the pattern's variables."""
    out: Branch | None = branch
    found: dict[str, object] = {}

    def unify(x, shape) -> None:
        nonlocal out
        if out is None:
            return
        if isinstance(x, A.Var):
            if x.name in found:
                out = out.where(same, found[x.name], shape, spark=spark)
            else:
                found[x.name] = shape
            return
        if isinstance(x, Term):
            out = out.where(same, shape, T.shape_of(x), spark=spark)
            return
        if not isinstance(shape, Tri):
            if T.TRIPLE not in kinds(shape):
                out = None
                return
            out = out.where(lambda y: T.of_kind(y, frozenset((T.TRIPLE,))), shape, spark=spark)
        for i, y in enumerate((x.s, x.p, x.o)):
            unify(y, T.piece(shape, i))

    for x, shape in zip((pattern.s, pattern.p, pattern.o), shapes, strict=True):
        unify(x, shape)
    if out is None:
        return None
    done = with_values(replace(out, vars={}, certain=frozenset()), found, spark)
    return replace(done, certain=frozenset(found))


class Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, options: Options | None = None, view: View | None = None) -> None:
        self.spark, self.catalog, self.options = spark, catalog, options or Options()
        self.graph: Graph = ViewGraph(view, catalog, spark, self.options) if view else catalog.default
        self.over_view = view is not None
        self.seed: Relation | None = None
        self.hints: dict[str, Term] = {}  # predicates that variables will be tested for later

    # --- patterns

    def pattern(self, t: A.Triple) -> Relation:
        predicate = t.p if isinstance(t.p, Term) else self.hints.get(t.p.name) if isinstance(t.p, A.Var) else None
        names = A.variables(t)
        out = relation((matched(b, shapes, t, self.spark) for b, shapes in self.graph.triples(predicate)), names)
        return distinct(out, self.spark) if self.over_view and self.options.dedup and out.branches else out

    def bgp(self, patterns: tuple) -> Relation:
        """Connected patterns first, those with fewer branches and more constants before others; patterns on one row of a
        table are one scan before it meets others."""
        found = [self.pattern(p) if isinstance(p, A.Triple) else self.path(p) for p in patterns]
        found.sort(key=lambda x: (len(x.branches) > 1, len(x.branches), len(x.scope)))
        out, todo = UNIT, []
        for rel in found:
            at, one = next(((i, y) for i, x in enumerate(todo) if (y := fused(x, rel))), (len(todo), rel))
            todo[at : at + 1] = [one]
        while todo:
            at = next((i for i, x in enumerate(todo) if x.scope & out.scope), 0)
            out = join(out, todo.pop(at), self.spark)
        return out if patterns else UNIT

    def path(self, p: A.PathPattern) -> Relation:
        if isinstance(p.path, A.Closure):
            return closure(self, p)
        seed, self.seed = self.seed, None
        try:
            return self.compile(expand(p.s, p.path, p.o))
        finally:
            self.seed = seed

    # --- expressions

    def context(self, vars_: dict) -> Context:
        o = self.options
        return Context(vars_, o.mint, o.mint_name, o.generalized, "", o.functions, o.argument_depth, o.ranges)

    def with_flags(self, rel: Relation, e) -> tuple[Relation, object]:
        """EXISTS within an expression becomes a variable that says whether the pattern has a solution."""
        found = [x for x in _exists_in(e)]
        for x in found:
            name = fresh(".x")
            out = []
            for b in rel.branches:
                for part, flag in self.exists_flags(b, x.pattern):
                    if isinstance(flag, bool):
                        flag = flag != x.negated
                    elif x.negated:
                        flag = ~flag
                    out.append(with_values(part, {name: truth(flag)}, self.spark, (name,)))
            rel = relation(out, rel.scope | {name})
            e = _replaced(e, x, A.Var(name))
        return rel, e

    def with_solution(self, rel: Relation, e) -> Relation:
        """Where BNODE is called with an argument: solutions with a mark of their own, unless they have one."""
        if not any(isinstance(x, A.Call) and x.name == "BNODE" and x.args for x in A.walk(e)) if not isinstance(e, Term) else True:
            return rel
        marked = (b if SOLUTION in b.vars else with_values(b, {SOLUTION: text(F.uuid())}, self.spark, (SOLUTION,)) for b in rel.branches)
        return relation(marked, rel.scope | {SOLUTION})

    def filter(self, rel: Relation, e) -> Relation:
        rel = self.with_solution(rel, e)
        parts = list(e.args) if isinstance(e, A.Call) and e.name == "&&" else [e]
        scope = rel.scope
        for part in sorted(parts, key=lambda p: bool(_exists_in(p))):
            if isinstance(part, A.Exists):
                rel = relation((p for b in rel.branches for p in self.exists_parts(b, part.pattern)[part.negated]), rel.scope)
                continue
            rel, part = self.with_flags(rel, part)
            names = sorted(A.variables(part) | {SOLUTION}) if not isinstance(part, Term) else []
            kept = []
            for b in rel.branches:
                there = [v for v in names if v in b.vars]
                kept.append(b.where(lambda *xs, there=there, part=part: condition(part, self.context(dict(zip(there, xs, strict=True)))), *(b.vars[v] for v in there), spark=self.spark))
                if kept[-1] is not None:
                    kept[-1] = replace(kept[-1], certain=kept[-1].certain | {v for v in _implied(part) if v in b.vars})
            rel = relation(kept, rel.scope)
        return relation((b.only(scope) for b in rel.branches), scope)

    def extend(self, rel: Relation, var: str, e) -> Relation:
        rel = self.with_solution(rel, e)
        scope = rel.scope | {var}
        rel, e = self.with_flags(rel, e)
        out = []
        for b in rel.branches:
            x = value(e, self.context(b.vars))
            sure = x is not None and (not refs(x) or isinstance(e, A.Var) and e.name in b.certain)
            out.append(with_values(b, {var: x}, self.spark, (var,) if sure else ()).only(scope))
        return relation(out, scope)

    # --- EXISTS

    def exists_parts(self, branch: Branch, pattern) -> tuple[list[Branch], list[Branch]]:
        """The branch's solutions for which the pattern has a solution, and the rest."""
        if _plain(pattern):
            return semi_parts(branch, self.nested(None).compile(pattern), self.spark)
        yes, no = [], []
        names = A.variables(pattern) & set(branch.vars)
        for part in split(branch, names, self.spark):
            used = names & set(part.vars)
            outer = distinct(relation([copied(part.only(used), self.spark)], used), self.spark)
            inner = self.nested(outer).compile(pattern)
            a, b = semi_parts(part, inner, self.spark, shared=used)
            yes += a
            no += b
        return yes, no

    def exists_flags(self, branch: Branch, pattern) -> list[tuple[Branch, Column | bool]]:
        """The branch's solutions, and whether the pattern has a solution for each: one existence join, no second copy."""
        if _plain(pattern):
            return flagged(branch, self.nested(None).compile(pattern), self.spark)
        out = []
        names = A.variables(pattern) & set(branch.vars)
        for part in split(branch, names, self.spark):
            used = names & set(part.vars)
            outer = distinct(relation([copied(part.only(used), self.spark)], used), self.spark)
            out += flagged(part, self.nested(outer).compile(pattern), self.spark, shared=used)
        return out

    def nested(self, seed: Relation | None) -> Compiler:
        out = Compiler.__new__(Compiler)
        out.__dict__.update(self.__dict__)
        out.seed = seed
        return out

    def seeded(self, rel: Relation) -> Relation:
        """Within EXISTS: joined with the outer solutions."""
        if self.seed is None:
            return rel
        outer = relation((copied(b, self.spark) for b in self.seed.branches), self.seed.scope)
        return join(outer, rel, self.spark)

    # --- operators

    def compile(self, node) -> Relation:
        do = getattr(self, f"_{type(node).__name__.lower()}", None)
        if do is None:
            raise SparqlError(f"{type(node).__name__} isn't supported here")
        return do(node)

    def _bgp(self, node: A.BGP) -> Relation:
        return self.seeded(self.bgp(node.patterns))

    def _pathpattern(self, node: A.PathPattern) -> Relation:
        return self.seeded(self.path(node))

    def _join(self, node: A.Join) -> Relation:
        return join(unmarked(self.compile(node.left)), unmarked(self.compile(node.right)), self.spark)

    def _union(self, node: A.Union) -> Relation:
        return union([self.compile(p) for p in node.parts])

    def _minus(self, node: A.Minus) -> Relation:
        return minus(self.compile(node.left), unmarked(self.compile(node.right)), self.spark)

    def _leftjoin(self, node: A.LeftJoin) -> Relation:
        left, right = self.compile(node.left), unmarked(self.compile(node.right))
        e = node.condition
        if e is not None and _exists_in(e):
            return left_join_by_rows(left, lambda own: self.filter(join(own, right, self.spark), e), self.spark)
        return left_join(left, right, None if e is None else lambda shapes: condition(e, self.context(shapes)), self.spark)

    def _filter(self, node: A.Filter) -> Relation:
        return self.filter(self.compile(node.input), node.condition)

    def _extend(self, node: A.Extend) -> Relation:
        return self.extend(self.compile(node.input), node.var, node.expression)

    def _values(self, node: A.Values) -> Relation:
        """Rows that bind the same variables make one branch, as a local relation."""
        groups: dict[tuple, list] = {}
        for row in node.rows:
            groups.setdefault(tuple(v is not None for v in row), []).append(row)
        out = []
        for there, rows in groups.items():
            names = [v for v, ok in zip(node.vars, there, strict=True) if ok]
            if not names:
                out += [Branch()] if len(rows) == 1 else [Branch(df=self.spark.range(len(rows)).select())]
                continue
            own = [[t for t in row if t is not None] for row in rows]
            if len(own) == 1:
                out.append(Branch({v: T.shape_of(t) for v, t in zip(names, own[0], strict=True)}, frozenset(names)))
                continue
            shapes, columns, types = {}, [], []
            for i, v in enumerate(names):
                name, terms = fresh("l"), [row[i] for row in own]
                dts = {t.dt if t.k == T.LITERAL else None for t in terms}
                dt = next(iter(dts)) if len(dts) == 1 else None
                plain = [T.parse_natural(t.v, dt) if dt in (T.STRING, T.INTEGER, T.BOOLEAN) else None for t in terms]
                if None not in plain:
                    shapes[v] = T.Lit(name, dt)
                    columns.append(plain)
                    types.append(f"`{name}` {T.NATURAL[dt]}")
                else:
                    shapes[v] = Dyn(name, frozenset(t.k for t in terms))
                    columns.append([(t.k, t.v, t.dt, t.lang, t.dir) for t in terms])
                    types.append(f"`{name}` {T.TERM}")
            df = self.spark.createDataFrame([tuple(r) for r in zip(*columns, strict=True)], ", ".join(types))
            if len(own) <= INLINE:
                df = F.broadcast(df)
            out.append(Branch(shapes, frozenset(names), df))
        return self.seeded(relation(out, node.vars))

    def _graph(self, node: A.Graph) -> Relation:
        def over(graph: Graph) -> Relation:
            inner = self.nested(self.seed)
            inner.graph, inner.over_view = graph, False
            return inner.compile(node.input)

        if isinstance(node.name, Term):
            found = self.catalog.named.get(node.name.v)
            return over(found) if found is not None else relation([], A.scope(node))
        name, parts = node.name.name, []
        for key, graph in self.catalog.named.items():
            bind = relation([Branch({name: Const(T.iri(key))}, frozenset((name,)))], (name,))
            parts.append(join(over(graph), bind, self.spark))
        return union(parts) if parts else relation([], A.scope(node))

    def _service(self, node: A.Service) -> Relation:
        def over(graph: Graph) -> Relation:
            inner = Compiler(self.spark, Catalog(graph, self.catalog.named, self.catalog.services), self.options)
            inner.seed = self.seed
            return inner.compile(node.input)

        if isinstance(node.name, A.Var):
            name, parts = node.name.name, []
            for key, graph in self.catalog.services.items():
                bind = relation([Branch({name: Const(T.iri(key))}, frozenset((name,)))], (name,))
                parts.append(join(over(graph), bind, self.spark))
            return union(parts) if parts else relation([], A.scope(node))
        graph = self.catalog.services.get(node.name.v)
        if graph is None:
            if node.silent:
                return self.seeded(relation([Branch()], A.scope(node)))
            raise KeyError(f"no service is named {node.name.v}")
        return over(graph)

    def _project(self, node: A.Project) -> Relation:
        rel = self.compile(node.input)
        names = set(node.vars) | (self.seed.scope if self.seed else set())
        return relation((b.only(names) for b in rel.branches), names)

    def _distinct(self, node: A.Distinct) -> Relation:
        return distinct(self.compile(node.input), self.spark)

    def _reduced(self, node: A.Reduced) -> Relation:
        return self.compile(node.input)

    def _orderby(self, node: A.OrderBy) -> Relation:
        rel = self.compile(node.input)
        scope, keys = rel.scope, []
        for e, down in node.keys:
            rel, e = self.with_flags(rel, e)
            keys.append((e, down))
        one = merged(rel, self.spark)
        columns = []
        for e, down in keys:
            x = value(e, self.context(one.vars))
            columns += [c.desc_nulls_last() if down else c.asc_nulls_first() for c in (order_keys(x) if x is not None else [])]
        if not columns:
            return relation([one.only(scope)], scope)
        return relation([replace(one, df=one.frame(self.spark).orderBy(*columns), scan=None).only(scope)], scope)

    def _slice(self, node: A.Slice) -> Relation:
        rel = self.compile(node.input)
        one = merged(rel, self.spark)
        if self.seed is not None:
            return self._slice_by_seed(one, node, rel.scope)
        df = one.frame(self.spark)
        if node.offset:
            df = df.offset(node.offset)
        if node.limit is not None:
            df = df.limit(node.limit)
        return relation([replace(one, df=df, scan=None)], rel.scope)

    def _slice_by_seed(self, one: Branch, node: A.Slice, scope) -> Relation:
        """Within EXISTS, a limit holds for each outer solution."""
        if node.limit == 0:
            return relation([], scope)
        if not node.offset:
            return relation([one], scope)
        from pyspark.sql import Window

        row = fresh("r")
        own = [struct(one.vars[v]) for v in sorted(self.seed.scope) if v in one.vars]
        window = Window.partitionBy(*own).orderBy(F.lit(1))
        df = one.frame(self.spark).withColumn(row, F.row_number().over(window)).where(F.col(row) > node.offset)
        return relation([replace(one, df=df, scan=None)], scope)

    def _group(self, node: A.Group) -> Relation:
        rel = self.compile(node.input)
        aggregates = []
        for var, a in node.aggregates:
            if a.expression is not None and _exists_in(a.expression):
                rel, e = self.with_flags(rel, a.expression)
                a = replace(a, expression=e)
            aggregates.append((var, a))
        return aggregated(self, rel, node.keys, tuple(aggregates), A.scope(node))


def unmarked(rel: Relation) -> Relation:
    """Without the mark that tells solutions apart, which joins would take for a variable of both sides."""
    if SOLUTION not in rel.scope:
        return rel
    return relation((b.only(rel.scope - {SOLUTION}) for b in rel.branches), rel.scope - {SOLUTION})


def _exists_in(e) -> list[A.Exists]:
    if isinstance(e, A.Exists):
        return [e]
    return [x for a in e.args for x in _exists_in(a)] if isinstance(e, A.Call) else []


def _replaced(e, old, new):
    if e is old:
        return new
    return replace(e, args=tuple(_replaced(a, old, new) for a in e.args)) if isinstance(e, A.Call) else e


def _implied(e) -> set[str]:
    """Variables that are bound wherever the condition holds."""
    if isinstance(e, A.Var):
        return {e.name}
    if not isinstance(e, A.Call) or e.name in ("||", "!", "COALESCE", "IF", "IN", "NOT IN") and not (e.name == "IN" and isinstance(e.args[0], A.Var)):
        return set()
    if e.name == "IN":
        return {e.args[0].name}
    if e.name == "&&" or e.name == "BOUND" or e.name in ("=", "!=", "<", ">", "<=", ">=", "SAMETERM", "CONTAINS", "STRSTARTS", "STRENDS", "REGEX", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISTRIPLE", "STR", "LANG", "STRLEN"):
        return set().union(set(), *(_implied(a) for a in e.args))
    return set()


def _plain(node) -> bool:
    """Whether evaluating the pattern by itself and joining gives what evaluating it with outer values does."""
    if isinstance(node, A.BGP | A.PathPattern | A.Values):
        return True
    if isinstance(node, A.Join):
        return _plain(node.left) and _plain(node.right)
    if isinstance(node, A.Union):
        return all(map(_plain, node.parts))
    if isinstance(node, A.Filter):
        return _plain(node.input) and not _exists_in(node.condition) and not _deep_exists(node.condition) and (A.variables(node.condition) if not isinstance(node.condition, Term) else set()) <= _sure(node.input)
    return False


def _deep_exists(e) -> bool:
    return any(isinstance(x, A.Exists) for x in A.walk(e)) if not isinstance(e, Term) else False


def _sure(node) -> set[str]:
    """Variables that every solution of a plain pattern binds."""
    if isinstance(node, A.Join):
        return _sure(node.left) | _sure(node.right)
    if isinstance(node, A.Union):
        return set.intersection(*map(_sure, node.parts))
    if isinstance(node, A.Filter):
        return _sure(node.input)
    if isinstance(node, A.Values):
        return {v for i, v in enumerate(node.vars) if all(r[i] is not None for r in node.rows)}
    return A.scope(node)

