"""The engine: queries and updates over a view or a source, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.operators.closure import cut
from loomgraph.operators.compiler import Compiler, Options
from loomgraph.operators.relation import Branch, Relation, fresh, merged
from loomgraph.plans import algebra as A
from loomgraph.plans.parser import SparqlError, opened, parse_query, parse_update
from loomgraph.plans.views import POSITIONS, View, check_user_query
from loomgraph.sources.graphs import SCHEMA, Catalog, Graph, Triples
from loomgraph.terms import Const, Dyn, Lit, Node, Term, Tri, bound, col, kinds, refs, struct

#: Every column of a result: as a term struct, as text, or as the natural Spark type where one is known.
OUTPUTS = ("term", "lex", "native")


class Engine:
    """Answers SPARQL over `view`, or over the source itself without one.

    `source` is a graph or a catalog of graphs.  `dedup` counts a view's triples once each; `generalized` lets any term
    stand in any position of triple terms; `mint` says what constructed nodes become ("literal", "iri" or, by default, blank
    nodes) and `mint_name` the datatype or IRI prefix that they get.  `functions` maps IRIs to functions over term-struct
    columns, and `ranges` says which kinds of terms such a function may give, where that is not any.  `rewrites` are applied to a query's pattern before it is compiled.
    """

    def __init__(
        self, spark: SparkSession, source: Graph | Catalog, view: View | None = None, *, dedup: bool = False, generalized: bool = False, mint: str | None = None,
        mint_name: str = "urn:loomgraph:node", argument_depth: int | None = None, functions: dict[str, Callable[..., Column]] | None = None, rewrites: Iterable[Callable] = (),
        ranges: dict[str, Iterable[int]] | None = None,
    ) -> None:
        if argument_depth is not None and (not isinstance(argument_depth, int) or isinstance(argument_depth, bool) or argument_depth < 0):
            raise ValueError("argument_depth must be a non-negative integer")
        if mint not in (None, "literal", "iri"):
            raise ValueError("mint must be literal or iri")
        self.spark, self.view, self.rewrites = spark, view, tuple(rewrites)
        self.catalog = source if isinstance(source, Catalog) else Catalog(source)
        self.options = Options(dedup, mint, mint_name, generalized, functions or {}, {f: frozenset(k) for f, k in (ranges or {}).items()}, argument_depth)

    # --- planning

    def plan(self, text: str):
        """The query's algebra, checked and with the engine's rewrites applied."""
        query = parse_query(text)
        if self.view:
            check_user_query(query.pattern)
        return replace(query, pattern=reduce(lambda q, f: f(q), self.rewrites, query.pattern))

    def rewrite(self, text: str) -> str:
        """The query over the source that has the solutions which `text` has over the view, as SPARQL text.  Constructed
        nodes stay calls of the built-in function.  Nothing is run."""
        from loomgraph.plans.spell import spelled
        from loomgraph.plans.unfold import unfolded

        query = self.plan(text)
        return spelled(unfolded(query, self.view, self.options.dedup, self.options.generalized) if self.view else query)

    def compile(self, node, catalog: Catalog | None = None) -> Relation:
        return Compiler(self.spark, catalog or self.catalog, self.options, self.view).compile(node)

    # --- queries

    def sparql(self, text: str, out: str = "native") -> DataFrame:
        """SELECT: a column for each variable, in the order of the projection.  ASK: one boolean column, `result`.
        CONSTRUCT and DESCRIBE: columns s, p, o, without repeats.  Nothing is run yet, but for `+` and `*` paths in a view's
        body or over the source, whose rounds are run while the query is compiled, and the counts of a join's rows by key
        where large tables meet on no unique key."""
        if out not in OUTPUTS:
            raise ValueError(f"out must be one of {', '.join(OUTPUTS)}")
        query = self.plan(text)
        catalog = self.catalog
        if query.datasets or query.named:
            named = {n: self.catalog.named[n] for n in query.named} or self.catalog.named
            catalog = Catalog(self.catalog.dataset(query.datasets) if query.datasets else self.catalog.default, named, self.catalog.services)
        if isinstance(query, A.Ask):
            one = merged(self.compile(query.pattern, catalog), self.spark, ())
            return one.frame(self.spark).limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
        if isinstance(query, A.Construct):
            return self._outputs(self._instances(query.template, self.compile(query.pattern, catalog)), out)
        if isinstance(query, A.Describe):
            return self._outputs(self._described(query, catalog), out)
        rel = self.compile(query.pattern, catalog)
        one = merged(rel, self.spark)
        names = _projection(query.pattern)
        used = {r for v in names if v in one.vars for r in refs(one.vars[v])}
        return one.select(self.spark, [_output(one.vars.get(v), out).alias(v) for v in names], used)

    def _outputs(self, triples: DataFrame, out: str) -> DataFrame:
        if out == "term":
            return triples
        return triples.select(*(F.col(c)["v"].alias(c) for c in "spo"))

    def _instances(self, template: tuple[A.Triple, ...], rel: Relation) -> DataFrame:
        """Template triples of each solution, without ill-formed ones and repeats, as columns s, p, o."""
        frames = []
        for b in rel.branches:
            names = set().union(*(A.variables(t) for t in template)) - set(b.vars)
            own = {v for v in names if v.startswith(".")}  # blank nodes: one for each solution
            df, vars_ = b.frame(self.spark), dict(b.vars)
            if own:
                row = fresh("n")
                df = df.withColumn(row, F.uuid())
                vars_ |= {v: Node(T.BLANK, (v.replace(".", "b") + "-", T.Key(row, "string"))) for v in own}
            made = [x for t in template if (x := self._instance(t, vars_)) is not None]
            if made:
                all_of = df.select(F.explode(F.array_compact(F.array(*made))).alias("t"))
                frames.append(all_of.select(*(F.col("t")[c].alias(c) for c in "spo")))
        return reduce(DataFrame.union, frames).distinct() if frames else self.spark.createDataFrame([], SCHEMA)

    def _instance(self, t: A.Triple, vars_: dict) -> Column | None:
        tests: list[Column] = []

        def shape(x, allowed):
            x = opened(x)
            if isinstance(x, A.Triple):
                parts = [shape(p, k) for p, k in zip((x.s, x.p, x.o), POSITIONS, strict=True)]
                return None if None in parts else Tri(*parts)
            found = Const(x) if isinstance(x, Term) else vars_.get(x.name)
            if found is None:
                return None
            fits = T.of_kind(found, T.ANY if self.options.generalized else allowed)
            if fits is False:
                return None
            if refs(found):
                tests.append(bound(found))
            if isinstance(fits, Column):
                tests.append(fits)
            return found

        parts = [shape(x, k) for x, k in zip((t.s, t.p, t.o), POSITIONS, strict=True)]
        if None in parts:
            return None
        made = F.struct(*(struct(x).cast(T.TERM).alias(c) for x, c in zip(parts, "spo", strict=True)))
        return F.when(reduce(Column.__and__, tests), made) if tests else made

    def _described(self, query: A.Describe, catalog: Catalog) -> DataFrame:
        """The source's triples about what the query selects over the view."""
        found = []
        fixed = [t for t in query.terms if isinstance(t, Term)]
        names = [t.name for t in query.terms if isinstance(t, A.Var)]
        if fixed:
            found.append(self.spark.createDataFrame([((t.k, t.v, t.dt, t.lang, t.dir),) for t in fixed], f"r {T.TERM}"))
        if names:
            for b in self.compile(query.pattern, catalog).branches:
                found += [b.frame(self.spark).select(struct(b.vars[v]).cast(T.TERM).alias("r")) for v in names if v in b.vars]
        source = catalog.default.frame(self.spark)
        if not found:
            return source.limit(0)
        resources = reduce(DataFrame.union, found).where("r is not null").distinct()
        return source.join(resources, F.col("s") == F.col("r"), "left_semi")

    # --- updates

    def update(self, text: str) -> Catalog:
        """The catalog after the update; steps apply one after the other, and the source's frames themselves are not touched.
        Only WHERE reads the view.  What a step leaves is saved before the next one reads it."""
        catalog = self.catalog
        for number, step in enumerate(parse_update(text).steps):
            if number and isinstance(catalog.default, Triples) and catalog.default is not self.catalog.default:
                catalog = replace(catalog, default=replace(catalog.default, df=cut(catalog.default.df)))
            catalog = self._step(step, catalog)
        return catalog

    def _step(self, step, catalog: Catalog) -> Catalog:
        if isinstance(step, A.Admin):
            return self._admin(step, catalog)
        rel, into = Relation((Branch(),), frozenset()), "DEFAULT"
        if isinstance(step, A.Modify):
            if self.view:
                check_user_query(step.where)
            into = step.into or "DEFAULT"
            default = catalog.default if into == "DEFAULT" else catalog.named.get(into) or self._nothing()
            if step.using or step.using_named:
                default = catalog.dataset(step.using) if step.using else self._nothing()
            named = {n: catalog.named[n] for n in step.using_named} if step.using or step.using_named else catalog.named
            rel = self.compile(step.where, Catalog(default, named, catalog.services))
        out = replace(catalog, named=dict(catalog.named))
        for put, quads in ((False, step.delete), (True, step.insert)):
            for name, triples in self._by_graph(quads, rel, into).items():
                old = out.default if name == "DEFAULT" else out.named.get(name)
                if old is None:
                    if not put:
                        continue
                    old = self._nothing()
                frame = old.frame(self.spark)
                if put:
                    frame = frame.union(triples).distinct()
                else:
                    gone = triples.select(*(F.col(c).alias(f"d{c}") for c in "spo"))
                    frame = frame.join(gone, reduce(Column.__and__, (F.col(c) == F.col(f"d{c}") for c in "spo")), "left_anti")
                new = Triples(frame, self.options.generalized)
                if name == "DEFAULT":
                    out.default = new
                else:
                    out.named[name] = new
        return out

    def _nothing(self) -> Triples:
        return Triples(self.spark.createDataFrame([], SCHEMA))

    def _by_graph(self, quads: tuple, rel: Relation, into: str) -> dict[str, DataFrame]:
        """Template triples of each solution, by the graph that they belong to.  The graphs that a variable names are found
        by a query of their own: they are as few as a catalog's graphs."""
        parts: dict[object, list[A.Triple]] = {}
        for q in quads:
            graph, t = (q.graph, q.triple) if isinstance(q, A.Quad) else (T.iri(into) if into != "DEFAULT" else None, q)
            parts.setdefault(graph, []).append(t)
        out: dict[str, list[DataFrame]] = {}
        for graph, template in parts.items():
            if not isinstance(graph, A.Var):
                out.setdefault("DEFAULT" if graph is None else graph.v, []).append(self._instances(tuple(template), rel))
                continue
            at = [b for b in rel.branches if graph.name in b.vars]
            names = [b.frame(self.spark).select(struct(b.vars[graph.name]).cast(T.TERM).alias("g")).where(F.col("g")["k"] == T.IRI).select(F.col("g")["v"].alias("v")) for b in at]
            for row in reduce(DataFrame.union, names).distinct().collect() if names else ():
                own = [b.where(T.same, b.vars[graph.name], T.shape_of(T.iri(row["v"])), spark=self.spark) for b in at]
                out.setdefault(row["v"], []).append(self._instances(tuple(template), Relation(tuple(b for b in own if b), rel.scope)))
        return {name: reduce(DataFrame.union, frames) for name, frames in out.items()}

    def _admin(self, step: A.Admin, catalog: Catalog) -> Catalog:
        empty = self._nothing
        named = dict(catalog.named)

        def graph(name: str) -> Graph:
            if name == "DEFAULT":
                return catalog.default
            if name not in named:
                if step.silent:
                    return empty()
                raise KeyError(f"no graph is named {name}")
            return named[name]

        def put(name: str | None, g: Graph) -> Catalog:
            if name in (None, "DEFAULT"):
                return replace(catalog, default=g, named=named)
            return replace(catalog, named={**named, name: g})

        def merged_with(name: str | None, g: Graph) -> Graph:
            old = catalog.default if name in (None, "DEFAULT") else named.get(name)
            return g if old is None else Triples(old.frame(self.spark).union(g.frame(self.spark)).distinct())

        if step.action == "LOAD":
            from loomgraph.sources.turtle import read_turtle

            path = step.source
            loaded = Triples(self.spark.read.parquet(path)) if path.endswith(".parquet") else read_turtle(self.spark, path)
            return put(step.target, merged_with(step.target, loaded))
        if step.action in ("CLEAR", "DROP"):
            drop = step.action == "DROP"
            if step.target == "DEFAULT":
                return replace(catalog, default=empty())
            if step.target in ("NAMED", "ALL"):
                left = {} if drop else {n: empty() for n in named}
                return replace(catalog, named=left, **({"default": empty()} if step.target == "ALL" else {}))
            graph(step.target)
            named.pop(step.target, None)
            return replace(catalog, named=named if drop else {**named, step.target: empty()})
        if step.action == "CREATE":
            if step.target in named and not step.silent:
                raise KeyError(f"a graph is named {step.target} already")
            return replace(catalog, named={step.target: empty(), **named})
        moved = graph(step.source)
        if step.source == step.target:
            return catalog
        done = put(step.target, merged_with(step.target, moved) if step.action == "ADD" else moved)
        if step.action == "MOVE":
            if step.source == "DEFAULT":
                return replace(done, default=empty())
            done.named.pop(step.source, None)
        return done


def _projection(node) -> tuple[str, ...]:
    while not isinstance(node, A.Project):
        if not isinstance(node, A.Distinct | A.Reduced | A.Slice | A.OrderBy | A.Filter):
            raise SparqlError("a SELECT has no projection")
        node = node.input
    return node.vars


def _output(x, out: str) -> Column:
    if x is None:
        return F.lit(None).cast(T.TERM if out == "term" else "string")
    if out == "term":
        return struct(x)
    if out == "native":
        if isinstance(x, Lit):
            return col(x.ref)
        if isinstance(x, Const) and kinds(x) == {T.LITERAL}:
            from loomgraph.functions.expressions import natural

            y = natural(x)
            if isinstance(y, Lit):
                return col(y.ref)
        if isinstance(x, Dyn):
            return col(x.ref)["v"]
    return F.when(bound(x), T.lexical(x)) if refs(x) else T.lexical(x)
