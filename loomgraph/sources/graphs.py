"""Graphs that patterns are matched against: a table of triples, ordinary tables seen as triples, and unions of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.operators.relation import Branch, Scan, Table, fresh
from loomgraph.terms import Const, Dyn, Key, Lit, Node, Term

SCHEMA = f"s {T.TERM}, p {T.TERM}, o {T.TERM}"


class Graph:
    """A set of triples."""

    def triples(self, predicate: Term | None = None) -> Iterator[tuple[Branch, tuple]]:
        """Branches with the shapes of subject, predicate and object; those that can't have `predicate` may be left out."""
        raise NotImplementedError

    def frame(self, spark: SparkSession) -> DataFrame:
        """All triples, as columns s, p, o of term structs."""
        parts = [b.frame(spark).select(*(T.struct(x).cast(T.TERM).alias(n) for n, x in zip("spo", shapes, strict=True))) for b, shapes in self.triples()]
        return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], SCHEMA)


@dataclass(frozen=True)
class Triples(Graph):
    """A DataFrame of columns s, p, o (term structs), one row for each triple.  `generalized` lets any term stand anywhere."""

    df: DataFrame
    generalized: bool = False

    @staticmethod
    def of(spark: SparkSession, triples: Iterable[tuple[Term, Term, Term]]) -> Triples:
        """From Python terms; repeated triples count once."""
        rows = [tuple((t.k, t.v, t.dt, t.lang, t.dir) for t in row) for row in dict.fromkeys(triples)]
        return Triples(spark.createDataFrame(rows, SCHEMA))

    def triples(self, predicate: Term | None = None) -> Iterator[tuple[Branch, tuple]]:
        names = [fresh(x) for x in "spo"]
        df = self.df.select(*(F.col(c).cast(T.TERM).alias(n) for c, n in zip("spo", names, strict=True)))
        allowed = (T.ANY, T.ANY, T.ANY) if self.generalized else (T.SUBJECTS, T.PREDICATES, T.ANY)
        yield Branch({}, frozenset(), df), tuple(Dyn(n, k) for n, k in zip(names, allowed, strict=True))

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.df.select("s", "p", "o")


@dataclass(frozen=True)
class Property:
    """A predicate of a table's rows; the object is a column as a literal, a template as an IRI, or a constant."""

    predicate: Term
    column: str | None = None
    template: str | None = None
    constant: Term | None = None
    datatype: str | None = None


#: Datatypes of literals by the column's Spark type.
DATATYPES = {"string": T.STRING, "boolean": T.BOOLEAN, "bigint": T.INTEGER, "int": T.INTEGER, "smallint": T.INTEGER, "tinyint": T.INTEGER, "double": T.DOUBLE, "float": T.DOUBLE, "timestamp_ntz": T.DATETIME, "timestamp": T.DATETIME}


@dataclass(frozen=True)
class TableGraph(Graph):
    """A table whose rows are subjects.

    `subject` is an IRI template such as ``urn:t:order/{o_orderkey}``.  With `unique`, no two rows share the template's
    columns, and patterns on one subject are read in one scan; otherwise each property's triples are made distinct.
    Rows with a NULL in a used column give no triple.
    """

    name: str
    df: DataFrame
    subject: str
    properties: tuple[Property, ...]
    unique: bool = True

    def _template(self, text: str, scan: Scan, types: dict[str, str]) -> Node:
        parts = [p for p in re.split(r"(\{\w+\})", text) if p]
        return Node(T.IRI, tuple(Key(scan.ref(p[1:-1]), types[p[1:-1]]) if p[0] == "{" else p for p in parts))

    @property
    def key(self) -> tuple[str, ...]:
        return tuple(re.findall(r"\{(\w+)\}", self.subject))

    def triples(self, predicate: Term | None = None) -> Iterator[tuple[Branch, tuple]]:
        table = Table(self.name, self.df, self.key, self.unique)
        types = table.types

        def object_of(p: Property, scan: Scan):
            if p.constant is not None:
                return T.shape_of(p.constant)
            if p.template is not None:
                return self._template(p.template, scan, types)
            return Lit(scan.ref(p.column), p.datatype or DATATYPES[types[p.column]])

        if predicate is None and len(self.properties) > 1:
            yield self._spread(table, types, object_of)
            return
        for p in self.properties:
            if predicate is not None and p.predicate != predicate:
                continue
            scan = Scan(table, fresh("t"))
            s, o = self._template(self.subject, scan, types), object_of(p, scan)
            branch = Branch({}, frozenset(), None, scan)
            branch = branch.where(lambda *xs: reduce(lambda a, b: a & b, map(T.bound, xs)), s, o)
            if not self.unique:
                columns = list(dict.fromkeys(r for x in (s, o) for r in T.refs(x)))
                branch = Branch({}, frozenset(), branch.frame(self.df.sparkSession).select(*(f"`{c}`" for c in columns)).distinct())
            yield branch, (s, Const(p.predicate), o)

    def _spread(self, table: Table, types: dict[str, str], object_of: Callable) -> tuple[Branch, tuple]:
        """All properties in one scan: a row stands once for each that it has."""

        def pairs(ref: Callable[[str], str]) -> Column:
            scan = Scan(table, ref("")[:-2])
            made = []
            for p in self.properties:
                o = object_of(p, scan)
                pair = F.struct(T.struct(Const(p.predicate)).cast(T.TERM).alias("p"), T.struct(o).cast(T.TERM).alias("o"))
                made.append(F.when(T.bound(o), pair) if T.refs(o) else pair)
            return F.array_compact(F.array(*made))

        scan = Scan(table, fresh("t"), spread=pairs)
        s = self._template(self.subject, scan, types)
        found = frozenset().union(*(T.kinds(object_of(p, scan)) for p in self.properties))
        p, o = Dyn(scan.ref("~p"), frozenset((T.IRI,))), Dyn(scan.ref("~o"), found)
        branch = Branch({}, frozenset(), None, scan).where(T.bound, s)
        if not self.unique:
            branch = Branch({}, frozenset(), branch.frame(self.df.sparkSession).select(*(f"`{c}`" for c in (*T.refs(s), p.ref, o.ref))).distinct())
        return branch, (s, p, o)


@dataclass(frozen=True)
class UnionGraph(Graph):
    """Several graphs.  They must have no triple in common, which isn't checked: where they may, merge them with
    `distinct_union`."""

    parts: tuple[Graph, ...]

    def triples(self, predicate: Term | None = None) -> Iterator[tuple[Branch, tuple]]:
        for g in self.parts:
            yield from g.triples(predicate)


def distinct_union(spark: SparkSession, *graphs: Graph) -> Triples:
    """The merge of graphs that may share triples, each of which counts once."""
    return Triples(reduce(DataFrame.union, (g.frame(spark) for g in graphs)).distinct())


@dataclass
class Catalog:
    """The graphs that a query can name: the default one, named ones, and the services that SERVICE reaches."""

    default: Graph
    named: dict[str, Graph] = field(default_factory=dict)
    services: dict[str, Graph] = field(default_factory=dict)

    def dataset(self, names: tuple[str, ...]) -> Graph:
        """What FROM asks for: the merge of the named graphs, a set of triples."""
        missing = [n for n in names if n not in self.named]
        if missing:
            raise KeyError(f"no graph is named {missing[0]}")
        if len(names) == 1:
            return self.named[names[0]]
        return distinct_union(SparkSession.getActiveSession(), *(self.named[n] for n in names))
