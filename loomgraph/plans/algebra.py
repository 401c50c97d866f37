"""Algebra of queries, as small immutable trees."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace

from loomgraph.terms import Term


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Triple:
    """A triple pattern, a template triple, or a triple term with variables."""

    s: object
    p: object
    o: object


# --- paths: a predicate position may hold one of these ----------------------------------------------------------


@dataclass(frozen=True)
class Link:
    iri: Term


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Seq:
    paths: tuple


@dataclass(frozen=True)
class Alt:
    paths: tuple


@dataclass(frozen=True)
class Negated:
    forward: tuple[Term, ...]
    backward: tuple[Term, ...]


@dataclass(frozen=True)
class Opt:
    path: object


@dataclass(frozen=True)
class Closure:
    """`+`, or `*` with `zero`."""

    path: object
    zero: bool


@dataclass(frozen=True)
class PathPattern:
    s: object
    path: object
    o: object


# --- operators ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BGP:
    patterns: tuple = ()


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Filter:
    condition: object
    input: object


@dataclass(frozen=True)
class Extend:
    input: object
    var: str
    expression: object


@dataclass(frozen=True)
class Values:
    vars: tuple[str, ...]
    rows: tuple


@dataclass(frozen=True)
class Graph:
    name: object
    input: object


@dataclass(frozen=True)
class Service:
    name: object
    input: object
    silent: bool = False


@dataclass(frozen=True)
class Group:
    input: object
    keys: tuple[str, ...]
    aggregates: tuple  # of (var, Aggregate)


@dataclass(frozen=True)
class Project:
    input: object
    vars: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    input: object


@dataclass(frozen=True)
class Reduced:
    input: object


@dataclass(frozen=True)
class OrderBy:
    input: object
    keys: tuple  # of (expression, descending)


@dataclass(frozen=True)
class Slice:
    input: object
    offset: int = 0
    limit: int | None = None


# --- expressions ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Call:
    name: str  # upper case; operators by their sign; an IRI for named functions
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    expression: object = None  # None: *
    distinct: bool = False
    separator: str = " "


# --- query forms ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Select:
    pattern: object
    datasets: tuple = ()
    named: tuple = ()


@dataclass(frozen=True)
class Ask:
    pattern: object
    datasets: tuple = ()
    named: tuple = ()


@dataclass(frozen=True)
class Construct:
    template: tuple[Triple, ...]
    pattern: object
    datasets: tuple = ()
    named: tuple = ()


@dataclass(frozen=True)
class Describe:
    terms: tuple  # variables and IRIs
    pattern: object
    datasets: tuple = ()
    named: tuple = ()


@dataclass(frozen=True)
class Quad:
    """A template triple of a graph that an IRI or a variable names."""

    graph: object
    triple: Triple


@dataclass(frozen=True)
class Modify:
    delete: tuple  # triples and quads
    insert: tuple
    where: object
    into: str | None = None  # WITH
    using: tuple[str, ...] = ()
    using_named: tuple[str, ...] = ()


@dataclass(frozen=True)
class Data:
    delete: tuple
    insert: tuple


@dataclass(frozen=True)
class Admin:
    action: str  # LOAD CLEAR CREATE DROP ADD MOVE COPY
    source: str | None = None
    target: str | None = None
    silent: bool = False


@dataclass(frozen=True)
class Update:
    steps: tuple = field(default_factory=tuple)


def children(node) -> list:
    """Every algebra node, term or expression right below."""
    out = []
    for f in fields(node) if is_dataclass(node) else ():
        todo = [getattr(node, f.name)]
        while todo:
            x = todo.pop(0)
            if isinstance(x, tuple):
                todo = [*x, *todo]
            elif is_dataclass(x) and not isinstance(x, Term):
                out.append(x)
    return out


def walk(node):
    yield node
    for x in children(node):
        yield from walk(x)


def rebuilt(node, change):
    """The node with `change` applied to what is right below it."""

    def of(x):
        if isinstance(x, tuple):
            return tuple(of(y) for y in x)
        return change(x) if is_dataclass(x) and not isinstance(x, Term) else x

    return replace(node, **{f.name: of(getattr(node, f.name)) for f in fields(node)})


def variables(node) -> set[str]:
    """Names of all variables anywhere in it."""
    out = {x.name for x in walk(node) if isinstance(x, Var)}
    for x in walk(node):
        if isinstance(x, Extend):
            out.add(x.var)
        elif isinstance(x, Values | Project):
            out.update(x.vars)
        elif isinstance(x, Group):
            out.update(x.keys)
            out.update(v for v, _ in x.aggregates)
    return out


def scope(node) -> set[str]:
    """Variables that the operator's solutions may bind."""
    if isinstance(node, BGP):
        return set().union(*(variables(p) for p in node.patterns))
    if isinstance(node, Triple | PathPattern):
        return variables(node)
    if isinstance(node, Minus):
        return scope(node.left)
    if isinstance(node, Join | LeftJoin):
        return scope(node.left) | scope(node.right)
    if isinstance(node, Union):
        return set().union(*map(scope, node.parts))
    if isinstance(node, Extend):
        return scope(node.input) | {node.var}
    if isinstance(node, Values | Project):
        return set(node.vars)
    if isinstance(node, Group):
        return set(node.keys) | {v for v, _ in node.aggregates}
    if isinstance(node, Graph | Service):
        return scope(node.input) | ({node.name.name} if isinstance(node.name, Var) else set())
    return scope(node.input)
