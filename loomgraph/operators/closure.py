"""`+` and `*` paths, where they are allowed: in views' bodies and in services."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.operators.relation import Branch, Relation, distinct, fresh, merged, relation
from loomgraph.plans import algebra as A
from loomgraph.plans.paths import every_node
from loomgraph.terms import Dyn, Term, struct

if TYPE_CHECKING:
    from loomgraph.operators.compiler import Compiler


def closure(c: Compiler, p: A.PathPattern) -> Relation:
    """Reachable pairs, each once.  Rounds double nothing and revisit nothing: only pairs found in the last round are
    extended by one step, and lineage is cut after each, so cycles end and long chains stay cheap to plan."""
    path: A.Closure = p.path
    a, b = A.Var(fresh(".f")), A.Var(fresh(".g"))
    steps = distinct(c.path(A.PathPattern(a, path.path, b)) if not isinstance(path.path, A.Link) else c.bgp((A.Triple(a, path.path.iri, b),)), c.spark)
    one = merged(steps, c.spark)
    edges = cut(one.frame(c.spark).select(struct(one.vars[a.name]).cast(T.TERM).alias("a"), struct(one.vars[b.name]).cast(T.TERM).alias("b")))
    start = edges
    back = isinstance(p.o, Term) and not isinstance(p.s, Term)  # from the end that is known
    if back:
        start = edges = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    end = p.o if back else p.s
    if isinstance(end, Term):
        start = edges.where(T.same(Dyn(F.col("a")), T.shape_of(end)))
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    found = last = cut(start)
    while True:
        longer = last.join(step, "b").select("a", F.col("c").alias("b")).distinct()
        last = cut(longer.join(found, ["a", "b"], "left_anti"))
        if last.isEmpty():
            break
        found = cut(found.unionByName(last))
    x, y = fresh("p"), fresh("p")
    pairs = relation([Branch({a.name: Dyn(x), b.name: Dyn(y)}, frozenset((a.name, b.name)), found.select(F.col("a").alias(y if back else x), F.col("b").alias(x if back else y)))], (a.name, b.name))
    if path.zero:
        if isinstance(p.s, A.Var) and isinstance(p.o, A.Var):
            same = c.compile(every_node(a, b))
        else:
            end = p.s if isinstance(p.s, Term) else p.o
            same = relation([Branch({a.name: T.shape_of(end), b.name: T.shape_of(end)}, frozenset((a.name, b.name)))], (a.name, b.name))
        pairs = distinct(relation((*pairs.branches, *same.branches), pairs.scope), c.spark)
    return _between(c, pairs, a.name, b.name, p)


def _between(c: Compiler, pairs: Relation, a: str, b: str, p: A.PathPattern) -> Relation:
    """The pairs under the pattern's own ends."""
    out = []
    for branch in pairs.branches:
        vars_, tests = {}, []
        for name, end in ((a, p.s), (b, p.o)):
            x = branch.vars[name]
            if isinstance(end, A.Var):
                if end.name in vars_:
                    tests.append((vars_[end.name], x))
                vars_.setdefault(end.name, x)
            else:
                tests.append((x, T.shape_of(end)))
        for left, right in tests:
            branch = branch and branch.where(T.same, left, right, spark=c.spark)
        if branch is not None:
            out.append(Branch(vars_, frozenset(vars_), branch.df, branch.scan))
    names = {e.name for e in (p.s, p.o) if isinstance(e, A.Var)}
    rel = relation(out, names)
    return rel if names else distinct(rel, c.spark) if out else rel


def cut(df):
    """The rows in the folder that spark.checkpoint.dir names.  Only where it is unset and the session runs in this one
    process, as in tests, in a new one; on a cluster an unset folder is an error."""
    import tempfile

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        if folder is None:
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()
