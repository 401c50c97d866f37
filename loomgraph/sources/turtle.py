"""A small reader of Turtle and N-Triples, for fixtures and LOAD."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomgraph.plans import algebra as A
from loomgraph.plans.parser import Parser
from loomgraph.sources.graphs import Triples
from loomgraph.terms import Term, blank, triple


def parse_turtle(text: str) -> list[tuple[Term, Term, Term]]:
    """The triples of a document; blank nodes get labels of their own within it."""
    import re

    text = re.sub(r"(?m)^\s*@(prefix|base)\b([^\n]*?)\.\s*(?=$|#)", r"\1\2", text)
    parser, found = Parser(text), []
    while True:
        parser.prologue()
        if parser.peek()[0] == "end":
            break
        parser.triples(found)
        parser.needs(".")
    labels = {v.name: k[2:] for k, v in parser.blanks.items()}

    def term(x) -> Term:
        if isinstance(x, A.Var):
            return blank(labels.get(x.name, x.name.replace(".", "anon-")))
        return triple(*map(term, (x.s, x.p, x.o))) if isinstance(x, A.Triple) else x

    return [tuple(map(term, (t.s, t.p, t.o))) for t in found]


def read_turtle(spark: SparkSession, path: str) -> Triples:
    """A Turtle or N-Triples file in any store that Spark reads; for files that fit the driver."""
    text = spark.read.text(path, wholetext=True).first()
    return Triples.of(spark, parse_turtle(text[0] if text else ""))
