"""Answers over a view equal answers over the same triples materialised."""

import importlib
import pkgutil

import pytest

import loomgraph
from loomgraph.engine import Engine
from loomgraph.plans.views import View
from loomgraph.sources.graphs import Triples
from loomgraph.sources.turtle import parse_turtle

PREFIXES = "PREFIX : <urn:x:> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>\n"
DATA = (
    PREFIXES
    + """
:a :knows :b . :b :knows :c . :a :age 31 .
:s1 a rdf:Statement ; rdf:subject :a ; rdf:predicate :knows ; rdf:object :b ; :statedBy :u ; :confidence "high" .
:s2 a rdf:Statement ; rdf:subject :b ; rdf:predicate :knows ; rdf:object :c ; :statedBy :v .
"""
)
REIFICATION = "CONSTRUCT { ?t rdf:reifies <<( ?s ?p ?o )>> } WHERE { ?t rdf:subject ?s ; rdf:predicate ?p ; rdf:object ?o }"
PLAIN = "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }"
QUERIES = [
    "SELECT ?t ?s ?o WHERE { ?t rdf:reifies <<( ?s :knows ?o )>> }",
    "SELECT ?who ?c WHERE { ?t rdf:reifies <<( :a :knows ?b )>> ; :statedBy ?who OPTIONAL { ?t :confidence ?c } }",
    "SELECT ?t WHERE { ?t rdf:reifies ?tt FILTER NOT EXISTS { ?t :confidence ?c } }",
    "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p",
    "SELECT ?x ?y WHERE { ?x :knows/:knows ?y }",
    "ASK { ?t rdf:reifies <<( :c :knows ?x )>> }",
    "CONSTRUCT { ?o :known ?s } WHERE { ?t rdf:reifies <<( ?s :knows ?o )>> }",
]


@pytest.fixture(scope="module")
def engines(spark):
    graph = Triples.of(spark, parse_turtle(DATA))
    view = View.from_construct([PREFIXES + REIFICATION, PREFIXES + PLAIN])
    everything = Engine(spark, graph, view).sparql("CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", out="term")
    return Engine(spark, graph, view), Engine(spark, Triples(everything))


@pytest.mark.parametrize("text", QUERIES)
def test_view_equals_its_triples(engines, text):
    over_view, over_triples = (sorted(map(str, e.sparql(PREFIXES + text, out="lex").collect())) for e in engines)
    assert over_view == over_triples and over_view


def test_every_module_of_the_engine_imports():
    for module in pkgutil.walk_packages(loomgraph.__path__, "loomgraph."):
        importlib.import_module(module.name)
