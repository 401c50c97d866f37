"""SPARQL over virtual graph views, compiled to Spark DataFrames."""

from loomgraph.engine import Engine
from loomgraph.plans.parser import SparqlError
from loomgraph.plans.views import View
from loomgraph.sources import Catalog, TableGraph, Triples, UnionGraph

__all__ = ["Catalog", "Engine", "SparqlError", "TableGraph", "Triples", "UnionGraph", "View"]
