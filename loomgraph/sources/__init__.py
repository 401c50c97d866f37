"""Where triples come from."""

from loomgraph.sources.graphs import Catalog, Graph, TableGraph, Triples, UnionGraph
from loomgraph.sources.turtle import parse_turtle, read_turtle

__all__ = ["Catalog", "Graph", "TableGraph", "Triples", "UnionGraph", "parse_turtle", "read_turtle"]
