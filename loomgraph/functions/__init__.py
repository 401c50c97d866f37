"""SPARQL expressions as column expressions."""

from loomgraph.functions.expressions import Context, condition, value

__all__ = ["Context", "condition", "value"]
