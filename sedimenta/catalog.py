"""Queries of the library by name, each with the SQL that says the same."""

from sedimenta.operators import codechunks, codegraph, graph, history, incremental, loading, modules, names, neighborhood, relational, retrieval, store, texts, whole
from sedimenta.plans.registry import QUERIES, SQL
from sedimenta.streaming import maintain

MODULES = (codechunks, codegraph, graph, history, incremental, loading, modules, names, neighborhood, relational, retrieval, store, texts, whole, maintain)

__all__ = ["MODULES", "QUERIES", "SQL"]
