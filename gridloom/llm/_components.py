"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.llm._work import release
from gridloom.operators.graph import connected


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable."""
    found = connected(edges)
    release(edges.sparkSession)
    return found
