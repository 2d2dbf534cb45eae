"""Connected components over edges in a DataFrame, with tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tilewise.operators import links

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge the smallest node that it is joined with, in a number of rounds that grows with the logarithm."""
    return links.components(edges, a, b, lambda df: stored(df, "links"))
