"""Connected components over links in a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, sized

#: Most links that a task brings together at a time.
AT_ONCE = 2_000_000


def _jumped(hook: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """hook (a, to) with each a's last target: targets of targets, until none has one. Paths of n links take log2(n) steps."""
    while True:
        step = hook.select(F.col("a").alias("_a"), F.col("to").alias("_to"))
        far = store(hook.join(sized(step), F.col("to") == F.col("_a"), "left").select("a", F.coalesce("_to", "to").alias("to"), F.isnotnull("_to").alias("moved")))
        moved, hook = far.where("moved").isEmpty(), far.select("a", "to")
        if moved:
            return hook


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node joined with it) with the same components as the links a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(one):
        low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
        apart = low < high
        one, two = one[apart], two[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root < np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contracted(links: DataFrame) -> DataFrame:
    """links (a, b), in each task replaced by a forest with the same components; a task holds at most AT_ONCE of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (*batches, None):
            if held and (batch is None or n + batch.num_rows > AT_ONCE):
                high, low = _forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])
                held, n = [], 0
            if batch is not None and batch.num_rows:
                held.append(batch)
                n += batch.num_rows

    return links.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b", store: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(node, component), longs: for each node of an edge the smallest node that it is joined with. An edge with a null end joins nothing.

    In each round every task replaces its edges by a forest, every node that has a smaller neighbour hooks on to the
    smallest one, paths of hooks are followed to their ends, and the edges go on between those ends. A node that doesn't
    hook either takes in another one or, its neighbours having gone to a smaller node, hooks in the next round: two rounds
    at least halve what is left, so rounds and steps grow with the logarithm. Every table is written; nothing goes to the
    driver but whether rows are left.
    """
    ends = lambda links: links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    left, hooks, nodes = store(_contracted(ends(edges))), None, None
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = both.select(F.col("a").alias("node")).distinct() if nodes is None else nodes
        hook = _jumped(store(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a")), store)
        root = sized(hook.select(F.col("a").alias("_a"), F.col("to").alias("_to")))
        for end in ("a", "b"):
            left = left.join(root, F.col(end) == F.col("_a"), "left").withColumn(end, F.coalesce("_to", end)).select("a", "b")
        left = store(_contracted(ends(left)))
        first, hooks = hooks is None, hook if hooks is None else hooks.unionAll(hook)  # a node hooks once, so this is a forest
    if hooks is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root = sized(hooks if first else _jumped(hooks, store))
    return store(nodes.join(root, F.col("node") == F.col("a"), "left").select("node", F.coalesce("to", "node").alias("component")))
