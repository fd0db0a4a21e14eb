"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, known: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for all nodes of the edges (a, b); loops are nodes by themselves.

    known: components of other edges, which the new ones join to larger ones.

    Each round every node takes its least neighbour, and that one's, as its parent; edges are then drawn between parents,
    and those inside one are gone. So the edges of a star go in one round, and what is left shrinks fast. Nothing is
    collected; each round is a written table. Minima are taken before rows are dealt out, and both sides of each join are dealt
    out for it alone, so that Spark can split the rows of a hub.
    """
    drawn = edges.select("a", "b")
    if known is not None:
        drawn = _drawn(drawn, known)
    state = known
    for _ in range(max_rounds):
        drawn = written(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if drawn.isEmpty():
            return state if state is not None else drawn.select(F.col("a").alias("node"), F.col("b").alias("root"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
        lowest = written(drawn.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.other").alias("root")), "parents")
        above = lowest.select(F.col("node").alias("root"), F.col("root").alias("above"))
        lowest = written(lowest.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "parents")
        drawn = _drawn(drawn.where("a <> b"), lowest).where("a <> b")
        state = lowest if state is None else written(_composed(state, lowest), "roots")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _drawn(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The edges between the parents of their ends; an end without one stays."""
    for end in ("a", "b"):
        edges = edges.join(parents.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
    return edges


def _composed(state: DataFrame, parents: DataFrame) -> DataFrame:
    """node, root: the roots' parents, and the nodes that have only now come in."""
    up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
    raised = state.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return raised.unionByName(parents.join(state.select("node"), "node", "left_anti").select("node", "root"))
