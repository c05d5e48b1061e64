"""Connected components of an edge table, by hooking and pointer jumping.

Each round every node hooks to its least smaller neighbour, chains are shortened to
their roots, and edges are rewritten between roots; edges inside a root go. All steps are
aggregations and joins; each round's tables are written to the shared folder, so lineage
stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import cleared, published


def _rooted(parent: DataFrame) -> DataFrame:
    """Follow ``node -> root`` until every root is final."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        parent = published(parent.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "cc-jump")
        moved = not parent.where("moved").isEmpty()
        parent = parent.select("node", "root")
        if not moved:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)`` but the roots themselves; root: the least node reachable.

    Nodes are of any ordered type. The result is a published table; the tables of the rounds are deleted.
    """
    with cleared(edges.sparkSession):
        return published(_components(edges), "components", keep=True)


def _components(edges: DataFrame) -> DataFrame:
    edges = published(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        parent = _rooted(published(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "cc-hook"))
        if labels is None:
            labels = parent
        else:
            moved = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            labels = published(labels.join(moved, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).unionByName(parent), "cc-labels")
        of = lambda end: parent.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))  # noqa: B023, E731
        edges = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = published(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return labels
