"""Connected components of a graph given as an edge table, by repeated contraction.

Every round gives each node its least neighbour as parent, shortens the paths twice, and moves the edges to the
parents; edges inside one parent vanish. Each round's tables are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node of its component.

    Loops and repeated edges do no harm; null ends are ignored. No edges: an empty table.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parent")
        parent = least
        for _ in range(2):
            up = least.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        move = lambda df, c: df.join(parent.select(F.col("a").alias(c), "p"), c, "left").withColumn(c, F.coalesce("p", c)).drop("p")  # noqa: B023, E731
        old_labels, old_edges = labels, edges
        labels = materialize(move(labels, "label").select("node", "label"), "labels")
        edges = materialize(move(move(edges, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(old_labels, old_edges, least)
    release(edges)
    return labels
