"""Connected components of a table of links, by contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import discard, materialise


def roots(labels: DataFrame) -> DataFrame:
    """node, component from labels (node, component), a written table that is used up: what a node's label leads to, by pointer jumping."""
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above")).hint("merge")
        new = materialise(labels.join(up, "component").select("node", F.col("above").alias("component"), (F.col("above") != F.col("component")).alias("moved")), "labels")
        discard(labels)
        labels = new.select("node", "component")
        labels.written_to = new.written_to
        if not new.filter("moved").limit(1).count():
            return labels


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of links (a, b); direction doesn't matter.

    Each round takes for a node the smallest of itself and its neighbours, follows these to their ends, and puts the ends
    in the place of the nodes they come from. Ends are half of what is left at most, and links within one place go, so
    that all rounds together read links little more than once. Rows with a null are left out.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialise(links.distinct(), "edges")
    found = None
    while True:
        near = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("component")), F.struct(F.col("b").alias("node"), F.col("a").alias("component")))).alias("x")).select("x.*")
        labels = roots(materialise(near.groupBy("node").agg(F.min("component").alias("component")), "labels"))
        first, second = (labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")).hint("merge") for c in ("a", "b"))
        left = edges.join(first, "a").join(second, "b").filter("of_a <> of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()
        old, edges = edges, materialise(left, "edges")
        discard(old)
        found = labels if found is None else replaced(found, labels)
        if not edges.limit(1).count():
            discard(edges)
            return found


def replaced(component: DataFrame, above: DataFrame) -> DataFrame:
    """component (node, component) with the components that are nodes of above (node, component) replaced; both written tables, used up.

    Nodes that only above has are added.
    """
    up = above.select(F.col("node").alias("component"), F.col("component").alias("above")).hint("merge")
    old = component.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    new = materialise(old.union(above.join(component.select("node").hint("merge"), "node", "left_anti")), "labels")
    discard(component, above)
    return new
