"""One group for all records tied directly or through others (problem 2).

Records and the values they share form a bipartite graph, so a value shared by n records
costs n edges, never n squared pairs. The component of the vertex with the highest degree
is peeled off by breadth-first joins of its frontier; what is left is anti-joined and
labelled by propagating the smallest record along the ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarraf.session import cut, cut_counting, drop


def _reach(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes of the components of `nodes`, by breadth-first joins over `edges` (node, tie), one table a level."""
    reached = new = nodes
    count, level = 1, 0
    while count:
        ties = edges.join(new, "node", "left_semi").select("tie").distinct()
        beyond = edges.join(ties, "tie", "left_semi").select("node").distinct().join(reached, "node", "left_anti")
        new, count = cut_counting(beyond)
        reached, level = reached.unionByName(new), level + 1
        if level % 16 == 0:  # a plan of few tables, however long the way
            reached = cut(reached)
    return reached


def _propagate(edges: DataFrame) -> DataFrame:
    """`node`, `label`: the smallest node of each component, by minimum propagation.

    A node that sees a smaller label takes it, hands it on to the node that its own label
    names, and both take the label of that label. So the trees of labels are hooked onto
    each other, and a chain of n links needs about log n rounds instead of n.
    """
    state = cut(edges.select("node").distinct().withColumn("label", F.col("node")))
    labels, moving = state, 1
    while moving:
        least = edges.join(labels, "node").groupBy("tie").agg(F.min("label").alias("label"))
        near = edges.join(least, "tie").groupBy("node").agg(F.min("label").alias("near"))
        seen = labels.join(near, "node")
        told = seen.select(F.inline(F.array(F.struct("node", "near"), F.struct(F.col("label").alias("node"), "near")))).groupBy("node").agg(F.min("near").alias("near"))
        onward = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = told.join(onward, "near").select("node", F.least("near", "far").alias("next"))
        both = labels.join(moved, "node").select("node", F.least("label", "next").alias("label"), (F.col("next") < F.col("label")).alias("_moved"))
        last, (state, moving) = state, cut_counting(both, F.col("_moved"))
        drop(last)
        labels = state.select("node", "label")
    return labels


def connected_groups(ties: DataFrame, node: str, tie: str) -> DataFrame:
    """`node`, `group_id` for every node in a group of two or more.

    `ties` has a row for each value a node holds; two nodes holding one value are linked.
    group_id is the smallest node of all that are linked directly or indirectly. Null nodes
    and null values link nobody, repeated rows count once, an empty table gives no rows, and
    other columns are ignored. Nodes and values are compared as strings.
    """
    edges = ties.select(F.col(node).cast("string").alias("node"), F.col(tie).cast("string").alias("tie")).where("node is not null and tie is not null").distinct()
    first = edges = cut(edges)
    shared = edges.groupBy("tie").agg(F.count("*").alias("n")).where("n > 1").select("tie")
    edges = cut(edges.join(shared, "tie", "left_semi"))
    drop(first)
    hub = edges.groupBy("tie").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "tie"))["tie"].alias("tie")).first()["tie"]
    if hub is None:
        return edges.select(F.col("node").alias(node), F.col("node").alias("group_id")).limit(0)
    giant = _reach(edges, cut(edges.where(F.col("tie") == hub).select("node")))
    least = giant.agg(F.min("node")).first()[0]
    rest, left = cut_counting(edges.join(giant, "node", "left_anti"))
    drop(edges)
    labels = giant.withColumn("label", F.lit(least))
    if left:
        labels = labels.unionByName(_propagate(rest))
    return labels.select(F.col("node").alias(node), F.col("label").alias("group_id"))
