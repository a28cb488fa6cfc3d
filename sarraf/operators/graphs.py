"""Bounded walks over links: reach, simple cycles, components of candidate links, cluster sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarraf.session import cut, cut_counting, drop


def chain(links: DataFrame, node: str, parent: str, most: int = 30) -> DataFrame:
    """`node`, `depth`, `looped`: links walked upwards until a root, the own node again, or `most` steps; of several rows of a node the one with the smallest parent counts."""
    index = cut(links.select(F.col(node).alias("_at"), F.col(parent).alias("_up")).where("_at is not null").groupBy("_at").agg(F.min("_up").alias("_up")))
    walk = index.select(F.col("_at").alias("node"), F.col("_up").alias("_at"), F.lit(0).alias("depth")).where("_at is not null")
    ended = [index.where("_up is null").select(F.col("_at").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("looped"))]
    for step in range(1, most + 1):
        walk = cut(walk)
        if walk.isEmpty():
            break
        met = F.col("_at") == F.col("node")
        ended.append(walk.where(met | F.lit(step == most)).select("node", F.lit(step).alias("depth"), met.alias("looped")))
        on = walk.where(~met & F.lit(step < most)).join(index, "_at", "left")
        ended.append(on.where("_up is null").select("node", F.lit(step).alias("depth"), F.lit(False).alias("looped")))
        walk = on.where("_up is not null").select("node", F.col("_up").alias("_at"), F.lit(step).alias("depth"))
    return reduce(DataFrame.unionByName, ended)


def reach(links: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """`start`, `end`, `steps`: every pair joined by a path of at most `most` links, with the fewest."""
    edges = cut(links.select(F.col(start).alias("a"), F.col(end).alias("b")).where("a is not null and b is not null").distinct())
    known = new = edges.withColumn("steps", F.lit(1))
    for step in range(2, most + 1):
        more = new.select("a", F.col("b").alias("_b")).join(edges.select(F.col("a").alias("_b"), "b"), "_b").select("a", "b").distinct()
        new = cut(more.join(known, ["a", "b"], "left_anti").withColumn("steps", F.lit(step)))
        if new.isEmpty():
            break
        last, known = known, cut(known.unionByName(new))
        drop(last)
    return known.select(F.col("a").alias("start"), F.col("b").alias("end"), "steps")


def subtree(links: DataFrame, node: str, parent: str, top, most: int = 30) -> DataFrame:
    """`node`: `top` and all nodes below it, level by level, at most `most` levels; only what is reached is joined."""
    edges = links.select(F.col(node).alias("node"), F.col(parent).alias("_up")).where("node is not null and _up is not null")
    found = new = cut(links.sparkSession.range(1).select(F.lit(top).alias("node")))
    for _ in range(most):
        below = edges.join(new.select(F.col("node").alias("_up")), "_up", "left_semi").select("node").distinct()
        new = cut(below.join(found, "node", "left_anti"))
        if new.isEmpty():
            break
        found = cut(found.unionByName(new))
    return found


def simple_cycles(links: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """`path`: every simple cycle of 2 to `most` links, turned so that its smallest node is first."""
    edges = cut(links.select(F.col(start).alias("a"), F.col(end).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    walks = edges.where("a < b").select(F.array("a", "b").alias("path"))  # the smallest node leads, so all others are greater
    closed = []
    for _ in range(2, most + 1):
        onward = walks.withColumn("_at", F.element_at("path", -1)).join(edges.select(F.col("a").alias("_at"), "b"), "_at")
        closed.append(onward.where(F.col("b") == F.col("path")[0]).select("path"))
        walks = cut(onward.where((F.col("b") > F.col("path")[0]) & ~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path")))
        if walks.isEmpty():
            break
    return reduce(DataFrame.unionByName, closed)


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `component`: the smallest node joined to it by the pairs. For candidate links; rounds grow with the longest chain's logarithm."""
    edges = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    labels = state
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_n"))
        both = labels.join(seen, "node")
        told = both.select(F.inline(F.array(F.struct("node", "_n"), F.struct(F.col("component").alias("node"), "_n")))).groupBy("node").agg(F.min("_n").alias("_n"))
        onward = labels.select(F.col("node").alias("_n"), F.col("component").alias("_f"))
        moved = told.join(onward, "_n", "left").select("node", F.least("_n", "_f").alias("_n"))
        last, (state, moving) = state, cut_counting(labels.join(moved, "node").select("node", "component", "_n"), F.col("_n") < F.col("component"))
        drop(last)
        labels = state.select("node", F.least("component", "_n").alias("component"))
        if not moving:
            return labels


def cluster_sizes(ties: DataFrame, node: str, value: str) -> DataFrame:
    """`node`, `cluster_size`: the greatest number of different nodes that share one of the node's values."""
    each = ties.select(F.col(node).alias("node"), F.col(value).alias("_v")).where("node is not null and _v is not null").distinct()
    sizes = each.groupBy("_v").agg(F.count("*").alias("_n"))
    return each.join(sizes, "_v").groupBy("node").agg(F.max("_n").alias("cluster_size"))
