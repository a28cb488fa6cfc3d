"""Parent-child links to full hierarchies: root, depth, cycles, paths, descendants (problem 5).

Every node has one link, to its parent. A weighted forest keeps for each node the root
found so far and the offset (number of links) to it. Links of one partition are combined
where they lie: each node then points to the first ancestor outside the partition. Only
the nodes to which others point across partitions move on to the next level, which has
fewer partitions, until every link is combined; the results are then handed back down,
level by level, each adding its offset. The first level needs no partition: nodes without
children hang on their parent with offset 1. A level that hardly shrinks (long chains or
cycles dealt over many partitions) also has its links doubled by a join; a link that has
become longer than there are nodes can only lie in or above a cycle, which ends the search
for cycles of any length without ever gathering one in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarraf.session import cut, cut_counting, drop

_SCHEMA = "node string, ext string, off long, tag string, on_cycle boolean"


def combine_local(node: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Combine the links of one partition: ext, off, tag, on_cycle for each node.

    `ext` is the first ancestor that has no link here and `off` the weight up to it. In or
    above a cycle that lies wholly within these links, ext is None; tag then names a node of
    the cycle, and on_cycle tells its members.
    """
    n = len(node)
    codes, ids = pd.factorize(np.concatenate([node, parent]), sort=True)
    own, up = codes[:n], codes[n:]
    place = np.full(len(ids), -1)
    place[own] = np.arange(n)
    nxt = place[up]
    last = nxt < 0  # the parent has no link here
    at, off, exits = np.where(last, np.arange(n), nxt), np.where(last, 0, weight), last
    rounds = max(1, int(np.ceil(np.log2(max(n, 2)))) + 1)
    for _ in range(rounds):  # path compression by doubling
        off = off + off[at]
        at = at[at]
    ended = exits[at]
    ext = np.full(n, None, dtype=object)
    ext[ended] = ids[up[at[ended]]]
    off = np.where(ended, off + weight[at], 0)
    tag, on_cycle = np.full(n, None, dtype=object), np.zeros(n, dtype=bool)
    if not ended.all():
        on_cycle[np.unique(at[~ended])] = True  # after at least n steps each is on its cycle
        least, jump = own.copy(), np.where(last, np.arange(n), nxt)
        for _ in range(rounds):
            least = np.minimum(least, least[jump])
            jump = jump[jump]
        tag[~ended] = ids[least[at[~ended]]]
    return ext, off, tag, on_cycle


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    node, parent, weight = (t.column(c).to_numpy() for c in ("node", "ext", "off"))
    ext, off, tag, on_cycle = combine_local(node, parent, weight)
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(ext, pa.string()), pa.array(off, pa.int64()), pa.array(tag, pa.string()), pa.array(on_cycle)], names=["node", "ext", "off", "tag", "on_cycle"])


def _needed(links: DataFrame) -> DataFrame:
    """The links of those nodes to which other links point."""
    targets = links.where("ext is not null").select(F.col("ext").alias("node")).distinct()
    return links.where("ext is not null").select("node", "ext", "off").join(targets, "node", "left_semi")


def _double(links: DataFrame) -> DataFrame:
    """Replace each link by the link of its target, where that has one: halves all paths."""
    up = links.select(F.col("node").alias("ext"), F.col("ext").alias("_ext"), F.col("off").alias("_off"), F.col("tag").alias("_tag"))
    both = links.join(up, "ext", "left")
    hit = F.col("_off").isNotNull()
    return both.select("node", F.when(hit, F.col("_ext")).otherwise(F.col("ext")).alias("ext"), (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off"), F.coalesce("tag", "_tag").alias("tag"), "on_cycle")


def resolve(links: DataFrame, links_per_task: int = 1_000_000) -> DataFrame:
    """`node`, `root`, `depth`, `tag`, `on_cycle` for links (`node`, `parent`), one per node.

    Nodes in or above a cycle have a null root and a tag, a node on the cycle; tags of one
    cycle may differ, and on_cycle is certain only where true. A level has so many partitions
    that each takes about `links_per_task` links.
    """
    base = cut(links.select("node", F.col("parent").alias("ext"), F.lit(1).cast("long").alias("off"), F.lit(None).cast("string").alias("tag"), F.lit(False).alias("on_cycle")))
    levels = [base]
    current, left = cut_counting(_needed(base))
    nodes = left
    while left:
        combined = cut(current.repartition(-(-left // links_per_task), "node").mapInArrow(_combine, _SCHEMA))
        levels.append(combined)
        drop(current)
        current, remaining = cut_counting(_needed(combined))
        if remaining > 0.9 * left:
            doubled = _double(combined)
            endless = F.col("off") > nodes  # more links than nodes: the target lies on a cycle
            doubled = cut(doubled.withColumn("tag", F.when(endless, F.coalesce("tag", "ext")).otherwise(F.col("tag"))).withColumn("ext", F.when(~endless, F.col("ext"))))
            levels[-1] = doubled
            drop(combined, current)
            current, remaining = cut_counting(_needed(doubled))
        left = remaining
    shape = ("node", F.col("ext").alias("root"), F.col("off").alias("depth"), "tag", "on_cycle")
    # Nodes found in cycles of one partition have left the levels above, which still point to them.
    looped = cut(reduce(DataFrame.unionByName, [level.where("tag is not null").select(*shape) for level in levels]))
    found = levels[-1].select(*shape).limit(0)
    while levels:
        below = levels.pop()
        known = found.unionByName(looped.join(found, "node", "left_anti"))
        up = known.select(F.col("node").alias("ext"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("tag").alias("_tag"), F.lit(True).alias("_hit"))
        ons = known.where("on_cycle").select("node", F.lit(True).alias("_on"))
        lifted = below.join(up, "ext", "left").join(ons, "node", "left")
        last, found = found, cut(lifted.select(
            "node",
            F.when(F.col("_hit"), F.col("_root")).otherwise(F.col("ext")).alias("root"),
            (F.col("off") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.coalesce("tag", "_tag").alias("tag"),
            (F.col("on_cycle") | F.coalesce("_on", F.lit(False))).alias("on_cycle"),
        ))
        drop(last, below)
    drop(looped)
    return found


def hierarchy(links: DataFrame, node: str, parent: str, links_per_task: int = 1_000_000) -> DataFrame:
    """`node`, `root_id`, `depth` (int), `kind` for each different node of `links`.

    `tree`: root_id is the root, depth the links to it, 0 for a root. `cycle`: the node is on
    a cycle (a node that is its own parent is one), root_id the smallest node of the cycle,
    depth 0. `into_cycle`: the chain ends in a cycle, root_id as before, depth the links to
    the first node on it. A null parent, or a parent without a row of its own, makes a root;
    parents without a row get no row. Rows with null node are left out; of several rows of a
    node the one with the smallest parent counts (null only if there is no other). An empty
    table gives no rows; other columns are ignored.
    """
    nodes = links.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    nodes = cut(nodes)
    found = resolve(nodes.where("parent is not null"), links_per_task)
    roots = nodes.where("parent is null").select("node", F.col("node").alias("root_id"), F.lit(0).alias("depth"), F.lit("tree").alias("kind"))
    trees = found.where("tag is null").select("node", F.col("root").alias("root_id"), F.col("depth").cast("int"), F.lit("tree").alias("kind"))
    looped = found.where("tag is not null")
    if looped.isEmpty():
        return roots.unionByName(trees).withColumnRenamed("node", node)
    inside = cut(nodes.join(looped.select("node"), "node"))
    members = _cycle_members(inside)
    cycles = cut(_least_on_cycle(inside.join(members, "node", "left_semi")).select("node", F.col("least").alias("root_id"), F.lit(0).alias("depth"), F.lit("cycle").alias("kind")))
    # With the members as roots, what is left is a forest again.
    rest = resolve(inside.join(members, "node", "left_anti").select("node", "parent"), links_per_task)
    into = rest.join(cycles.select(F.col("node").alias("root"), "root_id"), "root").select("node", "root_id", F.col("depth").cast("int"), F.lit("into_cycle").alias("kind"))
    return roots.unionByName(trees).unionByName(cycles).unionByName(into).withColumnRenamed("node", node)


def _cycle_members(inside: DataFrame) -> DataFrame:
    """All nodes on cycles, of nodes that all lie in or above one.

    Walking the same number of links from every node reaches fewer and fewer nodes until only
    those on cycles are left. The number of links doubles each round; once a round reaches as
    many nodes as the one before, these are the members.
    """
    state = cut(inside.select("node", F.col("parent").alias("at")))
    reached = state.select("at").distinct().count()
    while True:
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("_at"))
        last, state = state, cut(state.join(ahead, "at").select("node", F.col("_at").alias("at")))
        drop(last)
        now = state.select("at").distinct().count()
        if now == reached:
            return cut(state.select(F.col("at").alias("node")).distinct())
        reached = now


def _least_on_cycle(members: DataFrame) -> DataFrame:
    """`node`, `least`: the smallest node of the cycle, over twice as many links each round."""
    last = state = cut(members.select("node", F.col("parent").alias("next"), F.least("node", "parent").alias("least")))
    while True:
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        both, moving = cut_counting(state.join(ahead, "next").select("node", F.col("_next").alias("next"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("_new")), F.col("_new"))
        drop(last)
        last, state = both, both.drop("_new")
        if not moving:
            return state.select("node", "least")


def paths(links: DataFrame, node: str, parent: str, found: DataFrame) -> DataFrame:
    """The whole chain of each node of a tree or into a cycle, from the root down: `path`.

    Every node knows the chain up to some ancestor; each round it takes over the chain that
    this ancestor knows, so chains double and a tree of depth d takes about log d rounds.
    `found` is the result of `hierarchy`; members of cycles have the path of themselves alone.
    """
    index = links.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    kept = cut(found.select(F.col(node).alias("node"), "root_id", "depth", "kind"))
    state, open_ends = cut_counting(kept.join(index, "node").select("node", F.array("node").alias("path"), F.when(F.col("depth") > 0, F.col("parent")).alias("at")), F.col("at").isNotNull())
    while open_ends:
        ahead = state.select(F.col("node").alias("at"), F.col("path").alias("_path"), F.col("at").alias("_at"))
        # An ancestor without a row of its own is a root, and its chain itself.
        moved = state.where("at is not null").join(ahead, "at", "left").select("node", F.concat(F.coalesce("_path", F.array("at")), "path").alias("path"), F.col("_at").alias("at"))
        last, (state, open_ends) = state, cut_counting(moved.unionByName(state.where("at is null")), F.col("at").isNotNull())
        drop(last)
    return kept.join(state.select("node", "path"), "node").withColumnRenamed("node", node).select(node, "root_id", "depth", "kind", "path")


def descendants(with_paths: DataFrame, node: str) -> DataFrame:
    """`ancestor`, `descendant`, `distance` for every pair of a node and one below it."""
    rows = with_paths.select(F.col(node).alias("descendant"), F.posexplode("path").alias("at", "ancestor"), F.size("path").alias("n"))
    return rows.where("ancestor <> descendant").select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).alias("distance"))
