"""Exact percentiles per group by distributed multi-select (problem 7).

The values of a group are searched, never sorted as a whole: every block of values
proposes its local median, the median of the proposals, weighted by the values they stand
for, becomes the pivot, values below, at and above the pivot are counted, and the ranges
that cannot hold the wanted rank are discarded. This is repeated for all groups at once
until each has its value.

The input is a table of value counts. Counts of splits of a table (partitions, days) add
up, so percentiles of their union come from `merge_counts`, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarraf.session import cut, cut_counting


def value_counts(rows: DataFrame, groups: list[str], value: str | Column) -> DataFrame:
    """`groups`, `value` (double), `n`. Null and NaN are no values; null groups are a group."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    given = rows.select(*groups, v.alias("_v")).where("_v is not null and not isnan(_v)")
    return given.groupBy(*groups, "_v").agg(F.count("*").alias("n")).withColumnRenamed("_v", "value")


def merge_counts(*splits: DataFrame) -> DataFrame:
    """The counts of the union of the splits."""
    both = reduce(DataFrame.unionByName, splits)
    groups = [c for c in both.columns if c not in ("value", "n")]
    return both.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def local_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and target `_t` the weighted lower median of `value` and its weight."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t, v, n = (batch.column(i).to_numpy() for i in range(3))
        order = np.lexsort((v, t))
        t, v, n = t[order], v[order], n[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        weight = np.add.reduceat(n, first)
        run = np.cumsum(n)
        before = run[first] - n[first]
        at = np.searchsorted(run, before + (weight + 1) // 2)
        yield pa.RecordBatch.from_arrays([pa.array(t[first]), pa.array(v[at]), pa.array(weight)], names=["_t", "median", "weight"])


def percentiles(counts: DataFrame, groups: list[str], fractions: list[float], most_broadcast: int = 200_000) -> DataFrame:
    """`groups`, `fraction`, `n`, `percentile`: linear interpolation between the two nearest ranks.

    `counts` is as of `value_counts`. The result is exact: the search runs at every size until
    each target (a group and a fraction) has met its value. Groups without values have no row;
    an empty table gives no rows. Groups may be null, of any size and number; a group holding
    most rows is spread over all tasks. A round rules out about half of what is left of every
    target, so there are about as many rounds as the largest group has binary digits. The
    pivots, one row a target, are sent to the tasks where there are no more than
    `most_broadcast`, and joined by a shuffle otherwise, with the same rows.
    """
    key = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]) if groups else F.struct(F.lit(0).alias("g"))
    table = cut(counts.select(F.xxhash64(F.to_json(key, {"ignoreNullFields": "false"})).alias("_h"), key.alias("_g"), *groups, F.col("value").cast("double").alias("value"), F.col("n").cast("long").alias("n")))
    wanted = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    sizes = table.groupBy("_h", "_g", *groups).agg(F.sum("n").alias("size")).withColumn("fraction", wanted)
    rank = (F.col("size") - 1) * F.col("fraction")
    # Targets are numbered, so groups whose hashes agree stay apart.
    targets, count = cut_counting(sizes.select("_h", "_g", *groups, "size", "fraction", F.monotonically_increasing_id().alias("_t"), (F.floor(rank + 1e-9) + 1).cast("long").alias("_k"), F.greatest(rank - F.floor(rank + 1e-9), F.lit(0.0)).alias("_part")))
    sent = F.broadcast if count <= most_broadcast else lambda rows: rows
    # Each value in range carries the rank still wanted of its target; a target that is met leaves one row with `_x`.
    active, open_values = cut_counting(table.join(sent(targets.select("_h", "_g", "_t", "_k")), ["_h", "_g"]).select("_t", "value", "n", "_k", F.lit(None).cast("double").alias("_x")))
    met = []
    while open_values:
        left = active.where("_x is null")
        proposals = left.select("_t", "value", "n").mapInArrow(local_medians, "_t long, median double, weight long")
        # A median between two proposals is a pivot as well; between infinities there is none, so the least proposal is taken.
        median = F.percentile("median", 0.5, F.col("weight"))
        pivots = proposals.groupBy("_t").agg(F.nanvl(median, F.min("median")).alias("_p"))
        below, equal = F.sum(F.when(F.col("value") < F.col("_p"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("value") == F.col("_p"), F.col("n")).otherwise(0))
        three = left.join(sent(pivots), "_t").groupBy("_t", "_p").agg(F.max("_k").alias("_was"), below.alias("_lt"), equal.alias("_eq"))
        side = F.when(F.col("_was") <= F.col("_lt"), -1).when(F.col("_was") <= F.col("_lt") + F.col("_eq"), 0).otherwise(1)
        ruled = three.select("_t", "_p", side.alias("_side"), F.when(side == 1, F.col("_was") - F.col("_lt") - F.col("_eq")).otherwise(F.col("_was")).alias("_now"))
        inside = F.when(F.col("_side") == 0, F.col("value") == F.col("_p")).when(F.col("_side") < 0, F.col("value") < F.col("_p")).otherwise(F.col("value") > F.col("_p"))
        kept = left.join(sent(ruled), "_t").where(inside)
        active, open_values = cut_counting(kept.select("_t", "value", "n", F.col("_now").alias("_k"), F.when(F.col("_side") == 0, F.col("value")).alias("_x")), F.col("_x").isNull())
        met.append(active.where("_x is not null").select("_t", "_x"))
    found = reduce(DataFrame.unionByName, met) if met else active.select("_t", "_x")
    lower = targets.join(sent(found.distinct()), "_t")
    upto, above = F.sum(F.when(F.col("value") <= F.col("_x"), F.col("n")).otherwise(0)), F.min(F.when(F.col("value") > F.col("_x"), F.col("value")))
    beyond = table.select("_h", "_g", "value", "n").join(sent(lower.select("_h", "_g", "_t", "_x")), ["_h", "_g"]).groupBy("_t").agg(upto.alias("_upto"), above.alias("_next"))
    upper = F.when((F.col("_upto") > F.col("_k")) | F.col("_next").isNull(), F.col("_x")).otherwise(F.col("_next"))
    return lower.join(beyond, "_t").select(*groups, "fraction", F.col("size").alias("n"), (F.col("_x") + F.col("_part") * (upper - F.col("_x"))).alias("percentile"))
