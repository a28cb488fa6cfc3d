"""Exact ranks and percentiles of groups of any size: counted over range partitions, never gathered.

Different values of a group are sorted by range partitioning with their counts. A partition
knows how many values of each group lie in the partitions before it, so the rank of every
value is known without one task ever holding a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarraf.session import cut


def running_counts(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """`_g` (a struct of the groups), `_v`, `n`, `upto`, `size`: each different value with its count, the rows up to it and in all.

    Null and NaN are no values; null groups are a group.
    """
    g = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)]) if groups else F.struct(F.lit(0).alias("g0"))
    given = rows.select(g.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    counts = given.groupBy("_g", "_v").agg(F.count("*").alias("n"))
    placed = cut(counts.orderBy("_g", "_v").withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.select("_g", "_v", "n", F.shiftright("_m", 33).alias("_p"), "_m")
    parts = placed.groupBy("_g", "_p").agg(F.sum("n").alias("_in"))  # one row a group and range partition
    whole = Window.partitionBy("_g")
    parts = parts.select("_g", "_p", (F.sum("_in").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).alias("_before"), F.sum("_in").over(whole).alias("size"))
    inside = placed.withColumn("_run", F.sum("n").over(Window.partitionBy("_g", "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(parts, ["_g", "_p"]).select("_g", "_v", "n", (F.col("_before") + F.col("_run")).alias("upto"), "size")


def percentiles(rows: DataFrame, groups: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """groups, `n` and one column for each name: the percentile, linear between the two nearest ranks.

    Groups without values have no row.
    """
    ranked = running_counts(rows, groups, value)
    picks = []
    for name, fraction in named.items():
        rank = (F.col("size") - 1) * fraction
        at = F.floor(rank + 1e-9)
        holds = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)
        picks += [F.max(F.when(holds(at), F.col("_v"))).alias(f"_lo_{name}"), F.max(F.when(holds(F.least(at + 1, F.col("size") - 1)), F.col("_v"))).alias(f"_hi_{name}"), F.max(F.greatest(rank - at, F.lit(0.0))).alias(f"_part_{name}")]
    found = ranked.groupBy("_g").agg(F.max("size").alias("n"), *picks)
    lo, hi, part = (lambda n, k=k: F.col(f"_{k}_{n}") for k in ("lo", "hi", "part"))
    return found.select(*[F.col(f"_g.g{i}").alias(c) for i, c in enumerate(groups)], "n", *[F.when(part(n) > 0, lo(n) + part(n) * (hi(n) - lo(n))).otherwise(lo(n)).alias(n) for n in named])


def with_cumulative_rank(rows: DataFrame, value: str, within: str, name: str) -> DataFrame:
    """`rows` with the share, 0 to 100, of the rows of `within` whose value is not greater; null where the value is."""
    ranks = running_counts(rows, [within], value).select(F.col("_g.g0").alias("_within"), "_v", (F.col("upto") / F.col("size") * 100).alias(name))
    same = F.col(within).eqNullSafe(F.col("_within")) & (F.col(value).cast("double") == F.col("_v"))
    return rows.join(ranks, same, "left").drop("_within", "_v")


def medians(rows: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """The exact median of each expression over the whole table; None where there are no values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), e.cast("double").alias("v")) for c, e in columns.items()])
    found = percentiles(rows.select(F.inline(pairs)), ["c"], "v", {"median": 0.5})
    return dict.fromkeys(columns) | {r["c"]: r["median"] for r in found.collect()}  # one row a column
